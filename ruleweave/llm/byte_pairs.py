"""Byte-level BPE with a two-tier lookup.

Whole pre-tokens that are in the vocabulary are found through a minimal perfect
hash; the others are merged pair by pair with a heap over linked bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from ruleweave.llm.common import batches_of, rows_of

#: Chunks, and pre-tokens inside chunks, whose ids one worker remembers.  A full memory becomes the
#: older of two and the older one is dropped, so results do not depend on it.
CHUNKS, PIECES = 450_000, 200_000
_MIX, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 token, blank, rank per line)."""
    pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def unicode_blanks(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` spelt as the Unicode property, which is how the library reads them."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class PerfectHash:
    """A minimal perfect hash of byte strings to 0 .. n-1, by hashing and displacing.

    Keys fall into small buckets; the fullest first, each bucket looks for a
    displacement that sends its keys to free slots.  A bucket of one key takes any
    free slot, stored as a negative number.  Built in order of the keys, so equal
    keys give an equal table.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 3)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        split: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            split.setdefault(h % self.buckets, []).append((h, key))
        free = n
        for bucket, own in sorted(split.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                free -= 1
                while self.keys[free] is not None:
                    free -= 1
                self.shift[bucket], self.keys[free] = -free - 1, own[0][1]
                continue
            d = 0
            while True:
                spots = [self._slot(h, d) for h, _ in own]
                if len(set(spots)) == len(spots) and all(self.keys[s] is None for s in spots):
                    break
                d += 1
            self.shift[bucket] = d
            for s, (_, key) in zip(spots, own):
                self.keys[s] = key

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * _MIX)) * _MIX) & _WORD
        return ((x >> 32) ^ x) % self.n

    def find(self, key: bytes) -> int:
        """The slot of a key, or -1 for a string that is not one."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return slot if self.keys[slot] == key else -1


_DOUBLE = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")


class Memory:
    """The latest entries, in two generations of at most `most` each."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


def by_chunks(ids_of, memory: Memory):
    """A function from text to ids that asks `ids_of` only for chunks not met lately.

    The split patterns of byte-level vocabularies always start a pre-token at a
    blank before a visible character, so a text falls there into chunks with ids
    of their own.  `ids_of` takes a list of texts and gives the ids of each.
    """

    def encode(text: str) -> list[int]:
        if text.endswith(" ") or _DOUBLE.search(text):
            first, *rest = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
        memory.turn()
        young, old, missing = memory.young, memory.old, []
        for c in set(rest).difference(young):
            if c in old:
                young[c] = old[c]
            else:
                missing.append(c)
        if missing:
            young.update(zip(missing, ids_of([" " + c for c in missing])))
        head = next(iter(ids_of([first])), ()) if first else ()
        return list(chain(head, chain.from_iterable(map(young.__getitem__, rest))))

    return encode


class Coder:
    """Encodes and decodes with a rank table and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.whole = PerfectHash(list(ranks))
        self.slot_ids = [ranks[k] for k in self.whole.keys]
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.chunks, self.pieces = Memory(CHUNKS), Memory(PIECES)

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        slot = self.whole.find(piece)
        return (self.slot_ids[slot],) if slot >= 0 else merge(piece, self.ranks)

    def __getstate__(self):
        return self.__dict__ | {"chunks": Memory(CHUNKS), "pieces": Memory(PIECES)}

    def encoder(self):
        """A function from text to ids; its bounded memory stays with this object."""
        split, find, chunks, pieces = regex.compile(unicode_blanks(self.pattern)).findall, self.piece, self.chunks, self.pieces

        def known(p: str) -> tuple[int, ...]:
            ids = pieces.young.get(p)
            if ids is None:
                ids = pieces.old.get(p)
                if ids is None and p[0] == " ":
                    ids = chunks.young.get(p[1:])
                if ids is None:
                    ids = find(p.encode("utf-8"))
                pieces.young[p] = ids
            return ids

        def chunk(text: str) -> tuple[int, ...]:
            if text[0] == " " and text[1:].isalpha():  # one run of letters
                return find(text.encode("utf-8"))
            return tuple(chain.from_iterable(map(known, split(text))))

        def ids_of(texts: list[str]) -> list[tuple[int, ...]]:
            pieces.turn()
            return [chunk(t) for t in texts]

        return by_chunks(ids_of, chunks)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merge the pair of lowest rank, leftmost first, until no pair is in the table.

    Parts are linked by their start: `end[i]` is where part i ends and the next
    starts (-1 once it is merged away), `before[i]` where the previous one starts.
    A heap entry holds rank, start and end of a merged part in the bits of one
    number; it is stale unless two parts still meet inside just that span.
    """
    n = len(piece)
    bits = n.bit_length()
    top, low = 2 * bits, (1 << bits) - 1
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [r << top | i << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        x = pop(heap)
        e, i = x & low, x >> bits & low
        m = end[i]
        if m < 0 or m >= e or end[m] != e:
            continue
        end[m], end[i] = -1, e
        before[e] = i
        if e < n and (r := get(piece[i : end[e]])) is not None:
            push(heap, r << top | i << bits | end[e])
        b = before[i]
        if b >= 0 and (r := get(piece[b:e])) is not None:
            push(heap, r << top | b << bits | e)
    out, i = [], 0
    while i < n:
        e = end[i]
        out.append(ranks[piece[i:e]])
        i = e
    return tuple(out)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids again and return digests of both.

    ids_sha256 is of the decimal ids joined by commas.  A null text is empty and
    has no ids.  Repeated rows and null ids stay as they are; other columns are
    ignored; an empty table gives no rows.  The vocabulary travels to the tasks as
    a broadcast whose size is that of the rank file.
    """
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(Coder(read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value  # stays with the worker from task to task
        encode, decimal = coder.encoder(), {i: str(i) for i in coder.bytes_of}

        def rows():
            for doc, text in rows_of(batches):
                ids = encode(text or "")
                line = ",".join(map(decimal.__getitem__, ids)).encode()
                yield doc, len(ids), hashlib.sha256(line).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()

        return batches_of(rows(), SCHEMA)

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents.select("doc_id", "text").mapInArrow(run, kinds)
