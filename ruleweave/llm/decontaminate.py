"""Benchmark decontamination by SimHash of item-sized windows.

A document position that holds a shingle of an item names the window in which
the item would stand.  Windows of documents that hold enough of an item get a
weighted SimHash; a multi-index over blocks of bits finds every item within the
radius, and the weighted shingle similarity decides.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import batches_of, landed, rows_of

SHINGLE, SIMILAR = 5, 0.75
BITS, BLOCKS = 64, 16
#: Similarity 0.75 of equal sizes turns a SimHash by 11 bits on average; the radius leaves over four deviations.
RADIUS = 24
#: Tokens whose word hashes a task remembers.
REMEMBERED = 300_000
#: Items of one pass over the documents; what is broadcast holds no more.
ITEMS = 20_000
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall((text or "").lower())


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles, in order; fewer words are one shingle, none give none."""
    length = min(SHINGLE, len(hashes))
    if not length:
        return np.empty(0, np.uint64)
    n = len(hashes) - length + 1
    out = np.full(n, length, np.uint64)
    for i in range(length):
        out = (out ^ hashes[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each hash."""
    spread = (hashes[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    return spread.astype(np.int8) * 2 - 1


def simhash(kinds: np.ndarray, weights: np.ndarray) -> int:
    """The sign of each bit's weighted sum over distinct shingles."""
    sums = weights @ _bits(kinds).astype(np.float64)
    return int(sum(1 << int(i) for i in np.flatnonzero(sums > 0)))


class Index:
    """Items by shingle and, through blocks of their SimHash, by Hamming distance.

    A shingle weighs 1 + ln(items / items that hold it); one that no item holds
    weighs as one of a single item.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.prints, self.words = [], [], []
        sets = []
        for item, text in items:
            w = words_of(text)
            if w:
                h = shingles(np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64))
                self.items.append(item)
                self.words.append(len(w))
                sets.append(h)
        held: dict[int, int] = defaultdict(int)
        for h in sets:
            for x in set(h.tolist()):
                held[x] += 1
        self.top = 1 + math.log(max(1, len(sets)))
        self.weight = {x: self.top - math.log(n) for x, n in held.items()}
        self.sets, self.mass = [], []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, h in enumerate(sets):
            kinds = np.unique(h)
            w = np.array([self.weight[x] for x in kinds.tolist()])
            self.sets.append(set(kinds.tolist()))
            self.mass.append(float(w.sum()))
            self.prints.append(simhash(kinds, w))
            for at, x in enumerate(h.tolist()):
                self.places[x].append((n, at))
        # distance <= RADIUS leaves at most RADIUS // BLOCKS errors in some block
        self.width, self.errors = BITS // BLOCKS, RADIUS // BLOCKS
        self.blocks: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(BLOCKS)]
        for n, p in enumerate(self.prints):
            for b in range(BLOCKS):
                self.blocks[b][p >> b * self.width & (1 << self.width) - 1].append(n)
        self.flips = [sum(1 << i for i in c) for k in range(self.errors + 1) for c in combinations(range(self.width), k)]
        self.known = np.array(sorted(self.places), np.uint64)
        # a table of leading bits settles most shingles with one look
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def within(self, fingerprint: int) -> set[int]:
        """Numbers of all items whose SimHash is within the radius."""
        met = set()
        for b, block in enumerate(self.blocks):
            own = fingerprint >> b * self.width & (1 << self.width) - 1
            for flip in self.flips:
                met.update(block.get(own ^ flip, ()))
        return {n for n in met if (self.prints[n] ^ fingerprint).bit_count() <= RADIUS}

    def similarity(self, n: int, kinds: set[int]) -> float:
        weight, top = self.weight.get, self.top
        both = sum(weight(x) for x in kinds & self.sets[n])
        return both / (self.mass[n] + sum(weight(x, top) for x in kinds) - both)

    def leaks(self, h: np.ndarray, n_words: int) -> list[tuple[int, int, int, int, float]]:
        """(item, start, words, distance, similarity): the best window of each item that a text holds."""
        spots = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)])
        if len(spots):
            own = h[spots]
            near = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
            spots = spots[self.known[near] == own]
        if not len(spots):
            return []
        starts, covered = defaultdict(set), defaultdict(set)
        for p in spots.tolist():
            x = int(h[p])
            for n, at in self.places[x]:
                covered[n].add(x)
                starts[n].add(p - at)
        windows = defaultdict(set)
        for n, kinds in covered.items():
            # without this share of the item's weight no window can be similar enough
            if sum(self.weight[x] for x in kinds) >= SIMILAR * self.mass[n] * (1 - 1e-9):
                for s in starts[n]:
                    windows[self.words[n]].add(max(0, min(s, n_words - self.words[n])))
        best = {}
        for size, own in windows.items():
            count = max(1, size - SHINGLE + 1)
            for s in sorted(own):
                kinds = np.unique(h[s : s + count])
                weights = np.array([self.weight.get(x, self.top) for x in kinds.tolist()])
                fingerprint = simhash(kinds, weights)
                for n in self.within(fingerprint):
                    if self.words[n] != size:
                        continue  # its own windows decide
                    like = self.similarity(n, set(kinds.tolist()))
                    if like >= SIMILAR and like > best.get(n, (0,))[0]:
                        best[n] = (like, s, min(size, n_words), (self.prints[n] ^ fingerprint).bit_count())
        return [(self.items[n], s, size, far, round(like, 6)) for n, (like, s, size, far) in sorted(best.items())]


def _finder(index: Index):
    seen: dict[str, tuple[int, ...]] = {}

    def find(text: str | None):
        tokens = (text or "").split()
        if len(seen) > REMEMBERED:
            seen.clear()
        for t in set(tokens).difference(seen):
            seen[t] = tuple(xxhash.xxh3_64_intdigest(w) for w in words_of(t))
        # words never reach over a blank, so the words of the tokens are those of the text
        hashes = np.fromiter(chain.from_iterable(map(seen.__getitem__, tokens)), np.uint64)
        return index.leaks(shingles(hashes), len(hashes)) if len(hashes) else []

    return find


LEAKS = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64()), ("similarity", pa.float64())]
)


def _indexes(documents: DataFrame, benchmark: DataFrame):
    """Broadcast indexes of blocks of the stated items, which are read to the driver block by block."""
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    blocks = -(-items.count() // ITEMS)
    split = items.withColumn("block", F.expr(f"pmod(xxhash64(item_id, text), {max(1, blocks)})"))
    for b in range(blocks):
        rows = split.where(F.col("block") == b).select("item_id", "text").collect()
        yield documents.sparkSession.sparkContext.broadcast(Index(sorted((tuple(r) for r in rows), key=repr)))


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each (doc_id, item_id) where a window of the document's whole text is similar to the item.

    start_word and n_words tell the best window in words, distance the differing
    SimHash bits, similarity the weighted shingle similarity.  Null and empty
    texts and items match nothing; an item shorter than five words must stand
    there as a whole text of its own shingle.  Repeated rows give repeated
    findings, null ids stay, other columns are ignored; empty tables give no rows.
    """
    kinds = "doc_id long, item_id long, start_word long, n_words long, distance long, similarity double"
    out = documents.sparkSession.createDataFrame([], kinds)
    for shared in _indexes(documents, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            find = _finder(shared.value)
            return batches_of(((doc, *leak) for doc, text in rows_of(batches) for leak in find(text)), LEAKS)

        out = out.unionByName(documents.select("doc_id", "text").mapInArrow(run, kinds))
    return out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item leaks; all columns stay."""
    out = documents
    for shared in _indexes(documents, benchmark):
        at = out.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            find = _finder(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not find(t.as_py()) for t in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out if out is documents else landed(out, "clean-documents")
