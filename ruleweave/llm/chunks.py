"""Texts cut at blanks into chunks that a byte-level vocabulary encodes on their own, a batch at a time.

The split patterns of byte-level vocabularies always start a pre-token at a
blank before a visible character.  Arrow cuts the texts there and tells equal
chunks apart; an encoder sees each distinct chunk once, and the ids of whole
texts are gathered from theirs without a loop over words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once, unless one text is longer.
SLICE = 4 << 20
#: Id bytes of a chunk: little-endian unsigned 32-bit integers.
IDS = np.dtype("<u4")


#: What follows a blank that is no cut: nothing, or any kind of white space.
_NO_CUT = r"^(?:$|[\x09-\x0d\x1c-\x20\x{85}\pZ])"


def _flags(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of at most so many bytes of text or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < len(sizes):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def gathered(store: pa.LargeBinaryArray, which: np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
    """Entries of the store one after the other: their ends, from 0 on, and all their bytes."""
    taken = store.take(pa.array(which))
    ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
    data = taken.buffers()[2] or pa.py_buffer(b"")
    first = int(ends[0])
    return ends - first, data.slice(first, int(ends[-1]) - first)


class Chunks:
    """Ids of texts through `ids_of`, which gets distinct chunks and gives the id bytes of each.

    A chunk met lately is not asked for again: up to `most` chunks are remembered
    in two generations, the older of which goes when the younger is full.
    """

    def __init__(self, ids_of: Callable[[list[str]], list[bytes]], most: int, special: str = ""):
        self.ids_of, self.most, self.special = ids_of, most, special
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def known(self, chunks: list[str]) -> list[bytes]:
        """Id bytes of distinct chunks."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, chunks))
        new = [c for c, ids in zip(chunks, found) if ids is None]
        if not new:
            return found
        missing = [c for c in new if c not in old]
        young.update([(c, old[c]) for c in new if c in old])
        if missing:
            young.update(zip(missing, self.ids_of(missing)))
        return list(map(young.__getitem__, chunks))

    def store(self, words: pa.Array, others: list[str]) -> pa.LargeBinaryArray:
        """Id bytes of distinct chunks: words with a blank before them, and behind them chunks of any other form."""
        named = words.to_numpy(zero_copy_only=False).tolist()
        return pa.array(self.known([*[" " + w for w in named], *others]), pa.large_binary())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
        """Where the ids of each text end (in ids, from 0 on) and the id bytes of all; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.split_pattern(texts, " ")
        at = cut.offsets.to_numpy().astype(np.int64)  # of the texts' first pieces, and the end
        pieces = cut.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at -= at[0]
        which = pieces.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(which), bool)
        first[at[:-1]] = True
        # a blank before another blank, white space or the end is no cut: such a piece belongs to the chunk before it
        joined = _flags(pc.match_substring_regex(pieces.dictionary, _NO_CUT))[which] & ~first
        plain = ~first & ~joined & ~np.append(joined[1:], False)
        if self.special:  # a chunk that holds it is cut once more by the encoder
            odd = _flags(pc.match_substring(pieces.dictionary, self.special))[which]
            whole = np.maximum.reduceat(odd, at[:-1]) if len(texts) else odd
            row = np.repeat(whole, np.diff(at))
            plain, joined = plain & ~row, (joined | row) & ~first  # such a text is one chunk
        heads = np.flatnonzero(~joined)
        numbers = np.empty(len(which), np.int64)
        used = np.zeros(len(pieces.dictionary), bool)
        used[which[plain]] = True
        numbers[plain] = (np.cumsum(used) - 1)[which[plain]]
        words = pieces.dictionary.filter(pa.array(used))
        ends = np.append(heads[1:], len(which))
        rest = np.flatnonzero(~plain[heads])
        kinds = pieces.dictionary.to_numpy(zero_copy_only=False) if len(rest) else ()
        others: dict[str, int] = {}
        for a, b in zip(heads[rest].tolist(), ends[rest].tolist()):
            name = " ".join([kinds[k] for k in which[a:b]])
            name = name if first[a] else " " + name
            numbers[a] = len(words) + others.setdefault(name, len(others))
        stops, data = gathered(self.store(words, list(others)), numbers[heads])
        return stops[np.searchsorted(heads, at)] // IDS.itemsize, data


def binary_column(ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    """Bytes cut at the given ends (the first is 0) as an Arrow column."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), data]).cast(pa.binary())
