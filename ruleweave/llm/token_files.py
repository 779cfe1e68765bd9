"""Token-id files compressed by a Re-Pair grammar.

Documents in ascending id order are encoded with the tokenizers library and
gathered into blocks.  Each block replaces frequent pairs of ids by nonterminals,
round by round, and stores the rules, the lengths of their expansions, the
remaining symbols and where those of each document end, all packed to the bits
they need, so one document can be decoded without the rest.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.llm.chunks import IDS, Chunks, slices
from ruleweave.llm.common import batches_of, landed, rows_of

END_ID = 2
END = np.array([END_ID], IDS)
#: Ids after which a block is closed; it holds whole documents.
BLOCK_IDS = 1 << 19
#: A pair has to occur this often to become a rule: it then saves more bits than the rule takes.
LEAST = 4
#: In a round every pair at least this part as frequent as the most frequent one is replaced.
SPREAD = 256
#: Smallest nonterminal; all ids are below it.
FIRST = 1 << 24
#: Bytes of text of which a worker encodes the distinct chunks at once, and chunks in one call of the library.
SLICE, CALL = 8 << 20, 50_000
#: Words whose ids a worker remembers.
REMEMBERED = 600_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HEAD = "<4sQIIIIIBBB"


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules as pairs of symbols, the lengths of their expansions, and the symbols left.

    A round counts all adjacent pairs, takes the most frequent ones and replaces
    them from left to right where they overlap; rounds follow until no pair occurs
    LEAST times.  The end id is in no pair, so no rule reaches from one document
    into the next.
    """
    seq, rules, lengths = ids.astype(np.uint32), [np.empty((0, 2), np.uint32)], np.empty(0, np.uint64)
    every = False  # whether all pairs that pay are to be replaced, not only the most frequent ones
    fresh = 0  # only pairs with a symbol from here on can have become frequent
    while len(seq) > LEAST:
        if fresh:
            new = np.flatnonzero(seq >= fresh)
            spots = np.union1d(new, new - 1)
            spots = spots[(spots >= 0) & (spots < len(seq) - 1)]
        else:
            spots = np.arange(len(seq) - 1)
        first, second = (seq[spots], seq[spots + 1]) if fresh else (seq[:-1], seq[1:])
        pairs = first.astype(np.uint64) << np.uint64(32) | second
        # sums over hashes bound the counts from above, so rare pairs need no sorting
        cell = (pairs * _MIX >> np.uint64(44)).astype(np.int64)
        bound = np.bincount(cell)[cell] if len(cell) else cell
        bound[(first == END_ID) | (second == END_ID)] = 0
        least = LEAST if every else max(LEAST, int(bound.max(initial=0)) // SPREAD)
        often = bound >= least
        spots, pairs = spots[often], pairs[often]
        kinds, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        spots, which = spots[counts[which] >= least], which[counts[which] >= least]
        # of spots that follow each other directly, every second one from the first
        start = np.maximum.accumulate(np.where(np.diff(spots, prepend=-2) > 1, spots, 0)) if len(spots) else spots
        spots, which = spots[(spots - start) % 2 == 0], which[(spots - start) % 2 == 0]
        used = np.bincount(which, minlength=len(kinds)) >= LEAST
        spots, which = spots[used[which]], which[used[which]]
        if not len(spots):
            if least == LEAST and not fresh:
                break
            every, fresh = True, 0  # a look at all pairs before the end
            continue
        every = least == LEAST
        fresh = FIRST + len(lengths) if every else 0
        halves = np.stack([kinds[used] >> np.uint64(32), kinds[used] & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        stay = np.ones(len(seq), bool)
        stay[spots + 1] = False
        seq[spots] = FIRST + len(lengths) + (np.cumsum(used) - 1)[which]
        seq = seq[stay]
        rules.append(halves)
        lengths = np.concatenate([lengths, _weights(halves, lengths)])
    return np.concatenate(rules), lengths, seq


def _weights(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids in the expansion of each row of symbols."""
    one = np.ones(symbols.shape, np.uint64)
    new = symbols >= FIRST
    one[new] = lengths[symbols[new] - FIRST]
    return one.sum(axis=1)


def expand(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for."""
    while True:
        new = seq >= FIRST
        if not new.any():
            return seq
        at = np.arange(len(seq)) + np.cumsum(new) - new
        out = np.empty(len(seq) + int(new.sum()), np.uint32)
        halves = rules[seq[new] - FIRST]
        out[at[~new]] = seq[~new]
        out[at[new]] = halves[:, 0]
        out[at[new] + 1] = halves[:, 1]
        seq = out


def _packed(numbers: np.ndarray, bits: int) -> bytes:
    """Numbers of so many bits each, at most 57, one after the other."""
    out, places = [], np.arange(bits - 1, -1, -1, dtype=np.uint64)
    for start in range(0, len(numbers), 1 << 16):
        part = numbers[start : start + (1 << 16)].astype(np.uint64)
        # a whole number of bytes but for the last part
        out.append(np.packbits((part[:, None] >> places & np.uint64(1)).astype(np.uint8)).tobytes())
    return b"".join(out)


def _unpacked(data: memoryview, bits: int, start: int, stop: int) -> np.ndarray:
    """Numbers start to stop of packed ones, reading only their bytes."""
    first, last = start * bits // 8, -(-stop * bits // 8)
    held = bytes(data[first:last]) + bytes(8)
    words = np.ndarray(len(held) - 7, ">u8", held, strides=(1,))  # the eight bytes from every byte on
    at = np.arange(start, stop, dtype=np.int64) * bits - first * 8
    return words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64) >> np.uint64(64 - bits)


def pack(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """One block: head, ids, null marks and sizes of documents, where their symbols end, rules, expansion lengths, symbols.

    Symbols are ids, or behind the largest id the numbers of rules, in as many bits
    as the largest needs.  Every document ends with the end id.
    """
    rules, lengths, seq = compress(ids)
    low = int(ids.max(initial=0)) + 1
    number = lambda x: np.where(x >= FIRST, x - np.uint32(FIRST) + np.uint32(low), x)
    bits = max(1, (low + len(rules)).bit_length())
    wide = max(1, int(lengths.max(initial=0)).bit_length())
    # end ids stay as they are, in their order
    stops = np.cumsum(sizes, dtype=np.int64) - 1
    ends = np.flatnonzero(seq == END_ID)[np.cumsum(ids == END_ID)[stops] - 1] + 1 if len(sizes) else stops
    reach = max(1, len(seq).bit_length())
    head = struct.pack(_HEAD, b"RPG2", len(ids), len(doc_ids), len(rules), len(seq), low, max(sizes, default=0), bits, wide, reach)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    null = np.packbits([d is None for d in doc_ids]).tobytes() if doc_ids else b""
    parts = ((np.array(sizes, np.int64), max(1, max(sizes, default=0).bit_length())), (ends, reach), (number(rules).ravel(), bits), (lengths, wide), (number(seq), bits))
    return b"".join([head, names, null, *(_packed(*p) for p in parts)])


class Block:
    """A packed block, read without expanding it."""

    def __init__(self, payload: bytes):
        magic, self.n_ids, docs, rules, self.n_symbols, self.low, most, self.bits, wide, reach = struct.unpack_from(_HEAD, payload)
        if magic != b"RPG2":
            raise ValueError("not a token block")
        view, at = memoryview(payload), struct.calcsize(_HEAD)

        def take(size: int) -> memoryview:
            nonlocal at
            at += size
            return view[at - size : at]

        def numbers(n: int, bits: int) -> np.ndarray:
            return _unpacked(take(-(-n * bits // 8)), bits, 0, n)

        names, null = np.frombuffer(take(8 * docs), "<i8"), np.unpackbits(np.frombuffer(take(-(-docs // 8)), np.uint8), count=docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(names, null)]
        self.sizes = numbers(docs, max(1, most.bit_length()))
        self.ends = numbers(docs, reach).astype(np.int64)
        self.rules = self._symbols(numbers(2 * rules, self.bits)).reshape(-1, 2)
        self.lengths = numbers(rules, wide)
        self.left = take(-(-self.n_symbols * self.bits // 8))

    def _symbols(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers >= self.low, numbers + np.uint64(FIRST - self.low), numbers).astype(np.uint32)

    def all_ids(self) -> np.ndarray:
        """Ids of all documents, gathered from the expansions of the rules, each made once."""
        symbols, total = self._symbols(_unpacked(self.left, self.bits, 0, self.n_symbols)), int(self.lengths.sum())
        if not len(self.rules) or total > 4 * self.n_ids:  # rules that are long beside the text
            return expand(symbols, self.rules)
        table = np.concatenate([expand(np.arange(FIRST, FIRST + len(self.rules), dtype=np.uint32), self.rules), symbols])
        starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths.astype(np.int64)
        new = symbols >= FIRST
        at, sizes = np.arange(total, total + len(symbols)), np.ones(len(symbols), np.int64)
        at[new], sizes[new] = starts[symbols[new] - FIRST], self.lengths[symbols[new] - FIRST].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        return table[np.repeat(at - before, sizes) + np.arange(int(sizes.sum()))]

    def document(self, n: int) -> np.ndarray:
        """Ids of document number n; only its own symbols are read."""
        start = int(self.ends[n - 1]) if n else 0
        return expand(self._symbols(_unpacked(self.left, self.bits, start, int(self.ends[n]))), self.rules)


class Encoder(Chunks):
    """The tokenizers library's encoder over the distinct chunks of a batch, without a loop over them.

    Words met lately and their ids are remembered as Arrow columns.
    """

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = self.tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        if len(added) > 1:
            raise ValueError("several added tokens are not supported")
        super().__init__(self.each, 0, "".join(added))
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        # of a byte-level vocabulary each character stands for one byte
        self.width = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())], np.int64)

    def each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, IDS).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def store(self, words: pa.Array, others: list[str]) -> pa.LargeBinaryArray:
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        fresh = self._together(new)
        known = pa.concat_arrays([self.ids, fresh])
        at = at.to_numpy(zero_copy_only=False)
        at = np.where(np.isnan(at), len(self.ids) + np.cumsum(np.isnan(at)) - 1, at).astype(np.int64)
        found = known.take(pa.array(at))
        if len(known) > REMEMBERED:  # the words of this batch are the latest
            self.words, self.ids = words, found
        else:
            self.words, self.ids = pa.concat_arrays([self.words, new]), known
        return pa.concat_arrays([found, pa.array(self.each(others), pa.large_binary())])

    def _together(self, words: pa.Array) -> pa.LargeBinaryArray:
        """Id bytes of words with a blank before them; the library cuts before every blank too, so one text holds many."""
        stops, ids = [np.zeros(1, np.int64)], []
        for start in range(0, len(words), CALL):
            spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words.slice(start, CALL), pa.scalar(" ", pa.large_string()))
            text = "".join(spaced.to_numpy(zero_copy_only=False))
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, IDS)  # without offsets
            sizes = np.cumsum(pc.binary_length(spaced).to_numpy())
            stops.append(np.searchsorted(np.cumsum(self.width[found]), sizes, "left") + 1 + stops[-1][-1])
            ids.append(found.tobytes())
        offsets = np.concatenate(stops) * IDS.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(ids))])


class Library:
    """A vocabulary file as it is broadcast; its encoder is made once in each worker."""

    def __init__(self, text: str):
        self.text, self.made = text, None

    def __getstate__(self):
        return {"text": self.text, "made": None}

    def chunks(self) -> Encoder:
        if self.made is None:
            self.made = Encoder(self.text)
        return self.made


BLOCK_SCHEMA = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
ROW_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_blocks(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token blocks in ascending doc_id order as a table in the shared folder.

    part numbers ranges of ids and block counts inside a part; at is the number
    of the part's ids before the block.  Null ids come first; rows of one id are
    ordered by a hash of their text.  A null text has just the end id.
    """
    spark = documents.sparkSession
    library = spark.sparkContext.broadcast(Library(Path(tokenizer_path).read_text(encoding="utf-8")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = library.value.chunks()
        part = TaskContext.get().partitionId()

        def blocks():
            docs, sizes, held, size, number, at = [], [], [], 0, 0, 0
            for batch in slices(batches, most=SLICE):
                ends, data = chunks.encode(batch.column("text"))
                ids = np.frombuffer(data, IDS)
                for doc, start, stop in zip(batch.column("doc_id").to_pylist(), ends.tolist(), ends[1:].tolist()):
                    docs.append(doc)
                    sizes.append(stop - start + 1)
                    held += (ids[start:stop], END)
                    size += sizes[-1]
                    if size >= BLOCK_IDS:
                        yield part, number, at, size, pack(docs, sizes, np.concatenate(held))
                        docs, sizes, held, size, number, at = [], [], [], 0, number + 1, at + size
            if docs:
                yield part, number, at, size, pack(docs, sizes, np.concatenate(held))

        return batches_of(blocks(), BLOCK_SCHEMA)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return landed(rows.mapInArrow(run, "part long, block long, at long, n_ids long, payload binary"), "token-blocks")


def read_rows(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the blocks."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for start, payload in rows_of(batches):
                block = Block(payload)
                ids = block.all_ids().astype(IDS)
                for doc, size in zip(block.doc_ids, block.sizes.tolist()):
                    yield doc, start, size, zlib.crc32(ids[:size].tobytes())
                    ids, start = ids[size:], start + size

        return batches_of(rows(), ROW_SCHEMA)

    placed = blocks.join(F.broadcast(before), "part").select((F.col("before") + F.col("at")).alias("start"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(blocks: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id and ids (array, with the end id) of some documents, read at random: only their symbols are expanded."""
    schema, asked = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]), set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (payload,) in rows_of(batches):
                block = Block(payload)
                for n, doc in enumerate(block.doc_ids):
                    if doc in asked:
                        yield doc, block.document(n).tolist()

        return batches_of(rows(), schema)

    return blocks.select("payload").mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(documents: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write token blocks and describe every document as read back from them.

    Repeated rows stay, one after the other; a null text has just the end id.  An
    empty table gives no rows; other columns are ignored.
    """
    return read_rows(write_blocks(documents, tokenizer_path))
