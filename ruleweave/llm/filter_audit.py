"""How filters of documents interact: survivors of every subset of filters, in every order.

A document becomes a truth table in one word: bit s is set if it survives the
subset s of the filters.  Carry-save adders count all bit positions of many words
at once, by part and label; whatever an order of filters keeps, removes or removes
needlessly follows from those counts of survivors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The filters, and the limits of A, B and C.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SUBSETS = 1 << len(FILTERS)
COPY = 1 << FILTERS.index("E")
#: Salts over which rows without an id are dealt.
SALTS = 1024

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = re.compile("[#$%&*|]")


def text_failures(text: str) -> int:
    """Bit i is set if the text fails filter i, for A to D."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes are split at the six ASCII blanks
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * len(text)) << 2
        | (_MARKS.search(text) is not None) << 3
    )


def survival_words() -> np.ndarray:
    """For every mask of failed filters the word whose bit s says that a document survives subset s."""
    return np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], np.uint32)


def positional_counts(words: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """How many words, each counted `times` times, have each of the 32 bits set.

    A word enters the planes of the binary digits of its count.  Full adders turn
    three words of a plane into a sum in it and a carry in the next, until at most
    two words are left in each.
    """
    times = np.ones(len(words), np.int64) if times is None else times
    planes: dict[int, list[np.ndarray]] = {}
    for digit in range(int(times.max(initial=0)).bit_length()):
        planes[digit] = [words[times >> digit & 1 == 1]]
    total, digit = np.zeros(32, np.int64), 0
    while planes:
        held = np.concatenate(planes.pop(digit, [words[:0]]))
        while len(held) > 2:
            third = len(held) // 3
            a, b, c, rest = held[:third], held[third : 2 * third], held[2 * third : 3 * third], held[3 * third :]
            either = a ^ b
            planes.setdefault(digit + 1, []).append(a & b | either & c)
            held = np.concatenate([either ^ c, rest])
        for word in held:
            total += (int(word) >> np.arange(32) & 1) << digit
        digit += 1
    return total


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the mask of failed text filters of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("failed", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, masks = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
                masks.append(text_failures(text))
            columns = [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, failed int")


def marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with good and toxic, true where some label of the document says so."""
    says = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*says)
    # rows without an id match nothing; dealt by their digests they do not meet in one task
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS)) + 1).otherwise(F.lit(0))
    on = (F.col("doc_id") == F.col("_id")) & (F.col("salt") == F.col("_salt"))
    joined = rows.withColumn("salt", salt).join(known.withColumn("_salt", F.lit(0).cast("long")), on, "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return joined.select("doc_id", "part", "digest", "failed", *flags)


def words_of(rows: DataFrame) -> DataFrame:
    """part, good, toxic, failed (with filter E) and n, the number of documents that agree in all of them and their text.

    Documents are first counted by all their values, so the copies of one text are
    dealt out, and then by text, where partial sums leave few rows of any text.
    """
    own = ["digest", "failed", "part", "good", "toxic"]
    each = rows.groupBy(*own, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy(*own).agg(
        F.sum("n").alias("all"), F.min("doc_id").alias("id"), F.min_by("n", "doc_id").alias("n_id"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    firsts = groups.groupBy("digest").agg(F.min("id").alias("first"))
    placed = groups.join(firsts, "digest")  # a text has one row for each part and label at most
    originals = F.when(F.col("id") == F.col("first"), F.col("n_id")).otherwise(0) + F.col("n_null")
    kinds = F.array(
        F.struct(F.col("failed").alias("failed"), originals.alias("n")),
        F.struct(F.col("failed").bitwiseOR(F.lit(COPY)).alias("failed"), (F.col("all") - originals).alias("n")),
    )
    return placed.select("part", "good", "toxic", F.inline(kinds)).where("n > 0")


def survivors(words: DataFrame) -> DataFrame:
    """part, subset, and how many documents of the part survive it: all, good ones, toxic ones."""
    schema = pa.schema([("part", pa.string()), ("subset", pa.int32())] + [(c, pa.int64()) for c in ("n", "good", "toxic")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = survival_words()
        for batch in batches:
            part = batch.column("part").dictionary_encode()
            cells = part.indices.to_numpy() * 4
            for bit, name in ((1, "good"), (2, "toxic")):
                cells = cells + batch.column(name).to_numpy(zero_copy_only=False) * bit
            word, times = table[batch.column("failed").to_numpy()], batch.column("n").to_numpy()
            order = np.argsort(cells, kind="stable")
            starts = np.flatnonzero(np.diff(cells[order], prepend=-1))
            names = part.dictionary.to_pylist()
            for a, b in zip(starts, [*starts[1:], len(order)]):
                at, cell = order[a:b], int(cells[order[a]])
                counts = positional_counts(word[at], times[at])
                columns = [[names[cell // 4]] * SUBSETS, list(range(SUBSETS)), counts, counts * (cell & 1), counts * (cell >> 1 & 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    found = words.mapInArrow(run, "part string, subset int, n long, good long, toxic long")
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


_STEP = pa.schema(
    [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
    + [(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
)


def steps(part: str, n: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
    """A row for each order and step of one part, from its survivors by subset."""
    every, rows, shapley = SUBSETS - 1, [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            after = before | bit
            removed, fails = n[before] - n[after], n[0] - n[bit]
            shapley[letter] += removed
            alone = n[every & ~bit] - n[every]
            rows.append(
                (part, "".join(order), step, n[after], removed, fails - removed, alone)
                + (good[before] - good[after], toxic[before] - toxic[after], letter)
            )
            before = after
    for *row, letter in rows:
        yield (*row, shapley[letter])


def orders(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; see `audit`."""
    whole = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = zip(*steps(row["part"], *([c[k] for c in row["cells"]] for k in ("n", "good", "toxic"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, _STEP)], schema=_STEP)

    counted = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return whole.mapInArrow(run, f"part string, filter_order string, step int, {counted}")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every part (language; null counts as the empty string) by order of the filters and step.

    kept survive this step, removed go here, redundant fail its filter but went
    earlier, unique_fails fail its filter only; good_lost and toxic_lost are
    those of removed that a label calls good or toxic; shapley sums what its
    filter removes over all orders.

    A null text is empty.  A document is a copy if a smaller doc_id has its very
    text: repeated rows of the smallest id are none, nor are rows with a null id,
    which also have no label.  Several labels of one document count as one that
    says all they say; labels without a document count nowhere.  Other columns are
    ignored; an empty table gives no rows.
    """
    return orders(survivors(words_of(marked(judged(documents), labels))))
