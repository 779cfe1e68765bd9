"""Near duplicates by min-hash signatures and a multi-index Hamming join.

A signature has PARTS chunks of WIDTH min-hash values of 16 bits.  Signatures that
differ in at most REACH positions have a chunk that differs in at most one (there
are fewer than two errors per chunk to go round), so every chunk is indexed once
for each position left out and such pairs always meet.  Links are confirmed on
the full shingle sets of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import BLANKS, ascii_lower, batches_of, landed, rows_of
from ruleweave.llm.components import components

SHINGLE, SIMILAR = 5, 75
PARTS, WIDTH = 10, 4
#: Pairs up to this many differing positions always share a key.
REACH = 2 * PARTS - 1
#: Pairs that met are held against each other on MARKS further min-hash values of 8 bits, and on their
#: texts up to COMPARE differing ones: similarity 0.75 gives 128 on average, and more than 180 less than once in ten million pairs.
MARKS, COMPARE = 512, 180
#: Members of one bucket that are compared with each other in one go; larger buckets are dealt over pairs of blocks.
BLOCK = 512
#: Shingles whose sets a task keeps while it compares the texts of one bucket or pair of blocks.
HELD = 500_000
#: Words whose hashes a task remembers.
REMEMBERED = 200_000
_POSITIONS = PARTS * WIDTH
_GAP = "[ \\t-\\r]+"


def plain(text: Column) -> Column:
    """The words of a text in ASCII lower case, joined by single blanks."""
    return F.regexp_replace(F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS)), _GAP, " ")


def shingle_set(words: str) -> set:
    """Distinct shingles of words joined by blanks; shorter texts are one shingle."""
    items = words.split(" ") if words else []
    if len(items) < SHINGLE:
        return {tuple(items)} if items else set()
    return set(zip(*(items[i:] for i in range(SHINGLE))))


def _odd_numbers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hasher():
    """A function from words to the distinct 64-bit hashes of their shingles."""
    seen: dict[str, int] = {}

    def hashes(words: str) -> np.ndarray:
        items = words.split(" ") if words else []
        if not items:
            return np.empty(0, np.uint64)
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in set(items).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        w = np.fromiter(map(seen.__getitem__, items), np.uint64, len(items))
        length = min(SHINGLE, len(items))
        n = len(items) - length + 1
        h = np.full(n, length, np.uint64)
        for i in range(length):
            h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h)

    return hashes


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16 bits of the least permuted hash for each factor."""
    least = np.full(len(factors), ~np.uint64(0))
    for start in range(0, len(hashes), 512):  # small enough to stay in the cache
        mixed = factors[:, None] * hashes[None, start : start + 512]
        least = np.minimum(least, mixed.min(axis=1))
    least ^= least >> np.uint64(32)
    least *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (least >> np.uint64(48)).astype("<u2")


SIGNED = pa.schema([("doc_id", pa.int64()), ("class", pa.binary()), ("n", pa.int64()), ("sig", pa.binary()), ("marks", pa.binary())])


def signed(documents: DataFrame) -> DataFrame:
    """Class (digest of the words), id, set size, signature and marks of every row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = hasher(), _odd_numbers(MARKS)

        def rows():
            for doc, digest, words in rows_of(batches):
                h = hashes(words)
                if len(h):
                    sig = signature(h, factors)
                    yield doc, digest, len(h), sig[:_POSITIONS].tobytes(), sig.astype(np.uint8).tobytes()

        return batches_of(rows(), SIGNED)

    words = documents.select("doc_id", plain(F.col("text")).alias("words"))
    words = words.select("doc_id", F.unhex(F.md5("words")).alias("class"), "words")
    return words.mapInArrow(run, "doc_id long, class binary, n long, sig binary, marks binary")


def keys(classes: DataFrame) -> DataFrame:
    """(key, node): for every chunk and every position left out, the values that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(nodes):
                continue
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, PARTS, WIDTH).astype(np.int64)
            for part in range(PARTS):
                for out in range(WIDTH):
                    key = np.full(len(nodes), part * WIDTH + out, np.int64)
                    for at in range(WIDTH):
                        if at != out:
                            key = key << 16 | sigs[:, part, at]
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nodes)], ["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that can be similar enough by set size and marks, with the marks that differ."""
    one, two = (classes.select(F.col("node").alias(c), F.col("size").alias("n_" + c), F.col("marks").alias("m_" + c)) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, MARKS) for c in (2, 3))
            far = (x != y).sum(axis=1).astype(np.int64)
            near = pa.array(far <= COMPARE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near), pa.array(far).filter(near)], ["a", "b", "far"])

    both = pairs.join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {SIMILAR} * greatest(n_a, n_b)")
    return both.select("a", "b", "m_a", "m_b").mapInArrow(run, "a long, b long, far long")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last = set_b = None
            for a, b, words_a, words_b in rows_of(batches):
                if b != last:
                    last, set_b = b, shingle_set(words_b)
                set_a = shingle_set(words_a)
                both = len(set_a & set_b)
                if 100 * both >= SIMILAR * (len(set_a) + len(set_b) - both):
                    yield a, b

        return batches_of(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    one, two = (texts.select(F.col("node").alias(c), F.col("words").alias("words_" + c)) for c in "ab")
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "words_a", "words_b")
    return both.mapInArrow(run, "a long, b long")


def _open_members(met: DataFrame, classes: DataFrame, roots: DataFrame, inside: bool) -> DataFrame:
    """The members of buckets that hold several components, dealt over blocks (`inside`) or over pairs of different blocks."""
    labelled = met.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    if not inside:
        labelled = labelled.where(F.col("n") > BLOCK)
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    out = labelled.join(mixed.select("key"), "key").join(classes.select("node", "size", "marks", "sig"), "node")
    out = out.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    out = out.withColumn("own", F.expr("pmod(xxhash64(node), blocks)").cast("int"))
    if inside:
        out = out.withColumn("other", F.col("own"))
    else:
        out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own != other")
    return out.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *MEMBER)


def _first_met(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The position of the first key that a signature shares with each of the others."""
    equal = (own == others).reshape(-1, PARTS, WIDTH)
    shared = equal.sum(axis=2, keepdims=True) - equal == WIDTH - 1  # all but the position left out
    return shared.reshape(-1, _POSITIONS).argmax(axis=1)


#: What a bucket knows of a member.
MEMBER = ("node", "root", "own", "size", "marks", "sig")
_MEMBERS = "key long, i int, j int, node long, root long, own int, size long, marks binary, sig binary"
MEMBERS = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("root", pa.int64()), ("own", pa.int32()), ("size", pa.int64()), ("marks", pa.binary()), ("sig", pa.binary())])


class _Group:
    """The members of a bucket, or of a pair of its blocks, of which only pairs from both sides are compared."""

    def __init__(self, key: int, i: int, j: int, held: list[tuple]):
        self.key, self.apart = key, i != j
        self.node, self.root, self.own, self.size = (np.array([r[c] for r in held]) for c in (3, 4, 5, 6))
        self.marks = np.frombuffer(b"".join(r[7] for r in held), np.uint8).reshape(-1, MARKS)
        self.sigs = np.frombuffer(b"".join(r[8] for r in held), "<u2").reshape(-1, _POSITIONS)

    def near(self, n: int) -> np.ndarray:
        """Later members of other components that are near member n by size and marks, the nearest first.

        Nodes that meet in several buckets are near in the first one alone.
        """
        ok = self.root != self.root[n]
        ok[: n + 1] = False
        ok &= 100 * np.minimum(self.size, self.size[n]) >= SIMILAR * np.maximum(self.size, self.size[n])
        if self.apart:
            ok &= self.own != self.own[n]
        spots = np.flatnonzero(ok)
        if len(spots):
            spots = spots[_first_met(self.sigs[n], self.sigs[spots]) == self.key >> 16 * (WIDTH - 1)]
        if not len(spots):
            return spots
        far = (self.marks[spots] != self.marks[n]).sum(axis=1)
        order = np.argsort(far, kind="stable")
        return spots[order[far[order] <= COMPARE]]


def _touched(members: DataFrame) -> DataFrame:
    """The members that are near another one of their bucket or pair of blocks: only their texts are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for at, group in groupby(rows_of(batches), key=lambda r: r[:3]):
                held = list(group)
                if len(held) < 2:
                    continue
                found, near = _Group(*at, held), np.zeros(len(held), bool)
                for n in range(len(held)):
                    spots = found.near(n)
                    near[spots] = True
                    near[n] |= len(spots) > 0
                yield from (held[n] for n in np.flatnonzero(near))

        return batches_of(rows(), MEMBERS)

    dealt = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, _MEMBERS)


def _links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components that meet in a bucket, confirmed on the full sets.

    Texts are compared where they meet, and only while no link found there has
    joined their components: a group gives fewer links than it has members,
    however many of its pairs are near and however few of those are links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for at, group in groupby(rows_of(batches), key=lambda r: r[:3]):
                held = list(group)
                found, sets, kept = _Group(*at, held), {}, 0

                def shingles(n):
                    nonlocal kept
                    if n not in sets:
                        if kept > HELD:
                            sets.clear()
                            kept = 0
                        sets[n] = shingle_set(held[n][9])
                        kept += len(sets[n])
                    return sets[n]

                for n in range(len(held)):
                    for m in found.near(n).tolist():
                        if found.root[m] == found.root[n]:
                            continue
                        one, two = shingles(n), shingles(m)
                        both = len(one & two)
                        if 100 * both >= SIMILAR * (len(one) + len(two) - both):
                            found.root[found.root == found.root[m]] = found.root[n]
                            yield int(found.node[n]), int(found.node[m])

        return batches_of(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    dealt = members.join(texts, "node").select("key", "i", "j", *MEMBER, "words")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _best(pairs: DataFrame) -> DataFrame:
    """The nearest partner of each a."""
    best = pairs.groupBy("a").agg(F.min(F.struct("far", "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"))


def _merge(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after further links between the components."""
    for c in "ab":
        known = roots.select(F.col("node").alias(c), F.col("root").alias("root_" + c))
        links = links.join(known, c, "left").withColumn("top_" + c, F.coalesce("root_" + c, c)).drop("root_" + c)
    links = landed(links, "links")
    more = components(links.select(F.col("top_a").alias("a"), F.col("top_b").alias("b")))
    more = more.select(F.col("node").alias("old"), F.col("root").alias("top"))
    fresh = links.select(F.col("a").alias("node"), F.col("top_a").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("top_b").alias("root")))
    every = roots.unionByName(fresh).distinct().join(more, F.col("root") == F.col("old"), "left")
    return landed(every.select("node", F.coalesce("top", "root").alias("root")), "roots")


def link(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of (doc_id, text).

    Texts with the same words are one class, compared once.  In each bucket the
    members are first held against one of them; buckets whose members are then not
    all connected have every pair across components compared, first inside blocks
    and then between them, so no link that could join two components is left out.

    A text without words, or a null one, has no shingles and its own id as
    component.  A row with a null id takes part in linking but never names a
    component and is not kept; a component of such rows alone has a null id.
    Repeated rows get equal results; other columns are ignored; an empty table
    gives no rows.
    """
    # signatures are the bulk of what is written: they are kept by class alone, not by row
    classes = signed(documents).groupBy("class").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("marks").alias("marks"), F.first("n").alias("size"))
    classes = landed(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    met = keys(classes)
    buckets = met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = landed(met.join(buckets, "key").select("key", "node", "n"), "buckets")
    # the text that most others share keys with leads: of a family of edits that is what they were made from
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    leaders = met.join(weight, "node").groupBy("key").agg(F.max(F.struct(F.col("weight"), (-F.col("node")).alias("m"))).alias("best"))
    leaders = leaders.select("key", (-F.col("best.m")).alias("leader"))
    nodes = met.select("node").distinct().join(classes.select("node", "class", "id"), "node")
    rows = documents.select("doc_id", plain(F.col("text")).alias("words")).withColumn("class", F.unhex(F.md5("words")))
    source = rows.withColumnRenamed("doc_id", "id")
    same = F.col("s.class").eqNullSafe(F.col("n.class")) & F.col("s.id").eqNullSafe(F.col("n.id"))
    texts = landed(source.alias("s").join(nodes.alias("n"), same).select("node", "words"), "bucket-texts")
    if not texts.isEmpty():
        texts = texts.dropDuplicates(["node"]) if texts.count() != texts.select("node").distinct().count() else texts

    stars = met.join(leaders, "key").where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    tried = landed(_best(_near(stars, classes)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = confirm(tried, texts)
    roots = landed(components(links), "star-roots")
    for inside in (True, False):
        near = landed(_touched(_open_members(met, classes, roots, inside)), "near")
        roots = _merge(roots, _links(near, texts))
    roots = classes.select("class", "node", "id", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = roots.groupBy("root").agg(F.min("id").alias("component"))
    named = roots.join(names, "root").select("class", "component", "size")
    out = rows.select("doc_id", "class").join(named, "class", "left")
    component = F.when(F.col("size").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.coalesce("size", F.lit(0).cast("long")).alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
