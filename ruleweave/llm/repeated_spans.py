"""Removal of passages that repeat across documents, exact to the byte.

Every 50-byte window names an anchor, the 24-byte string inside it with the least
hash; equal windows name equal anchors, and the snippet of all windows in a row
that name one occurrence is digested.  Anchors with one snippet everywhere are
settled by the smallest document that holds them, without moving any text.  For
anchors with several snippets, as at the edges of passages, the snippets go to
the anchor's group, equal ones once; a suffix order over the group's snippets
finds the equal windows and the smallest document of each.

Snippets of one anchor lie alike around it, so the suffix order runs over
five-byte symbols counted from the anchor, and the few bytes of a window outside
whole symbols are compared with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import batches_of, landed, rows_of
from ruleweave.llm.suffix_order import suffix_order

LENGTH, GRAM, SYMBOL = 50, 24, 5
REACH = LENGTH - GRAM + 1
#: Bytes of text in one cell of documents, and anchors in one range of hashes, that a task works on together.
CELL_BYTES, RANGE_ANCHORS = 4 << 20, 200_000
#: Anchors that a task gathers before it sorts them and passes them on.
GATHERED = 250_000
#: Starts worked on in one go inside a long text.
STRETCH = 1 << 18
#: Symbols of one suffix order.
BATCH = 20_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFF)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    factors = np.full((2, STRETCH + LENGTH), [[int(_C1)], [pow(int(_C1), -1, 1 << 64)]], np.uint64)
    factors[:, 0] = 1
    return tuple(np.cumprod(factors, axis=1, dtype=np.uint64))


def anchors(text: np.ndarray) -> tuple[np.ndarray, ...]:
    """48-bit anchor hash, anchor place, first and last window start and 48-bit snippet digest for each run of windows of one anchor."""
    found = [_stretch(text[s : s + STRETCH + LENGTH - 1], s) for s in range(0, max(0, len(text) - LENGTH + 1), STRETCH)]
    if not found:
        return tuple(np.empty(0, np.uint64 if k in (0, 4) else np.int64) for k in range(5))
    return tuple(np.concatenate(x) for x in zip(*found))


def _stretch(text: np.ndarray, base: int) -> tuple:
    x = text.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    h = x[:-16] * _C1
    h ^= h >> np.uint64(31)
    h += x[8:-8]
    h *= _C2
    h ^= h >> np.uint64(29)
    h += x[16:]
    h *= _C1
    h ^= h >> np.uint64(32)
    h *= _C2
    h ^= h >> np.uint64(30)
    least = h & ~_LOW
    least |= _LOW - np.arange(len(h), dtype=np.uint64)  # of equal hashes the rightmost
    size = 1
    while size * 2 <= REACH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < REACH:
        least = np.minimum(least[: len(least) - (REACH - size)], least[REACH - size :])
    place = (_LOW - (least & _LOW)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    up, down = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    digest = (sums[last + REACH] - sums[first]) * down[first]
    digest ^= digest >> np.uint64(32)
    digest *= _C2
    digest ^= digest >> np.uint64(29)
    digest *= _C1
    return h[at] >> np.uint64(16), at + base, first + base, last + base, digest >> np.uint64(16)


def _pack(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """The low bytes of each column, one column behind the other."""
    return b"".join(np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :w].tobytes() for c, w in zip(columns, widths))


def _unpack(blobs: list[bytes], widths: list[int]) -> list[np.ndarray]:
    """The columns of packed blobs, joined."""
    out = []
    for k, width in enumerate(widths):
        before, row = sum(widths[:k]), sum(widths)
        raw = b"".join(b[len(b) // row * before : len(b) // row * (before + width)] for b in blobs)
        wide = np.zeros((len(raw) // width, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
        out.append(wide.view("<u8").reshape(-1))
    return out


BLOBS = pa.schema([("part", pa.int64()), ("blob", pa.binary())])
#: Bytes that the number of a cell takes.
CELL = 4


def _all_anchors(rows: DataFrame, bits: int, low: int, width: int) -> DataFrame:
    """(part, blob): anchor hash, snippet digest, document and cell, gathered by range of hashes.

    Documents are counted from ``low`` and take ``width`` bytes.  Of an anchor with
    one digest in many documents of a cell the smallest and the largest say enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs():
            held, size = [], 0
            for cell, doc, text in rows_of(batches):
                h, _, _, _, digest = anchors(np.frombuffer((text or "").encode("utf-8"), np.uint8))
                if len(h):
                    held.append((h, digest, np.full(len(h), doc - low, np.uint64), np.full(len(h), cell, np.int64)))
                    size += len(h)
                if size >= GATHERED:
                    yield from flush(held)
                    held, size = [], 0
            if size:
                yield from flush(held)

        def flush(held):
            h, digest, doc, c = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, c, digest, h))
            h, digest, doc, c = h[order], digest[order], doc[order], c[order]
            new = (h[1:] != h[:-1]) | (digest[1:] != digest[:-1]) | (c[1:] != c[:-1])
            first, last = np.append(True, new), np.append(new, True)
            keep = first | last
            h, digest, doc, c = h[keep], digest[keep], doc[keep], c[keep]
            part = (h >> np.uint64(48 - bits)).astype(np.int64)
            edges = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(h)]):
                yield int(part[a]), _pack([h[a:b], digest[a:b], doc[a:b], c[a:b]], [6, 6, width, CELL])

        return batches_of(blobs(), BLOBS, most=20_000)

    return rows.select("cell", "doc_id", "text").mapInArrow(run, "part long, blob binary")


def _repeated(blobs: DataFrame, width: int) -> DataFrame:
    """(cell, settled, open): what each cell must know of anchors that stand in two documents or more.

    Settled ones have one snippet; they come with the smallest document, to cells
    that hold them in a larger one.  Open ones have several snippets.
    """

    def run(table: pa.Table) -> pa.Table:
        h, digest, doc, c = _unpack(table.column("blob").to_pylist(), [6, 6, width, CELL])
        c = c.astype(np.int64)
        order = np.argsort(h, kind="stable")
        h, digest, doc, c = h[order], digest[order], doc[order], c[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        if not len(first):
            return pa.table({"cell": pa.array([], pa.int64()), "settled": pa.array([], pa.binary()), "open": pa.array([], pa.binary())})
        times = np.diff(np.append(first, len(h)))
        least = np.repeat(np.minimum.reduceat(doc, first), times)
        twice = least < np.repeat(np.maximum.reduceat(doc, first), times)
        one = np.repeat(np.minimum.reduceat(digest, first) == np.maximum.reduceat(digest, first), times)
        told: dict[int, list[bytes | None]] = {}
        for k, keep in enumerate((twice & one & (least < doc), twice & ~one)):
            own, owner, at = h[keep], least[keep], c[keep]
            order = np.lexsort((own, at))
            own, owner, at = own[order], owner[order], at[order]
            fresh = np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1]))[: len(own)]
            own, owner, at = own[fresh], owner[fresh], at[fresh]
            edges = (np.flatnonzero(np.diff(at)) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, len(own)]) if len(own) else ():
                blob = _pack([own[a:b]], [6]) if k else _pack([own[a:b], owner[a:b]], [6, width])
                told.setdefault(int(at[a]), [None, None])[k] = blob
        settled, still = zip(*told.values()) if told else ((), ())
        return pa.table({"cell": pa.array(list(told), pa.int64()), "settled": pa.array(settled, pa.binary()), "open": pa.array(still, pa.binary())})

    return blobs.groupBy("part").applyInArrow(run, "cell long, settled binary, open binary")


SNIPPETS = pa.schema(
    [("row", pa.int64()), ("hash", pa.int64()), ("sid", pa.int64()), ("at", pa.int32()), ("lo", pa.int64()), ("bytes", pa.binary()), ("doc_id", pa.int64()), ("last", pa.int64()), ("digest", pa.binary()), ("spans", pa.binary())]
)
_SNIPPETS = "row long, hash long, sid long, at int, lo long, bytes binary, doc_id long, last long, digest binary, spans binary"


def _merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Spans of window starts with those put together whose bytes touch or overlap."""
    gap = np.flatnonzero(lo[1:] > hi[:-1] + LENGTH)
    return np.stack([lo[np.append(0, gap + 1)], hi[np.append(gap, len(hi) - 1)]], axis=1) if len(lo) else np.empty((0, 2), np.int64)


def _noted(texts: list[tuple], places: list[tuple]) -> pa.Table:
    """The table of `_snippets` for one cell: texts, places of open anchors, and each of their snippets once."""
    rows, whole, docs, digests, spans = zip(*texts) if texts else ((),) * 5
    h, sid, own = (np.concatenate(x, axis=-1) for x in zip(*places)) if places else (np.empty(0, np.int64),) * 2 + (np.empty((6, 0), np.int64),)
    order = np.lexsort((own[1], sid, h))
    new = (np.diff(h[order]) != 0) | (np.diff(sid[order]) != 0)
    first, last = order[np.append(True, new)[: len(h)]], order[np.append(new, True)[: len(h)]]
    bytes_ = [whole[t][a : a + n + LENGTH] for t, a, n in zip(*own[[2, 3, 5]][:, first].tolist())]
    parts = [
        {"row": rows, "bytes": whole, "doc_id": docs, "digest": digests, "spans": spans},
        {"row": own[0], "hash": h, "sid": sid, "lo": own[3], "doc_id": own[1]},
        {"hash": h[first], "sid": sid[first], "at": own[4][first], "bytes": bytes_, "doc_id": own[1][first], "last": own[1][last]},
    ]
    sizes = [len(rows), len(h), len(first)]
    columns = [pa.concat_arrays([pa.array(p[f.name], f.type) if f.name in p else pa.nulls(n, f.type) for p, n in zip(parts, sizes)]) for f in SNIPPETS]
    return pa.table(columns, schema=SNIPPETS)


def _snippets(rows: DataFrame, notes: DataFrame, low: int, width: int) -> DataFrame:
    """Texts that share an anchor with others, and the snippets of open anchors.

    Text rows have a digest of the text, and the spans that settled anchors give.
    Rows of snippets hold the bytes, each snippet once a cell, with the cell's
    smallest and largest document; rows of places have a row and no bytes.  Copies
    of a smaller document are left out, as all of their bytes go anyway.  notes are
    (cell, doc_id, digest, settled, open): anchors, and copies by id and digest.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        settled, owner = _unpack([b for b in right.column("settled").to_pylist() if b is not None], [6, width])
        (still,) = _unpack([b for b in right.column("open").to_pylist() if b is not None], [6])
        order = np.argsort(settled)
        settled, owner, still = settled[order], owner[order], np.sort(still)
        copies = {(d, g) for d, g in zip(right.column("doc_id").to_pylist(), right.column("digest").to_pylist()) if g is not None}
        copied = {d for d, _ in copies}
        texts, places = [], []
        ids, cells = left.column("doc_id").to_pylist(), left.column("cell").to_pylist()
        for number, (doc, cell) in enumerate(zip(ids, cells) if len(settled) or len(still) else ()):
            text = (left.column("text")[number].as_py() or "").encode("utf-8")
            if len(text) < LENGTH:
                continue
            if doc in copied and (doc, hashlib.md5(text, usedforsecurity=False).digest()) in copies:
                continue
            h, at, lo, hi, sid = anchors(np.frombuffer(text, np.uint8))
            gone = open_ = np.zeros(len(h), bool)
            if len(settled):
                spot = np.minimum(np.searchsorted(settled, h), len(settled) - 1)
                gone = (settled[spot] == h) & (owner[spot] < np.uint64(doc - low))
            if len(still):
                open_ = still[np.minimum(np.searchsorted(still, h), len(still) - 1)] == h
            if not (gone.any() or open_.any()):
                continue
            row = cell << 24 | number
            if open_.any():
                own = np.stack([np.full(int(open_.sum()), v) for v in (row, doc, len(texts))] + [lo[open_], at[open_] - lo[open_], hi[open_] - lo[open_]])
                places.append((h[open_].astype(np.int64), sid[open_].astype(np.int64), own.astype(np.int64)))
            digest = hashlib.md5(text, usedforsecurity=False).digest()
            texts.append((row, text, doc, digest, _merged(lo[gone], hi[gone]).astype("<i8").tobytes()))
        return _noted(texts, places)

    both = rows.select("cell", "doc_id", "text").groupBy("cell").cogroup(notes.groupBy("cell"))
    return both.applyInArrow(run, _SNIPPETS)


def owners(snippets: list[tuple[bytes, int, int]]) -> list[list[int]]:
    """For each window of each (snippet, anchor place, smallest document) the smallest document with an equal window."""
    text, where, numbers = [], [], {}
    for snippet, at, _ in snippets:
        shift = at % SYMBOL
        where.append((len(text), shift))
        for k in range(shift, len(snippet) - SYMBOL + 1, SYMBOL):
            text.append(numbers.setdefault(snippet[k : k + SYMBOL], len(numbers) + 1))
        text.append(0)
    whole = LENGTH // SYMBOL
    full, part = [0] * len(text), [0] * len(text)  # numbers of equal runs of whole and whole - 1 symbols
    last, f, p = None, 0, 0
    for i in suffix_order(text):
        own = text[i : i + whole]
        if own != last:
            f += 1
            if last is None or own[:-1] != last[: whole - 1] or len(own) != len(last):
                p += 1
            last = own
        full[i], part[i] = f, p
    least: dict[tuple, int] = {}
    keys = []
    for (snippet, _, doc), (base, shift) in zip(snippets, where):
        own = []
        for s in range(len(snippet) - LENGTH + 1):
            lead = (shift - s) % SYMBOL
            symbol = base + (s + lead - shift) // SYMBOL
            if lead:
                key = (part[symbol], snippet[s : s + lead], snippet[s + lead + LENGTH - SYMBOL : s + LENGTH])
            else:
                key = (full[symbol],)
            own.append(key)
            if least.get(key, doc) >= doc:
                least[key] = doc
        keys.append(own)
    return [[least[k] for k in own] for own in keys]


def _alike(group: list[tuple]) -> tuple[list[int], list[int]]:
    """Numbers of a group's snippets that may share a window with another one, and of the rest.

    A window of this length holds either the bytes from its anchor on, or those
    from half of the rest before it, as far as every such window reaches.
    """
    half = (REACH - 1) // 2
    seen: dict[tuple, list[int]] = {}
    for n, r in enumerate(group):
        snippet, at = r[3], r[2]
        if len(snippet) >= at + LENGTH - half:
            seen.setdefault((0, snippet[at : at + LENGTH - half]), []).append(n)
        if at > half:
            seen.setdefault((1, snippet[at - half - 1 : at + GRAM]), []).append(n)
    shared = {n for own in seen.values() if len(own) > 1 for n in own}
    return sorted(shared), [n for n in range(len(group)) if n not in shared]


OWNED = pa.schema([("hash", pa.int64()), ("sid", pa.int64()), ("from", pa.int32()), ("to", pa.int32()), ("owner", pa.int64())])


def _owned(distinct: DataFrame) -> DataFrame:
    """(hash, sid, from, to, owner): runs of windows of a snippet that a smaller document has too.

    Rows are distinct snippets (hash, sid, at, bytes) with the first and last
    document that holds them, dealt by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(r, docs):
            a = 0
            for b in range(1, len(docs) + 1):
                if b == len(docs) or docs[b] != docs[a]:
                    if docs[a] < r[5]:
                        yield r[0], r[1], a, b - 1, docs[a]
                    a = b

        def sort(held):
            for r, docs in zip(held, owners([(r[3], r[2], r[4]) for r in held])):
                yield from runs(r, docs)

        def rows():
            held, size = [], 0
            for _, group in groupby(rows_of(batches), key=lambda r: r[0]):
                group = list(group)
                shared, alone = _alike(group) if len(group) > 1 else ((), (0,))
                for n in alone:
                    r = group[n]
                    if r[4] < r[5]:
                        yield r[0], r[1], 0, len(r[3]) - LENGTH, r[4]
                held += [group[n] for n in shared]
                size += sum(len(group[n][3]) // SYMBOL for n in shared)
                if size >= BATCH:
                    yield from sort(held)
                    held, size = [], 0
            if held:
                yield from sort(held)

        return batches_of(rows(), OWNED, most=20_000)

    dealt = distinct.sortWithinPartitions("hash").select("hash", "sid", "at", "bytes", "first", "last")
    return dealt.mapInArrow(run, "hash long, sid long, from int, to int, owner long")


REMOVED = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("left", pa.binary()), ("text", pa.string())])


def _cut(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts without the bytes their spans cover; `text` also keeps the rest of cut characters whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc, digest, text, own, listed in rows_of(batches):
                steps = np.zeros(len(text) + 1, np.int64)
                for lo, hi in np.frombuffer(own, "<i8").reshape(-1, 2).tolist():
                    steps[lo] += 1
                    steps[hi + LENGTH] -= 1
                for span in listed or ():
                    steps[span["lo"]] += 1
                    steps[span["hi"] + LENGTH] -= 1
                gone = np.cumsum(steps[:-1]) > 0
                if not gone.any():
                    continue
                data = np.frombuffer(text, np.uint8)
                edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                head = (data & 0xC0) != 0x80  # a character goes if all of its bytes do
                starts = np.flatnonzero(head)
                lost = np.repeat(np.logical_and.reduceat(gone, starts), np.diff(np.append(starts, len(data))))
                yield doc, digest, int(gone.sum()), edges, hashlib.sha256(data[~gone].tobytes()).digest(), data[~lost].tobytes().decode("utf-8")

        return batches_of(rows(), REMOVED)

    listed = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("listed"))  # at most a text's own windows
    both = texts.join(listed, "row", "left").select("doc_id", "digest", "bytes", "spans", "listed")
    return both.mapInArrow(run, "doc_id long, digest binary, n_removed long, n_spans long, left binary, text string")


def find(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Size and digests of every row, copies that go altogether, and texts that lose passages."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_bytes = F.octet_length(text).cast("long")
    facts = documents.select("doc_id", F.unhex(F.md5(text)).alias("digest"), n_bytes.alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("whole"))
    facts = landed(facts, "span-facts")
    total, low, high = facts.agg(F.sum("n_bytes"), F.min("doc_id"), F.max("doc_id")).first()
    total, low, high = total or 0, low or 0, high or 0
    width = max(1, ((high - low).bit_length() + 7) // 8)
    cells = max(64, total // CELL_BYTES)
    bits = max(4, int(total * 2 // (REACH + 1) // RANGE_ANCHORS).bit_length())
    cell = F.expr(f"pmod(xxhash64(doc_id, coalesce(text, '')), {cells})").alias("cell")
    rows = documents.where("doc_id is not null").select("doc_id", "text", cell)

    first = facts.where(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = first.where("first < last").select("digest", "first")
    copies = landed(facts.join(first, "digest").where("first < doc_id").select("doc_id", "digest").distinct(), "span-copies")
    keyed = documents.select("doc_id", cell, F.unhex(F.md5(text)).alias("digest"))
    nothing = F.lit(None).cast("binary")
    noted = keyed.join(copies, ["doc_id", "digest"], "left_semi").select("cell", "doc_id", "digest", nothing.alias("settled"), nothing.alias("open"))
    known = landed(_repeated(_all_anchors(rows, bits, low, width), width), "anchors")  # and the shuffle of all anchors goes
    known = known.select("cell", F.lit(None).cast("long").alias("doc_id"), nothing.alias("digest"), "settled", "open")
    found = landed(_snippets(rows, known.unionByName(noted), low, width), "snippets")

    # dealt by anchor once: cells have put equal snippets together already
    snippets = found.where("row is null").select("hash", "sid", "at", "bytes", "doc_id", "last").repartition("hash")
    distinct = snippets.groupBy("hash", "sid", "at", "bytes").agg(F.min("doc_id").alias("first"), F.max("last").alias("last"))
    owned = landed(_owned(distinct), "owned")
    places = found.where("row is not null and hash is not null").select("hash", "sid", "row", "lo", "doc_id")
    places = places.join(owned, ["hash", "sid"]).where("owner < doc_id")
    spans = places.select("row", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi"))
    changed = _cut(found.where("hash is null").select("row", "doc_id", "digest", "bytes", "spans"), spans)
    return facts, copies, landed(changed, "cut-texts")


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of (doc_id, text).

    A null text is empty and loses nothing, like one of under 50 bytes.  A row
    with a null id has no order, so it loses nothing and takes nothing.  Repeated
    rows get equal results; other columns are ignored; an empty table gives no rows.
    """
    facts, copies, changed = find(documents)
    changed = changed.select("doc_id", "digest", "n_removed", "n_spans", "left").distinct()
    gone = copies.select("doc_id", "digest", F.lit(True).alias("gone"))
    out = facts.join(gone, ["doc_id", "digest"], "left").join(changed, ["doc_id", "digest"], "left")
    nothing = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("gone"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.lower(F.hex(F.when(F.col("gone"), nothing).otherwise(F.coalesce("left", "whole")))).alias("kept_sha256"),
    )


def remove(documents: DataFrame) -> DataFrame:
    """The documents with repeated passages cut from `text`; other columns stay.

    A character goes only if all of its bytes are covered.  Texts that lose all
    they had are dropped; texts that were empty before stay.
    """
    _, copies, changed = find(documents)
    changed = changed.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), F.col("text").alias("_text")).distinct()
    gone = copies.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), F.lit("").alias("_text"))
    same = (F.col("doc_id") == F.col("_doc")) & (F.unhex(F.md5("text")) == F.col("_digest"))
    out = documents.join(changed.unionByName(gone), same, "left").where("_text is null or _text != ''")
    return out.withColumn("text", F.coalesce("_text", "text")).drop("_doc", "_digest", "_text")
