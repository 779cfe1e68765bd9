from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as vocabularies
from fixtures import awkward, docs_frame
from tokenizers import Tokenizer

from ruleweave.llm import token_files

PATH = vocabularies.path("byte_bpe_50k.json")


def test_grammar_round_trip():
    rng = np.random.default_rng(4)
    for n, kinds in ((0, 1), (1, 1), (9, 1), (500, 1), (501, 2), (5000, 3), (30000, 200)):
        ids = rng.integers(3, 3 + kinds, n).astype(np.uint32)
        rules, lengths, seq = token_files.compress(ids)
        assert (token_files.expand(seq, rules) == ids).all()
        for k, (pair, size) in enumerate(zip(rules, lengths)):
            assert len(token_files.expand(pair, rules)) == size and pair.max() < token_files.FIRST + k
        if n == 5000:
            assert len(rules) and len(seq) < n / 2


def test_random_access():
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(1, 90, 40)]
    # the end id also occurs inside documents
    ids = np.concatenate([np.append(np.tile([7, 8, 2, 9, 10], 30)[: s - 1], 2) for s in sizes]).astype(np.uint32)
    block = token_files.Block(token_files.pack([None, *range(39)], sizes, ids))
    at = 0
    assert block.doc_ids == [None, *range(39)] and len(block.rules) and block.sizes.tolist() == sizes
    assert (block.all_ids() == ids).all() and block.n_ids == len(ids)
    for n, size in enumerate(sizes):
        assert (block.document(n) == ids[at : at + size]).all()
        at += size


def test_no_pair_that_pays_is_left():
    rng = np.random.default_rng(6)
    ids = rng.zipf(1.3, 60_000).clip(max=900).astype(np.uint32) + 3
    ids[:: 97] = 2
    rules, _, seq = token_files.compress(ids)
    pairs = {}
    skip = False
    for a, b in zip(seq[:-1].tolist(), seq[1:].tolist()):
        if 2 in (a, b) or (a == b and skip):
            skip = False
            continue
        pairs[a, b] = pairs.get((a, b), 0) + 1
        skip = a == b
    assert max(pairs.values()) < token_files.LEAST
    assert 2 not in rules and (token_files.expand(seq, rules) == ids).all()


def test_packed_numbers():
    rng = np.random.default_rng(8)
    for bits in (1, 3, 8, 17, 33, 57):
        numbers = rng.integers(0, 1 << bits, 70_001, dtype=np.uint64)
        data = memoryview(token_files._packed(numbers, bits))
        assert len(data) == -(-len(numbers) * bits // 8)
        for a, b in ((0, len(numbers)), (65_530, 65_550), (5, 5), (13, 14)):
            assert (token_files._unpacked(data, bits, a, b) == numbers[a:b]).all()


def test_smaller_than_sixteen_bits(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blocks = token_files.write_blocks(documents, PATH).collect()
    assert sum(len(b["payload"]) for b in blocks) < 2 * sum(b["n_ids"] for b in blocks)


def test_fetch(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    blocks = token_files.write_blocks(docs_frame(spark, awkward()), PATH)
    tokenizer = Tokenizer.from_file(PATH)
    texts = {d: t for d, t, _ in awkward()}
    found = {r["doc_id"]: r["ids"] for r in token_files.fetch(blocks, [7, 2, 18, 404]).collect()}
    assert found == {d: [*tokenizer.encode(texts[d], add_special_tokens=False).ids, 2] for d in (7, 2, 18)}


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 5000)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(1000 + d, t, s) for d, t, s in awkward()[:-1] if d is not None] + [(9999, "<|endoftext|> x", "a")]
    got = [tuple(r) for r in token_files.round_trip(docs_frame(spark, rows), PATH).collect()]
    assert sorted(got) == brute(sorted((d, t) for d, t, _ in rows))
    assert token_files.round_trip(docs_frame(spark, []), PATH).count() == 0


def test_ties_and_null_ids(spark):
    rows = awkward()
    got = [tuple(r) for r in token_files.round_trip(docs_frame(spark, rows), PATH).collect()]
    want = brute([(d, t) for d, t, _ in rows])
    assert sorted(map(repr, [(d, n, c) for d, _, n, c in got])) == sorted(map(repr, [(d, n, c) for d, _, n, c in want]))
    place = 0
    for d, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == place
        place += n
    order = [d for d, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
