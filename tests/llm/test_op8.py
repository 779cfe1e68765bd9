from __future__ import annotations

import hashlib

import public_tokenizers as vocabularies
import pytest
import tiktoken
from fixtures import awkward, docs_frame
from hypothesis import given, settings
from hypothesis import strategies as st

from ruleweave.llm import byte_pairs

PATH = vocabularies.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return byte_pairs.Coder(byte_pairs.read_ranks(PATH), vocabularies.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=vocabularies.PATTERN, mergeable_ranks=byte_pairs.read_ranks(PATH), special_tokens={})


def test_perfect_hash():
    for n in (0, 1, 2, 5, 1000):
        keys = [f"k{i}".encode() for i in range(n)]
        table = byte_pairs.PerfectHash(keys)
        assert sorted(table.find(k) for k in keys) == list(range(n))
        assert all(table.find(f"x{i}".encode()) == -1 for i in range(100))


@given(st.text(st.one_of(st.sampled_from("aeb  \n\t'sll12., \x85\x1c"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=1500, deadline=None)
def test_against_the_library(coder, library, text):
    ids = coder.encoder()(text)
    assert ids == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_every_character(coder, library):
    encode = coder.encoder()
    for start in range(0, 0x30000, 64):
        text = "".join(f"a{chr(c)}b {chr(c)}1 " for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert encode(text) == library.encode_ordinary(text)


def test_small_memory_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(coder, "chunks", byte_pairs.Memory(3))
    monkeypatch.setattr(coder, "pieces", byte_pairs.Memory(2))
    encode = coder.encoder()
    for _, text, _ in awkward():
        assert encode(text or "") == library.encode_ordinary(text or "")


def test_round_trip(spark, sf_dir, library):
    rows = awkward() + [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in byte_pairs.round_trip(docs_frame(spark, rows), PATH, vocabularies.PATTERN).collect()]
    want = []
    for d, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        digests = (",".join(map(str, ids)).encode(), (t or "").encode())
        want.append((d, len(ids), *(hashlib.sha256(x).hexdigest() for x in digests)))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert byte_pairs.round_trip(docs_frame(spark, []), PATH, vocabularies.PATTERN).count() == 0
