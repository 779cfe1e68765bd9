from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
from fixtures import awkward, docs_frame
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ruleweave.llm import chunks, queries, trie_bpe

PATH = vocabularies.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", " x", "x ", "a  b \n c ", "   \n\t", "don't we'll  's", "<|endoftext|>", " <|endoftext|> ", "a \n<|endoftext|>\n b",
    "x<|endoftext|><|endoftext|>y z", "<|endoftext", "՘ a՘b 1՘", "\x85  \x1c  x", "aaaa" * 50, " " * 300 + "x", "ab" * 500,
]


@pytest.fixture(scope="module")
def vocabulary():
    return trie_bpe.Vocabulary(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def walker(vocabulary):
    return trie_bpe.Walker(vocabulary)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(walker, texts):
    ends, data = walker.chunks.encode(pa.array(texts, pa.string()))
    found, ends = np.frombuffer(data, chunks.IDS).tolist(), ends.tolist()
    return [found[a:b] for a, b in zip(ends, ends[1:])]


def expected(library, texts):
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_every_token_is_reached(vocabulary):
    assert len(vocabulary.reached) == 50256


def test_odd_texts(walker, library):
    assert ids(walker, ODD) == expected(library, ODD)
    assert ids(walker, [" ".join(t or "" for t in ODD)]) == expected(library, [" ".join(t or "" for t in ODD)])


PIECES = ["a", "e", " ", "  ", "\n", "'s", "ll", "1", ".", "--", "\x85", "\x1c", "é", "東", "<|endoftext|>", "th", "ing", "tion"]


@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(codec="utf-8")), max_size=25).map("".join), max_size=4))
@settings(max_examples=1500, deadline=None)
def test_against_the_library(walker, library, texts):
    assert ids(walker, texts) == expected(library, texts)


@given(st.lists(st.text("aeinrst", min_size=1, max_size=40).map(str.encode), min_size=1, max_size=30, unique=True))
@settings(max_examples=300, deadline=None)
def test_words_share_prefixes(walker, library, words):
    got = walker.words(sorted(words))
    assert [np.frombuffer(g, chunks.IDS).tolist() for g in got] == expected(library, [w.decode() for w in sorted(words)])


def test_every_character(walker, library):
    for start in range(0, 0x32000, 4096):
        named = [chr(c) for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000]
        texts = ["".join(f"a{c}1{c}. {c}b " for c in named[i : i + 64]) for i in range(0, len(named), 64)]
        assert ids(walker, texts) == expected(library, texts)


def test_small_memories_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(trie_bpe, "WORDS", 3)
    monkeypatch.setattr(trie_bpe, "PAIRS", 2)
    monkeypatch.setattr(trie_bpe, "CHUNKS", 2)
    walker = trie_bpe.Walker(vocabulary)
    for _, text, _ in awkward():
        assert ids(walker, [text]) == expected(library, [text])


def test_long_words_and_texts(walker, library):
    texts = ["xyz" * 100_000, "amber birch, " * 100_000, "\t" * 50_000]
    assert ids(walker, texts) == expected(library, texts)


def test_other_vocabularies_are_refused(vocabulary):
    import json

    named = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"model": named["model"] | {"ignore_merges": True}}, {"pre_tokenizer": None}):
        with pytest.raises(ValueError):
            trie_bpe.Vocabulary(json.dumps(named | change))


def test_table(spark, sf_dir, library, monkeypatch):
    rows = awkward() + [(100 + i, t, None) for i, t in enumerate(ODD)]
    rows += [(r.doc_id + 1000, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    monkeypatch.setattr(queries, "table", lambda *_: docs_frame(spark, rows))
    got = [tuple(r) for r in queries.op11_trie_bpe(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    want = []
    for d, t, _ in rows:
        found = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(found, skip_special_tokens=False)
        want.append((d, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    monkeypatch.setattr(queries, "table", lambda *_: docs_frame(spark, []))
    assert queries.op11_trie_bpe(spark, sf_dir).count() == 0


def test_broken_bytes_and_nulls_decode(spark, library):
    shared = trie_bpe.share(spark, PATH)
    rows = [(1, [50256, 220, 171]), (2, []), (3, None), (4, [447, 447, 262])]
    frame = spark.createDataFrame([(d, None if i is None else np.array(i, "<u4").tobytes()) for d, i in rows], "doc_id long, ids binary")
    got = {r.doc_id: r.decoded for r in trie_bpe.decode(frame, shared).collect()}
    assert got == {d: None if i is None else library.decode(i, skip_special_tokens=False) for d, i in rows}
