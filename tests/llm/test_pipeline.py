from __future__ import annotations

import hashlib

import corpus_pipeline as P
import test_op1
import test_op3
import test_op4
import test_op5
import tiktoken
from fixtures import awkward

from ruleweave.llm import byte_pairs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(rows, items):
    rows = [r for r, m in zip(rows, test_op3.brute(rows)) if m[-1]]
    rows = [r for r, m in zip(rows, test_op5.brute(rows)) if r[0] is None or m[3]]
    cut = []
    first = {}
    for d, t, s in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49) if d is not None else ():
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    for d, t, s in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - 49) if d is not None else ():
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = [True] * 50
        at, left = 0, []
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                left.append(c)
            at += n
        if left or not t:
            cut.append((d, "".join(left), s))
    return [r for r in cut if not test_op1.brute(r[1], items)]


def test_run(spark, sf_dir, tmp_path):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [r for r in docs if len(r[1] or "") < 4000] + [(10_000 + (d or 0) if d is not None else None, t, s) for d, t, s in awkward()[:-1]]
    frame = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = frame
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == COLUMNS, name
    library = tiktoken.Encoding("t", pat_str=P.public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(P.public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for d, t, _ in brute(rows, items):
        ids = library.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in P.run(spark, str(tmp_path)).collect()]
    assert len(want) < len(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
