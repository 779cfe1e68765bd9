from __future__ import annotations

import random
import zlib

from fixtures import awkward, docs_frame, prose

from ruleweave.llm import toxicity


def corpus(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = prose(4000 + i, rng.randint(10, 120)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(("grumblewort", "snotgoblin", "mudbrain")))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    documents = docs_frame(spark, rows)
    model = toxicity.fit(documents, frame(spark, labels))
    out = {r.doc_id: r for r in toxicity.score(documents, model).collect()}
    assert len(out) == len(rows)
    for d, _, toxic in labels:
        assert out[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert out[d].predicted == int(out[d].score >= 0.3) and 0 <= out[d].score <= 1
    held = [(out[d].predicted, t) for d, _, t in labels if out[d].held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    judge = model.scorer()
    assert judge("amber birch cedar grumblewortt delta ember") > judge("amber birch cedar delta ember fjord")
    # a label in the held-out fold changes nothing
    other = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    again = toxicity.fit(documents, frame(spark, other))
    assert (again.weight == model.weight).all() and again.bias == model.bias


def test_awkward_rows(spark):
    rows = awkward()
    documents = docs_frame(spark, rows)
    for labels in ([], [(5, 1, 1)], [(5, 1, 1), (7, 1, 0), (None, 1, 1), (8, None, None), (5, 1, 0)]):
        out = toxicity.score(documents, toxicity.fit(documents, frame(spark, labels))).collect()
        assert sorted(repr(r.doc_id) for r in out) == sorted(repr(d) for d, _, _ in rows)
        assert all(0 <= r.score <= 1 for r in out)
    empty = docs_frame(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, frame(spark, []))).count() == 0
