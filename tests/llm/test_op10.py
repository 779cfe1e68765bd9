from __future__ import annotations

import re

import pytest
from fixtures import awkward, docs_frame

from ruleweave.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [
        (i, label) for phrase, label in licences.BASE for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns(spark, sf_dir):
    rows = awkward()
    extra = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows += [(r.doc_id, r.text, r.source) for r in extra]
    out = licences.scan(docs_frame(spark, rows)).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out]
    assert sorted(map(repr, got)) == sorted(repr((d, *brute(t))) for d, t, _ in rows)
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    assert licences.scan(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("MIT", {"mit"}, 1.0),
        ("MIT OR GPL-2.0-only", {"mit", "gpl-2.0-only"}, 1.0),
        ("MIT and GPL-2.0-only", {"mit", "gpl-2.0-only"}, 0.4),
        ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT", {"gpl-2.0", "mit"}, 0.6),
        ("MIT AND (GPL-3.0 OR Apache-2.0)", {"mit", "gpl-3.0", "apache-2.0"}, 1.0),
        ("MIT OR GPL-3.0 AND AGPL-3.0", {"mit", "gpl-3.0", "agpl-3.0"}, 1.0),
    ],
)
def test_expressions(text, labels, score):
    found = licences.evaluate(text)
    assert found[0] == labels and abs(found[1] - score) < 1e-9


@pytest.mark.parametrize("text", ["", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT GPL-2.0", "MIT (GPL-2.0)", "()"])
def test_broken_expressions(text):
    assert licences.evaluate(text) is None


def test_notices():
    tree = licences.automaton()
    row = licences.scan_text("GNU General Public License, version 3. All rights reserved.", tree)
    assert row[5] == "all-rights-reserved,gpl,gpl-3" and row[1] == 0
    row = licences.scan_text("// SPDX-License-Identifier: MIT OR GPL-2.0\n", tree)
    assert row[5] == "gpl-2.0,mit" and row[6] == 1.0


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("<!-- SPDX-License-Identifier: MIT -->", "mit", 1.0),
        ("# SPDX-License-Identifier: MIT Copyright 2020 X", "mit", 1.0),
        ("SPDX-License-Identifier: MIT-->", "mit", 1.0),
        ("SPDX-License-Identifier: (MIT OR GPL-2.0+) AND BSD-3-Clause. See the file", "bsd-3-clause,gpl-2.0+,mit", 1.0),
        ("SPDX-License-Identifier: MIT AND (GPL-2.0 -->", "mit", 1.0),
        ("SPDX-License-Identifier: MIT OR", "mit", 1.0),
        ("SPDX-License-Identifier: (MIT", "", 0.0),
        ("SPDX-License-Identifier: MIT) x", "mit", 1.0),
        ("SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-3.0", "gpl-3.0,mit", 0.4),
        ("SPDX-License-Identifier: -->\nMIT", "", 0.0),
        ("SPDX-License-Identifier: MIT\nGNU General Public License version 3", "gpl,gpl-3,mit", 0.4),
    ],
)
def test_expressions_in_text(text, labels, score):
    row = licences.scan_text(text, licences.automaton())
    assert row[5] == labels and abs(row[6] - score) < 1e-9
