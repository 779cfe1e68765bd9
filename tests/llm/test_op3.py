from __future__ import annotations

import re

from fixtures import awkward, docs_frame, prose

from ruleweave.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 10 or 100 * len(marked) > 20 * n
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(marked), failed


def key(line):
    plain = re.sub(r"[ \t-\r]+", " ", re.sub("[1-9]", "0", line.lower())).strip(" \t\n\x0b\x0c\r")
    return plain or None


def brute(rows):
    texts, hosts = {}, {}
    for _, t, s in rows:
        if t is not None:
            hosts.setdefault(s, set()).add(t)
    for s, own in hosts.items():
        for t in own:
            for k in {key(x) for x in t.split("\n")} - {None}:
                texts.setdefault((s, k), set()).add(t)
    out = []
    for d, t, s in rows:
        m = measures(t)
        bad = {k for (h, k), own in texts.items() if h == s and len(own) >= line_rules.MIN_TEXTS}
        left = sum(len(WORD.findall(x)) for x in (t or "").split("\n") if key(x) not in bad)
        out.append((d, *m, not (m[5] or left < 10 or left < 0.5 * m[0])))
    return out


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def same(spark, rows):
    got = [tuple(r) for r in line_rules.judge(docs_frame(spark, rows)).select(COLUMNS).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    return got


def test_awkward_rows(spark):
    same(spark, awkward())
    assert line_rules.judge(docs_frame(spark, [])).count() == 0


def test_boilerplate(spark, monkeypatch):
    footer = "Menu 2024  home " + prose(50, 20)
    rows = [(i, prose(100 + i, 12 if i % 3 else 60) + "\n" + footer.replace("2024", str(2000 + i)), "h") for i in range(40)]
    rows += [(100 + i, prose(7, 30), "copies") for i in range(60)]
    rows += [(200 + i, prose(300 + i, 30), None) for i in range(10)]
    got = same(spark, rows)
    assert 0 < sum(not r[-1] for r in got) < 40
    monkeypatch.setattr(line_rules, "BROADCAST_LINES", -1)
    assert same(spark, rows)


def test_measures_on_test_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    same(spark, [r for r in rows if len(r[1] or "") < 6000])


def test_limit_does_not_grow_with_the_host(spark):
    footer = "Subscribe to the letters of this part of the site today and read more of them"
    rows = [(i, f"alpha{i} beta{i}\n" + footer, "large") for i in range(20)]
    rows += [(100 + i, prose(500 + i, 30), "large") for i in range(300)]
    judged = {r.doc_id: r for r in line_rules.judge(docs_frame(spark, rows)).collect()}
    assert all(judged[i].n_left_words == 2 and not judged[i].kept for i in range(20))
    assert all(judged[100 + i].kept for i in range(300))
    same(spark, rows)


def test_lines_are_taken_out(spark, monkeypatch):
    footer = "Menu 2024  home"
    rows = [(i, f"{prose(i, 20)}\n{footer}\n\n{prose(100 + i, 20)}\r\nMENU {1000 + i} home ", "h") for i in range(25)]
    rows += [(50, footer + "\n" + prose(60, 20), "other"), (51, prose(61, 20), "h"), (52, None, "h")]
    want = {i: f"{prose(i, 20)}\n\n{prose(100 + i, 20)}\r" for i in range(25)} | {50: rows[25][1], 51: rows[26][1]}
    for most in (line_rules.BROADCAST_LINES, -1):
        monkeypatch.setattr(line_rules, "BROADCAST_LINES", most)
        judged = {r.doc_id: r for r in line_rules.judge(docs_frame(spark, rows)).collect()}
        assert {i: r.left_text for i, r in judged.items()} == want | {52: None}
        assert all(r.n_left_words == len(WORD.findall(r.left_text or "")) for r in judged.values())
        cleaned = line_rules.clean(docs_frame(spark, rows))
        assert cleaned.columns == docs_frame(spark, rows).columns
        assert {r.doc_id: r.text for r in cleaned.collect()} == {i: t for i, t in want.items() if judged[i].kept}


def test_pipeline_stage_takes_lines_out(spark):
    import corpus_pipeline

    rows = [(i, f"{prose(i, 40)}\nall rights of this page are kept", "h") for i in range(20)]
    frame = docs_frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    got = [tuple(r) for r in corpus_pipeline.quality_rules(spark, frame, "").select("doc_id", "text", "n_chars").collect()]
    judged = {d: prose(d, 40) for d, *m in brute(rows) if not m[5]}
    assert judged and sorted(got) == sorted((d, t, len(t)) for d, t in judged.items())


def test_clean_takes_the_measures_once(spark):
    plan = line_rules.clean(docs_frame(spark, awkward()))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "split" in x]
