from __future__ import annotations

import re
from itertools import combinations

import pytest

from ruleweave.llm import url_rules

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.ORG", "http://Sub.Org/x", "http://xorg/x", "http://org/", "https://example.org/es/1",
    "https://a.example.org/en/12?x=1", "https://a.example.org/en/22", "http://b.com/fr/", "http://b.com/de/1#f", "http://b.com/de",
    "x://y://z.com/fr/", "http://q.net?x=1&y=2", "http://q.net/es/5", "http://ünï.net/é",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def listed(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in url_rules.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


def tokens(url):
    host, path = parts(url)
    labels = host.split(".")
    found = {"host=" + ".".join(labels[i:]) for i in range(len(labels))} if host else set()
    found |= {"part=" + x for x in re.sub("[0-9]+", "#", path).split("/") if x}
    query = re.search(r"\?([^#]*)", url or "")
    if query and query[1]:
        found |= {"query=" + x.split("=")[0] for x in query[1].split("&")}
    return found


def brute(rows):
    known = [(tokens(u), listed(*parts(u))[1]) for _, u in set(rows) if listed(*parts(u))]
    n, least = len(known), len(known) * url_rules.MIN_SUPPORT
    spots = {}
    for at, (ts, _) in enumerate(known):
        for t in ts:
            spots.setdefault(t, set()).add(at)
    alike = {}
    for t, s in spots.items():
        if len(s) >= max(1, least):
            alike.setdefault(frozenset(s), []).append(t)
    names = {max(ts, key=lambda t: (len(t), t)) for ts in alike.values()}
    rules = {}
    for size in range(1, len(names) + 1):
        more = False
        for combo in combinations(sorted(names), size):
            both = set.intersection(*(spots[t] for t in combo))
            for v in ("allow", "block"):
                hit = sum(known[i][1] == v for i in both)
                if both and hit >= least and hit:
                    more = True
                    if hit / len(both) >= url_rules.MIN_CONFIDENCE:
                        rules[combo, v] = (hit / len(both), hit / n)
        if not more:
            break
    keep = {
        k: r for k, r in rules.items()
        if not any(v == k[1] and len(c) < len(k[0]) and set(c) < set(k[0]) and r2[0] >= r[0] for (c, v), r2 in rules.items())
    }
    out = []
    for page, url in rows:
        hit = listed(*parts(url))
        if hit:
            out.append((page, *parts(url), *hit))
            continue
        fit = [(round(c, 9), round(s, 9), len(a), v) for (a, v), (c, s) in keep.items() if set(a) <= tokens(url)]
        out.append((page, *parts(url), None, max(fit)[3] if fit else "allow"))
    return out


@pytest.fixture
def pages(spark):
    def make(rows):
        full = [(p, u, "x", "h", "r") for p, u in rows]
        return spark.createDataFrame(full, "page_id long, url string, host string, rule string, copies string")

    return make


def test_odd_urls(pages):
    rows = list(enumerate(URLS)) + [(None, "http://b.com/de/1"), (None, None), (3, URLS[3]), (12, URLS[12])]
    got = [tuple(r) for r in url_rules.judge(pages(rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    assert url_rules.judge(pages([])).count() == 0
    assert {r.verdict for r in url_rules.judge(pages([(1, "http://q.net/")])).collect()} == {"allow"}


def test_whole_table_against_brute_force(spark, sf_dir, monkeypatch):
    frame = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rows = [tuple(r) for r in frame.collect()]
    want = sorted(map(repr, brute(rows)))
    assert sorted(repr(tuple(r)) for r in url_rules.judge(frame).collect()) == want
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", -1)
    assert sorted(repr(tuple(r)) for r in url_rules.judge(frame).collect()) == want
