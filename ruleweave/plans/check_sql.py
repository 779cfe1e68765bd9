"""SQL that computes every registered query a second way, for checking.

It runs on one machine in DuckDB over the same tables.  Mining uses GROUP BY
CUBE, matching a pairwise bit test, splits plain row numbers.
"""

from __future__ import annotations

from ruleweave.contract import CLASS_COUNTS, DOMAINS, FEATURES, LABELS, RECORD, SHARED_DOMAIN
from ruleweave.functions import urls
from ruleweave.functions.codes import ENCODING_ORDER
from ruleweave.operators.providers import COMMON_SUFFIXES
from ruleweave.operators.ranking import CLASS_RELATIVE
from ruleweave.sources import derive

D = derive.CheckText
F9 = ", ".join(FEATURES)
BY_TEXT = sorted(FEATURES)
NAMES = list(CLASS_COUNTS.values())

Ctes = list[tuple[str, str]]


def _with(ctes: Ctes, final: str) -> str:
    seen, kept = set(), []
    for name, text in ctes:
        if name not in seen:
            seen.add(name)
            kept.append(f"{name} AS MATERIALIZED ({text})")
    return "WITH " + ",\n".join(kept) + "\n" + final


def _derived(name: str) -> tuple[str, str]:
    return name, getattr(derive, name)(D).sql()


def _label(column: str) -> str:
    cases = " ".join(f"WHEN {value} THEN '{label}'" for value, label in LABELS.items())
    return f"CASE {column} {cases} END"


def _key(prefix: str = "", only_used: bool = False) -> str:
    parts = []
    for i, name in enumerate(FEATURES):
        value = f"({prefix}{name} + 2) * {1 << (2 * i)}"
        parts.append(f"coalesce({value}, 0)" if only_used else value)
    return "cast(" + " + ".join(parts) + " as integer)"


def _mask(prefix: str = "") -> str:
    return "(" + " + ".join(
        f"CASE WHEN {prefix}{name} IS NULL THEN 0 ELSE {3 << (2 * i)} END"
        for i, name in enumerate(FEATURES)
    ) + ")"


def _length(prefix: str = "") -> str:
    return "cast(" + " + ".join(f"({prefix}{name} IS NOT NULL)::int" for name in FEATURES) + " as integer)"


def _items(prefix: str = "", names: list[str] = BY_TEXT) -> str:
    cells = ", ".join(f"'{name}=' || {prefix}{name}" for name in names)
    return f"list_filter([{cells}], lambda x: x IS NOT NULL)"


def _i(text: str) -> str:
    return f"cast({text} as bigint)"


def _r(text: str, name: str, digits: int = 10) -> str:
    return f"round(cast({text} as double), {digits}) AS {name}"


# -- labelled rows -----------------------------------------------------------------


def _band(column: str, low: float, high: float) -> str:
    return f"CASE WHEN {column} < {low} THEN -1 WHEN {column} <= {high} THEN 0 ELSE 1 END"


LAB: Ctes = [
    (
        "lab",
        f"""
SELECT record_id, {F9},
  CASE WHEN z >= 2 THEN 1 WHEN z <= -1 THEN -1 ELSE 0 END AS Result
FROM (SELECT *, 2 * SFH + SSLfinal_State + Request_URL + (l_orderkey % 3 - 1) AS z FROM (
  SELECT l_orderkey,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(l_quantity as integer) AS record_id,
    {_band('l_quantity', 17, 34)} AS SFH,
    {_band('l_discount', 0.03, 0.06)} AS popUpWidnow,
    {_band('l_tax', 0.03, 0.05)} AS SSLfinal_State,
    CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END AS Request_URL,
    {_band('l_linenumber', 3, 5)} AS URL_of_Anchor,
    cast(l_partkey % 3 - 1 as integer) AS web_traffic,
    cast(l_suppkey % 3 - 1 as integer) AS URL_Length,
    CASE l_linestatus WHEN 'F' THEN -1 ELSE 1 END AS age_of_domain,
    CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE 1 END AS having_IP_Address
  FROM lineitem))""",
    )
]


def _class_counts(by: str) -> str:
    return ", ".join(
        f"cast(count(*) FILTER (Result = {c}) as bigint) AS {name}" for c, name in CLASS_COUNTS.items()
    )


def _mine(
    source: str,
    p: str,
    support: float = 0.01,
    confidence: float = 0.5,
    lift: float = 1.0,
    max_len: int = 99,
    relative: bool = False,
) -> Ctes:
    """Cells, totals, cube, itemsets and ranked rules of ``source`` under prefix ``p``."""
    sums = ", ".join(f"cast(sum({name}) as bigint) AS {name}" for name in NAMES)
    total = " + ".join(NAMES)
    per_class = " UNION ALL ".join(
        f"SELECT {F9}, {c} AS class, {name} AS joint, {total} AS covered FROM {p}cube"
        for c, name in CLASS_COUNTS.items()
    )
    class_n = "CASE class " + " ".join(
        f"WHEN {c} THEN t.{name}" for c, name in CLASS_COUNTS.items()
    ) + " END"
    order = (
        "confidence DESC, relative_support DESC, lift DESC, antecedent_length, antecedent, class"
        if relative
        else "confidence DESC, lift DESC, support DESC, antecedent_length DESC, class, antecedent"
    )
    wanted = f"support >= {support} AND confidence >= {confidence} AND lift >= {lift} AND antecedent_length < {max_len}"
    rules = f"SELECT * FROM {p}scored WHERE {wanted}"
    if relative:
        rules = (
            f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {order}) AS place "
            f"FROM ({rules} AND relative_support >= {CLASS_RELATIVE['min_relative_support']})) "
            f"WHERE place <= {CLASS_RELATIVE['max_rules_per_class']}"
        )
    return [
        (f"{p}cells", f"SELECT {F9}, {_class_counts('')} FROM {source} GROUP BY ALL"),
        (
            f"{p}tot",
            f"SELECT {sums}, cast(sum({total}) as bigint) AS n FROM {p}cells",
        ),
        (f"{p}cube", f"SELECT {F9}, {sums} FROM {p}cells GROUP BY CUBE ({F9})"),
        (
            f"{p}scored",
            f"""
SELECT *, support / (class_n / n) AS relative_support FROM (
  SELECT *, confidence / (class_n / n) AS lift FROM (
    SELECT *, support / (covered / n) AS confidence FROM (
      SELECT x.*, t.n, {class_n} AS class_n, joint / t.n AS support,
        {_items()} AS antecedent, {_length()} AS antecedent_length,
        {_key('x.', True)} AS rkey, {_mask('x.')} AS rmask
      FROM ({per_class}) x, {p}tot t WHERE joint / t.n >= {support} AND {_length('x.')} > 0)))""",
        ),
        (f"{p}rules", f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({rules})"),
    ]


def _itemsets(p: str, support: float = 0.01) -> Ctes:
    total = " + ".join(NAMES)
    parts = [f"SELECT {F9}, NULL AS class, {total} AS joint FROM {p}cube"]
    parts += [f"SELECT {F9}, {c}, {name} FROM {p}cube" for c, name in CLASS_COUNTS.items()]
    return [
        (
            f"{p}itemsets",
            f"SELECT x.*, joint / t.n AS support FROM ({' UNION ALL '.join(parts)}) x, {p}tot t "
            f"WHERE joint / t.n >= {support} AND ({_length('x.')} > 0 OR class IS NOT NULL)",
        )
    ]


def _generated(p: str, thresholds: list[float]) -> Ctes:
    """Rules with any consequent, by all proper sub-itemsets of every itemset."""
    wide = f"({_key('', True)} + coalesce(class + 2, 0) * {1 << 18})"
    bits = " + ".join(
        f"CASE WHEN {name} IS NULL THEN 0 ELSE {1 << i} END" for i, name in enumerate(FEATURES)
    ) + f" + CASE WHEN class IS NULL THEN 0 ELSE {1 << 9} END"
    keep = " + ".join(f"((s.sub >> {i}) & 1) * {3 << (2 * i)}" for i in range(10))
    counts = " UNION ALL ".join(
        f"SELECT cast({t} as double) AS min_confidence, count(*) FILTER (confidence >= {t}) AS generated_rules FROM {p}pairs"
        for t in thresholds
    )
    return [
        (f"{p}wide", f"SELECT cast({wide} as bigint) AS itemset, cast({bits} as bigint) AS bits, support FROM {p}itemsets"),
        (
            "subs",
            "SELECT m.i AS bits, s.i AS sub FROM range(1, 1024) m(i), range(1, 1024) s(i) "
            "WHERE m.i & s.i = s.i AND s.i < m.i",
        ),
        (
            f"{p}pairs",
            f"SELECT w.support / a.support AS confidence FROM {p}wide w JOIN subs s USING (bits) "
            f"JOIN {p}wide a ON a.itemset = (w.itemset & cast({keep} as bigint))",
        ),
        (f"{p}generated", counts),
    ]


RULE_COLUMNS = (
    "rank, array_to_string(antecedent, '|') AS antecedent, 'Result=' || " + _label("class") + " AS consequent, "
    + ", ".join(_r(c, c) for c in ("support", "confidence", "lift"))
    + ", antecedent_length, cast(class as integer) AS class"
)


def _vectors(p: str, vectors: str) -> Ctes:
    """Matching rules per vector: counts and the first rule, by a pairwise bit test."""
    return [
        (
            f"{p}match",
            f"SELECT v.vkey, r.rank, r.class, r.rkey FROM (SELECT DISTINCT {_key()} AS vkey FROM {vectors}) v "
            f"JOIN {p}rules r ON (v.vkey & r.rmask) = r.rkey",
        ),
        (
            f"{p}first",
            f"SELECT vkey, count(*) AS matching_rule_count, min(rank) AS rank, arg_min(class, rank) AS class "
            f"FROM {p}match GROUP BY vkey",
        ),
        (
            f"{p}major",
            f"SELECT CASE WHEN phishy >= greatest(suspicious, legitimate) THEN -1 "
            f"WHEN suspicious >= legitimate THEN 0 ELSE 1 END AS majority FROM {p}tot",
        ),
    ]


def _score(p: str, rows: str, name: str) -> Ctes:
    return [
        (
            name,
            f"SELECT r.*, coalesce(f.matching_rule_count, 0) AS matching_rule_count, f.rank, "
            f"cast(coalesce(f.class, m.majority) as integer) AS predicted "
            f"FROM {rows} r LEFT JOIN {p}first f ON f.vkey = {_key('r.')}, {p}major m",
        )
    ]


# -- splits ------------------------------------------------------------------------


def _group_split(size: float = 0.2, seed: int = 42) -> Ctes:
    text = f"concat_ws(',', {F9}, Result)"
    w = "OVER (PARTITION BY Result)"
    return [
        (
            "grp",
            f"SELECT {F9}, Result, count(*) AS n, md5('{seed}|' || {text}) AS h, {_key()} AS k FROM lab GROUP BY ALL",
        ),
        (
            "grp1",
            f"SELECT *, count(*) {w} AS groups, cast(least(greatest(1, round_even(sum(n) {w} * {size}, 0)), sum(n) {w} - 1) as bigint) AS target FROM grp",
        ),
        (
            "grp2",
            "SELECT *, CASE WHEN n <= target THEN n ELSE 0 END AS small FROM grp1",
        ),
        (
            "grp3",
            "SELECT *, small > 0 AND sum(small) OVER (PARTITION BY Result ORDER BY h, k ROWS UNBOUNDED PRECEDING) <= target AS taken FROM grp2",
        ),
        (
            "grp4",
            f"SELECT *, target - sum(CASE WHEN taken THEN n ELSE 0 END) {w} AS gap FROM grp3",
        ),
        (
            "grp5",
            "SELECT *, CASE WHEN NOT taken THEN abs(gap - n) END AS miss FROM grp4",
        ),
        (
            "sides",
            f"""SELECT {F9}, Result, n, CASE WHEN groups > 1 AND (taken OR (place = 1 AND coalesce(miss < gap, false))) THEN 'test' ELSE 'train' END AS side
FROM (SELECT *, row_number() OVER (PARTITION BY Result ORDER BY miss NULLS LAST, h, k) AS place FROM grp5)""",
        ),
        (
            "bygroup",
            f"SELECT l.*, s.side FROM lab l JOIN sides s USING ({F9}, Result)",
        ),
        ("train", "SELECT * FROM bygroup WHERE side = 'train'"),
        ("test", "SELECT * FROM bygroup WHERE side = 'test'"),
    ]


def _row_split(name: str, size: float, seed: int = 42) -> Ctes:
    return [
        (
            name,
            f"""SELECT * EXCLUDE (place, class_rows), CASE WHEN place <= greatest(1, round_even(class_rows * {size}, 0)) THEN 'test' ELSE 'train' END AS side
FROM (SELECT *, row_number() OVER (PARTITION BY Result ORDER BY md5('{seed}|' || record_id), record_id) AS place,
  count(*) OVER (PARTITION BY Result) AS class_rows FROM lab)""",
        )
    ]


def _folds(seed: int = 42) -> Ctes:
    return [
        *_row_split("split30", 0.3),
        (
            "folds",
            f"""SELECT *, cast((row_number() OVER (PARTITION BY Result ORDER BY md5('{seed}|' || record_id), record_id) - 1) * 5 // count(*) OVER (PARTITION BY Result) as integer) AS fold
FROM split30 WHERE side = 'train'""",
        ),
    ]


# -- metrics -----------------------------------------------------------------------


def _metrics(scored: str, p: str) -> Ctes:
    """Confusion counts, per-class rows and one row of averages."""
    cells = ", ".join(
        f"count(*) FILTER (Result = {a} AND predicted = {b}) AS c{i}{j}"
        for i, a in enumerate(LABELS)
        for j, b in enumerate(LABELS)
    )
    classes = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{label}' AS label, c{i}{i} AS tp, c0{i} + c1{i} + c2{i} AS pn, c{i}0 + c{i}1 + c{i}2 AS support FROM {p}conf"
        for i, label in enumerate(LABELS)
    )
    pivot = ", ".join(
        f"max(CASE WHEN pos = {i} THEN {c} END) AS {c}{i}"
        for c in ("precision", "recall", "f1", "support")
        for i in range(3)
    )
    macro = ", ".join(f"({c}0 + {c}1 + {c}2) / 3 AS macro_{c}" for c in ("precision", "recall", "f1"))
    weighted = ", ".join(
        f"({c}0 * support0 + {c}1 * support1 + {c}2 * support2) / (support0 + support1 + support2) AS weighted_{c}"
        for c in ("precision", "recall", "f1")
    )
    return [
        (f"{p}conf", f"SELECT {cells}, count(*) AS n, count(*) FILTER (matching_rule_count = 0) AS unmatched FROM {scored}"),
        (
            f"{p}classes",
            f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::double END AS f1 FROM (
SELECT *, CASE WHEN pn > 0 THEN tp / pn ELSE 0.0::double END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0::double END AS recall FROM ({classes}))""",
        ),
        (f"{p}pivot", f"SELECT {pivot} FROM {p}classes"),
        (
            f"{p}avg",
            f"SELECT (c00 + c11 + c22) / n AS accuracy, {macro}, {weighted}, n, unmatched FROM {p}pivot, {p}conf",
        ),
    ]


AVERAGES = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


def _tested() -> Ctes:
    return [
        *LAB,
        *_group_split(),
        *_mine("train", "m_"),
        *_vectors("m_", "test"),
        *_score("m_", "test", "scored"),
    ]


def _relative_job() -> Ctes:
    c = CLASS_RELATIVE
    return [
        *LAB,
        *_row_split("split30", 0.3),
        ("train30", "SELECT * FROM split30 WHERE side = 'train'"),
        ("test30", "SELECT * FROM split30 WHERE side = 'test'"),
        *_relative("train30", "d_"),
    ]


def _relative(source: str, p: str) -> Ctes:
    c = CLASS_RELATIVE
    return _mine(
        source,
        p,
        c["min_support"],
        c["min_confidence"],
        c["min_lift"],
        c["max_antecedent_length"] + 1,
        relative=True,
    )


# -- pages -------------------------------------------------------------------------

# The same URL and tag patterns, spelled for the checking engine.
S = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
A = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
P = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
HIDDEN = r"(?is)<!--.*?-->|(<script\b[^>]*>)(.*?)(?:</script\s*>|\z)|(<style\b[^>]*>).*?(?:</style\s*>|\z)"
TAGS = (
    r"(?i)<(?:img|script|link|video|audio|a|form|input|textarea)"
    r"(?:[\s/](?:[^>\"'']+|\"[^\"]*\"|''[^'']*'')*)?>"
)


def _attr(tag: str, name: str) -> str:
    pattern = (
        r"(?is)^<[a-z]+(?:[\s/]+[^\s=>/\"'']+(?:\s*=\s*(?:\"[^\"]*\"|''[^'']*''|[^\s>\"'']+))?)*?"
        r"[\s/]+" + name + r"\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s>\"'']+))"
    )
    text = " || ".join(f"coalesce(regexp_extract({tag}, '{pattern}', {i}), '')" for i in (1, 2, 3))
    return f"replace(replace(({text}), '&quot;', '\"'), '&amp;', '&')"


def _scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '{S}', 1))"


def _host(u: str) -> str:
    server = f"regexp_replace(regexp_extract({u}, '{A}', 1), '^.*@', '')"
    return (
        f"lower(CASE WHEN contains({server}, '[') THEN regexp_extract({server}, '\\[([^\\]]*)', 1) "
        f"ELSE regexp_extract({server}, '^([^:]*)', 1) END)"
    )


def _bare(h: str) -> str:
    return f"regexp_replace({h}, '\\.+$', '')"


def _trim(u: str) -> str:
    return f"regexp_replace({u}, '^\\s+|\\s+$', '', 'g')"


IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def _redacted(source: str, key: str) -> str:
    path = f"regexp_replace(regexp_extract(u, '{P}', 1), ';[^/]*$', '')"
    return _with(
        [
            _derived(source),
            ("c", f"SELECT {key}, regexp_replace(url, '^\\s+', '') AS u FROM {source}"),
            (
                "p",
                f"SELECT {key}, {_scheme('u')} AS s, {_host('u')} AS h, CASE WHEN {path} = '' THEN '/' ELSE {path} END AS p FROM c",
            ),
        ],
        f"""SELECT {key}, CASE WHEN s <> '' THEN s || ':' ELSE '' END
 || CASE WHEN h <> '' OR (s IN ('http', 'https', 'ftp', 'file') AND starts_with(p, '/')) THEN '//' ELSE '' END || h
 || CASE WHEN h <> '' AND NOT starts_with(p, '/') THEN '/' ELSE '' END || rtrim(p) AS redacted_url FROM p""",
    )


def _absolute(base: str, link: str) -> str:
    """Links of the derived pages: rooted, full, protocol-relative or opaque."""
    server = f"regexp_extract({base}, '^([a-z]+://[^/?#]*)', 1)"
    return (
        f"CASE WHEN {link} = '' THEN {base} WHEN starts_with({link}, '//') THEN {_scheme(base)} || ':' || {link} "
        f"WHEN regexp_matches({link}, '{S}') THEN {link} WHEN starts_with({link}, '/') THEN {server} || {link} "
        f"ELSE regexp_extract({base}, '^([a-z]+://[^?#]*/)', 1) || {link} END"
    )


def _external(link: str, page_host: str) -> str:
    h = _bare(_host(link))
    return f"({h} <> '' AND {h} <> {page_host} AND NOT ends_with({h}, '.' || {page_host}))"


def _observed(source: str) -> Ctes:
    resource = (
        f"CASE WHEN lower(regexp_extract(t, '^<([a-zA-Z]+)', 1)) = 'link' THEN {_attr('t', 'href')} "
        f"ELSE {_attr('t', 'src')} END"
    )
    kind = "lower(regexp_extract(t, '^<([a-zA-Z]+)', 1))"
    return [
        _derived(source),
        (
            "tags",
            f"""SELECT page_id, {_trim('url')} AS url, html IS NOT NULL AS fetched, {_host('url')} AS host,
  regexp_extract_all(html, '{HIDDEN}', 2) AS scripts,
  regexp_extract_all(regexp_replace(html, '{HIDDEN}', '\\1\\3', 'g'), '{TAGS}') AS tags FROM {source}""",
        ),
        (
            "tag",
            f"""SELECT page_id, url, host, pos, {kind} AS kind, {resource} AS src, {_attr('t', 'href')} AS href,
  {_attr('t', 'action')} AS act, lower({_attr('t', 'type')}) AS typ
FROM (SELECT page_id, url, host, unnest(tags) AS t, generate_subscripts(tags, 1) AS pos FROM tags)""",
        ),
        (
            "res",
            f"SELECT page_id, host, pos, kind, {_absolute('url', 'src')} AS link FROM tag "
            "WHERE kind IN ('img', 'script', 'link', 'video', 'audio') AND src <> ''",
        ),
        ("anc", "SELECT page_id, url, host, pos, href AS link FROM tag WHERE kind = 'a'"),
        ("frm", "SELECT page_id, host, pos, act AS link FROM tag WHERE kind = 'form'"),
        (
            "obs",
            f"""SELECT t.page_id, t.url, t.host, t.fetched,
  regexp_matches(t.host, '{IPV4}') OR contains(t.host, ':') AS hostname_is_ip,
  (SELECT coalesce(string_agg(kind || ' ' || link, chr(10) ORDER BY pos), '') FROM res r WHERE r.page_id = t.page_id) AS resources,
  (SELECT coalesce(string_agg(link, chr(10) ORDER BY pos), '') FROM anc a WHERE a.page_id = t.page_id) AS anchors,
  (SELECT coalesce(string_agg(link, chr(10) ORDER BY pos), '') FROM frm f WHERE f.page_id = t.page_id) AS form_actions,
  CASE WHEN t.fetched THEN coalesce(list_bool_or(list_transform(scripts, lambda x: contains(lower(coalesce(x, '')), 'window.open'))), false)
    AND exists(SELECT 1 FROM tag g WHERE g.page_id = t.page_id AND g.kind IN ('input', 'textarea') AND g.typ IN ('password', 'email')) END AS popup_credential_fields,
  (SELECT count(*) FROM res r WHERE r.page_id = t.page_id) AS resource_count,
  (SELECT count(*) FROM anc r WHERE r.page_id = t.page_id) AS anchor_count,
  (SELECT count(*) FROM frm r WHERE r.page_id = t.page_id) AS form_count
FROM tags t""",
        ),
    ]


def _page_observations(source: str) -> str:
    return _with(
        _observed(source),
        f"""SELECT page_id, url, host, hostname_is_ip, resources, anchors, form_actions, popup_credential_fields,
  CASE WHEN fetched THEN 'available' ELSE 'unavailable' END AS page_status,
  cast(CASE WHEN fetched THEN form_count END as integer) AS form_count,
  cast(CASE WHEN fetched THEN anchor_count END as integer) AS anchor_count,
  cast(CASE WHEN fetched THEN resource_count END as integer) AS resource_count,
  CASE WHEN {_scheme('url')} = 'https' THEN fetched END AS tls_verified,
  CASE WHEN {_scheme('url')} = 'https' THEN CASE WHEN fetched THEN 'observation_available' ELSE 'extraction_error' END
    WHEN fetched THEN 'not_applicable' END AS observation_status
FROM obs""",
    )


def _domains(source: str = "rendered_pages") -> Ctes:
    plain = [s for s in COMMON_SUFFIXES if not s.startswith(("*", "!"))]
    listed = ", ".join(f"('{s}', {s.count('.') + 1})" for s in plain)
    return [
        _derived(source),
        ("suffixes", f"SELECT * FROM (VALUES {listed}) v(suffix, labels)"),
        ("hosts", f"SELECT page_id, {_host('url')} AS host FROM {source}"),
        (
            "doms",
            """SELECT page_id, host, (SELECT array_to_string(list_slice(string_split(h.host, '.'), -(s.labels + 1), -1), '.')
  FROM suffixes s WHERE ends_with(h.host, '.' || s.suffix) ORDER BY s.labels DESC LIMIT 1) AS registrable_domain FROM hosts h""",
        ),
    ]


AS_OF_SECONDS = "epoch_us(timestamp '2015-06-30 12:00:00')"


def _ages() -> Ctes:
    zoned = "replace(replace(d, 'Z', '+00:00'), ',', '.')"
    zone = "([T ].*)([+-])([0-9]{2}):?([0-9]{2})?$"
    forms = [
        day + time
        for day in ("%Y-%m-%d", "%Y%m%d", "%G-W%V-%u", "%GW%V%u")
        for time in ("", "T%H:%M:%S.%f", "T%H:%M:%S", "T%H%M", "T%H", " %H")
    ]
    naive = (
        f"coalesce(try_strptime(regexp_replace({zoned}, '{zone}', '\\1'), {forms}), "
        f"CASE WHEN regexp_matches(d, '^[0-9]{{4}}W[0-9]{{2}}$') THEN try_strptime(d || '1', '%GW%V%u') END)"
    )
    part = lambda i: f"coalesce(try_cast(nullif(regexp_extract({zoned}, '{zone}', {i}), '') as bigint), 0)"
    offset = f"(CASE WHEN regexp_extract({zoned}, '{zone}', 2) = '-' THEN -1 ELSE 1 END) * ({part(3)} * 60 + {part(4)}) * 60000000"
    return [
        *_domains(),
        _derived("registrations"),
        (
            "dates",
            f"SELECT domain, min(epoch_us({naive}) - {offset}) AS created FROM "
            "(SELECT domain, unnest(creation_date) AS d FROM registrations) GROUP BY domain",
        ),
        (
            "ages",
            f"""SELECT page_id, host, coalesce(registrable_domain, host) AS domain, created AS created_micros,
  CASE WHEN created IS NOT NULL THEN greatest(0.0, ({AS_OF_SECONDS} - created) / 86400000000) END AS age_days,
  CASE WHEN registrable_domain IS NULL THEN 'registrable_domain_unavailable'
    WHEN NOT exists(SELECT 1 FROM registrations r WHERE r.domain = d.registrable_domain) THEN 'provider_unavailable'
    WHEN created IS NULL THEN 'creation_date_unavailable' ELSE 'available' END AS status
FROM doms d LEFT JOIN dates c ON c.domain = d.registrable_domain""",
        ),
    ]


def _coded() -> Ctes:
    def three(value: str, low: int, high: int) -> str:
        return f"CASE WHEN {value} < {low} THEN 1 WHEN {value} <= {high} THEN 0 ELSE -1 END"

    return [
        *_observed("rendered_pages"),
        *_ages(),
        _derived("ranks"),
        (
            "pct",
            f"""SELECT o.*, {_bare('o.host')} AS ph,
  coalesce((SELECT count(*) FILTER ({_external('r.link', _bare('r.host'))}) * 100.0::double / nullif(count(*), 0) FROM res r WHERE r.page_id = o.page_id), 0.0) AS rp,
  coalesce((SELECT count(*) FILTER ({_external('r.link', _bare('r.host'))}) * 100.0::double / nullif(count(*), 0) FROM anc r WHERE r.page_id = o.page_id), 0.0) AS ap,
  (SELECT count(*) FILTER (trim(f.link) = '' OR lower(trim(f.link)) = 'about:blank') FROM frm f WHERE f.page_id = o.page_id) AS empties,
  (SELECT count(*) FILTER ({_external('f.link', _bare('f.host'))}) FROM frm f WHERE f.page_id = o.page_id) AS foreigns
FROM obs o""",
        ),
        (
            "codes",
            f"""SELECT p.page_id, rp, ap, {three('length(p.url)', 54, 75)} AS URL_Length,
  {three('coalesce(rp, 0)', 22, 61)} AS Request_URL, {three('coalesce(ap, 0)', 31, 67)} AS URL_of_Anchor,
  CASE WHEN form_count = 0 OR empties > 0 THEN -1 WHEN foreigns > 0 THEN 0 ELSE 1 END AS SFH,
  CASE WHEN popup_credential_fields THEN -1 WHEN NOT popup_credential_fields THEN 1 END AS popUpWidnow,
  CASE WHEN a.age_days / (365.2425 / 12) >= 6 THEN 1 WHEN a.age_days IS NOT NULL THEN -1 END AS age_of_domain,
  CASE WHEN hostname_is_ip THEN -1 ELSE 1 END AS having_IP_Address,
  CASE WHEN a.status = 'available' THEN 'verified' WHEN a.status = 'provider_unavailable' THEN a.status ELSE 'mapping_unverified' END AS age_status,
  CASE WHEN exists(SELECT 1 FROM ranks k WHERE k.domain = p.host) THEN 'mapping_unverified' ELSE 'provider_unavailable' END AS traffic_state
FROM pct p JOIN ages a USING (page_id)""",
        ),
    ]


# -- history -----------------------------------------------------------------------

FILTERED: tuple[str, str] = (
    "filtered",
    "SELECT * FROM history WHERE created_at >= timestamp '2024-01-05' AND created_at < timestamp '2024-01-20 23:59:59.999999'",
)


def _checked(source: str, key: str) -> Ctes:
    """JSON vectors of ``source``: first failure and the nine codes."""
    names = "[" + ", ".join(f"'{n}'" for n in FEATURES) + "]"
    codes = []
    for name in FEATURES:
        raw, kind = f"json_extract_string(features, '$.{name}')", f"json_type(features, '$.{name}')"
        codes.append(
            f"CASE WHEN {kind} IN ('BIGINT', 'UBIGINT') THEN cast({raw} as bigint) "
            f"WHEN {kind} = 'DOUBLE' THEN cast(trunc(cast({raw} as double)) as bigint) "
            f"WHEN {kind} = 'VARCHAR' AND regexp_matches({raw}, '^\\s*[+-]?[0-9]+\\s*$') THEN cast({raw} as bigint) "
            f"WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {raw} = 'true' THEN 1 ELSE 0 END END AS c_{name}"
        )
    failures = " ".join(
        f"WHEN c_{n} IS NULL THEN 'Feature ''{n}'' must be an integer' "
        f"WHEN c_{n} NOT IN ({', '.join(str(v) for v in DOMAINS[n])}) THEN 'Feature ''{n}'' has invalid value ' || c_{n} || '; expected [{', '.join(str(v) for v in sorted(DOMAINS[n]))}]'"
        for n in FEATURES
    )
    kept = ", ".join(
        f"cast(CASE WHEN vector_error IS NULL THEN c_{n} END as integer) AS {n}" for n in FEATURES
    )
    return [
        (
            f"{source}_raw",
            f"SELECT *, {', '.join(codes)}, list_filter({names}, lambda x: NOT list_contains(json_keys(features), x)) AS missing, "
            f"list_sort(list_filter(json_keys(features), lambda x: NOT list_contains({names}, x))) AS extra FROM {source}",
        ),
        (
            f"{source}_err",
            f"""SELECT *, CASE WHEN len(missing) > 0 THEN 'Live feature record is missing required features: ' || array_to_string(missing, ', ')
  WHEN len(extra) > 0 THEN 'Live feature record contains unsupported features: ' || array_to_string(extra, ', ') {failures} END AS vector_error FROM {source}_raw""",
        ),
        (f"{source}_ok", f"SELECT * EXCLUDE (missing, extra), {kept} FROM {source}_err"),
    ]


def _history_counts(source: str) -> Ctes:
    """Rule counts of history rows under the model of all labelled rows."""
    return [
        *LAB,
        *_mine("lab", "m_"),
        _derived("history"),
        FILTERED,
        *_checked(source, "id"),
        ("valid", f"SELECT * FROM {source}_ok WHERE vector_error IS NULL AND prediction_status = 'predicted'"),
        *_vectors("m_", "valid"),
        (
            "counted",
            f"""SELECT h.*, CASE WHEN h.vector_error IS NULL AND h.prediction_status = 'predicted' THEN coalesce(f.matching_rule_count, 0) END AS rule_count
FROM {source}_ok h LEFT JOIN m_first f ON f.vkey = {_key('h.')}""",
        ),
    ]


# -- all queries -------------------------------------------------------------------


def _summary() -> str:
    parts = []
    for name in RECORD:
        domain = DOMAINS.get(name, SHARED_DOMAIN)
        parts.append(
            f"SELECT count(*) AS row_count, '{name}' AS column_name, count(*) FILTER ({name} IS NULL) AS null_count, "
            f"count(*) FILTER ({name} NOT IN (-1, 0, 1)) AS outside_shared, "
            f"count(*) FILTER ({name} NOT IN ({', '.join(map(str, domain))})) AS outside_strict FROM labelled_with_faults"
        )
    return _with([_derived("labelled_with_faults")], " UNION ALL ".join(parts))


def _invalid() -> str:
    parts = [
        f"SELECT '{n}' AS column_name, cast({n} as double) AS value, count(*) AS row_count FROM labelled_with_faults "
        f"WHERE {n} NOT IN ({', '.join(map(str, DOMAINS.get(n, SHARED_DOMAIN)))}) GROUP BY {n}"
        for n in RECORD
    ]
    return _with([_derived("labelled_with_faults")], " UNION ALL ".join(parts))


def _transaction() -> str:
    cells = " || '|' || ".join(f"'{n}=' || {n}" for n in FEATURES)
    return f"{cells} || '|Result=' || {_label('Result')}"


def _universe() -> str:
    parts = [f"SELECT '{n}=' || {n} AS item, count(*) AS row_count FROM lab GROUP BY 1" for n in FEATURES]
    parts.append(f"SELECT 'Result=' || {_label('Result')} AS item, count(*) AS row_count FROM lab GROUP BY 1")
    return _with(LAB, " UNION ALL ".join(parts))


def _matrix() -> str:
    flags = [f"{n} = {v} AS \"{n}={v}\"" for n in FEATURES for v in SHARED_DOMAIN]
    flags += [f"Result = {v} AS \"Result={label}\"" for v, label in LABELS.items()]
    return _with(
        LAB,
        f"SELECT {_transaction()} AS items, {', '.join(flags)}, count(*) AS row_count FROM lab GROUP BY ALL",
    )


def _characteristics() -> str:
    parts = [
        f"""SELECT '{f}' AS field, count(*) AS rules, {_r(f'min({f})', 'min')}, {_r(f'max({f})', 'max')}, {_r(f'avg({f})', 'mean')},
 {_r(f"list_sort(list({f}))[cast(floor(count(*) / 2) as bigint) + 1]", 'median')} FROM m_rules"""
        for f in ("support", "confidence", "lift", "antecedent_length")
    ]
    return _with([*LAB, *_mine("lab", "m_")], " UNION ALL ".join(parts))


def _unpacked(key: str) -> str:
    return ", ".join(
        f"cast((({key} >> {2 * i}) & 3) - 2 as integer) AS {n}" for i, n in enumerate(FEATURES)
    )


MATCHED: Ctes = [*LAB, *_mine("lab", "m_"), *_vectors("m_", "lab")]


def _evidence_ctes() -> Ctes:
    parts = [
        f"SELECT v.vkey, {i} AS pos, '{n}' AS feature, cast(((v.vkey >> {2 * i}) & 3) - 2 as integer) AS value, "
        f"'{','.join(map(str, DOMAINS[n]))}' AS allowed_values, count(m.rank) AS matching_rule_count, min(m.rank) AS strongest_rank "
        f"FROM (SELECT DISTINCT {_key()} AS vkey FROM lab) v LEFT JOIN m_match m ON m.vkey = v.vkey AND ((m.rkey >> {2 * i}) & 3) > 0 GROUP BY v.vkey"
        for i, n in enumerate(FEATURES)
    ]
    return [*MATCHED, ("ev", " UNION ALL ".join(parts))]


def _documents() -> str:
    return _with(
        [
            *_evidence_ctes(),
            ("evt", "SELECT vkey, string_agg(feature || '=' || matching_rule_count, ' ; ' ORDER BY pos) AS evidence_counts FROM ev GROUP BY vkey"),
            ("tops", "SELECT *, row_number() OVER (PARTITION BY vkey ORDER BY rank) AS position FROM m_match"),
            (
                "topt",
                "SELECT t.vkey, string_agg(array_to_string(r.antecedent, '|'), ' ; ' ORDER BY t.rank) AS top_antecedents "
                "FROM tops t JOIN m_rules r USING (rank) WHERE position <= 5 GROUP BY t.vkey",
            ),
        ],
        f"""SELECT {_unpacked('e.vkey')}, coalesce(f.matching_rule_count, 0) AS matching_rule_count,
  f.matching_rule_count IS NOT NULL AS has_matching_rules, coalesce(t.top_antecedents, '') AS top_antecedents, e.evidence_counts
FROM evt e LEFT JOIN m_first f USING (vkey) LEFT JOIN topt t USING (vkey)""",
    )


def _analysis() -> str:
    return _with(
        [
            *LAB,
            *_group_split(),
            ("vec", f"SELECT {F9}, bool_or(side = 'train') AS tr, bool_or(side = 'test') AS te, count(DISTINCT Result) AS labels FROM sides GROUP BY ALL"),
            ("shared", f"SELECT {F9}, Result FROM train INTERSECT SELECT {F9}, Result FROM test"),
        ],
        """SELECT (SELECT count(*) FROM sides) AS record_groups_total,
  (SELECT count(*) FROM sides WHERE side = 'train') AS record_groups_train,
  (SELECT count(*) FROM sides WHERE side = 'test') AS record_groups_test,
  (SELECT count(*) FROM shared) AS shared_records,
  count(*) AS feature_groups_total, count(*) FILTER (tr) AS feature_groups_train, count(*) FILTER (te) AS feature_groups_test,
  count(*) FILTER (tr AND te) AS feature_groups_shared, count(*) FILTER (labels > 1) AS conflicting_groups_total,
  count(*) FILTER (tr AND te AND labels > 1) AS conflicting_groups_shared FROM vec""",
    )


def _shared() -> str:
    sums = ", ".join(
        _i(f"coalesce(sum(n) FILTER (side = '{side}' AND Result = {c}), 0)") + f" AS {side}_{name}"
        for side in ("train", "test")
        for c, name in CLASS_COUNTS.items()
    )
    return _with(
        [*LAB, *_group_split()],
        f"SELECT {F9}, {sums}, count(DISTINCT Result) > 1 AS conflicting_labels FROM sides GROUP BY {F9} HAVING count(DISTINCT side) = 2",
    )


def _confusion() -> str:
    return _with(
        [*_tested(), ("g", "SELECT * FROM (VALUES (-1), (0), (1)) a(actual), (VALUES (-1), (0), (1)) b(predicted)")],
        "SELECT g.actual, g.predicted, count(s.Result) AS row_count FROM g LEFT JOIN scored s "
        "ON s.Result = g.actual AND s.predicted = g.predicted GROUP BY ALL",
    )


def _class_metrics() -> str:
    averages = " UNION ALL ".join(
        f"SELECT '{kind} avg' AS label, {_r('accuracy', 'accuracy')}, "
        + ", ".join(_r(f"{kind}_{c}", c) for c in ("precision", "recall", "f1"))
        + ", n AS support FROM e_avg"
        for kind in ("macro", "weighted")
    )
    return _with(
        [*_tested(), *_metrics("scored", "e_")],
        f"SELECT label, {_r('accuracy', 'accuracy')}, "
        + ", ".join(_r(f"c.{c}", c) for c in ("precision", "recall", "f1"))
        + f", support FROM e_classes c, e_avg a UNION ALL {averages}",
    )


def _coverage() -> str:
    matched = "matching_rule_count > 0"
    by_actual = ", ".join(
        f"count(*) FILTER (Result = {c} AND {m}) AS actual_{name}_{state}"
        for c, name in CLASS_COUNTS.items()
        for state, m in (("matched", matched), ("unmatched", f"NOT {matched}"))
    )
    by_predicted = ", ".join(
        f"count(*) FILTER (predicted = {c} AND {matched}) AS predicted_{name}_matched"
        for c, name in CLASS_COUNTS.items()
    )
    return _with(
        _tested(),
        f"""SELECT count(*) AS rows_all, count(*) FILTER ({matched}) AS rows_matched, count(*) FILTER (NOT {matched}) AS rows_unmatched,
 {by_actual}, {by_predicted}, count(*) FILTER (NOT {matched} AND Result = predicted) AS fallback_correct,
 {_r(f'count(*) FILTER ({matched}) / count(*)', 'rule_coverage')} FROM scored""",
    )


def _errors() -> str:
    return _with(
        _tested(),
        """SELECT record_id, Result AS actual, predicted, matching_rule_count > 0 AS matched, matching_rule_count = 0 AS default_rule,
  matching_rule_count, array_to_string(r.antecedent, '|') AS selected_rule FROM scored s LEFT JOIN m_rules r USING (rank) WHERE Result <> predicted""",
    )


def _experiments() -> Ctes:
    """One mining per threshold, as separate fits."""
    ctes: Ctes = [*LAB, *_group_split()]
    parts = []
    for i, t in enumerate((0.3, 0.5, 0.7)):
        p = f"t{i}_"
        ctes += _mine("train", p, confidence=t)
        ctes += _vectors(p, "test") + _score(p, "test", f"{p}scoredrows") + _metrics(f"{p}scoredrows", p)
        parts.append(
            f"SELECT cast({t} as double) AS min_confidence, (SELECT count(*) FROM t0_itemsets) AS frequent_itemsets, "
            f"(SELECT generated_rules FROM t0_generated WHERE min_confidence = {t}) AS generated_rules, "
            f"(SELECT count(*) FROM {p}rules) AS kept_rules, {_r('accuracy', 'accuracy')}, {_r('macro_f1', 'macro_f1')}, unmatched AS unmatched_rows FROM {p}avg"
        )
    ctes += _itemsets("t0_") + _generated("t0_", [0.3, 0.5, 0.7])
    return [*ctes, ("experiments", " UNION ALL ".join(parts))]


def _compare() -> str:
    ctes: Ctes = [
        *_tested(),
        *_metrics("scored", "e_"),
        *_row_split("split20", 0.2),
        ("rtrain", "SELECT * FROM split20 WHERE side = 'train'"),
        ("rtest", "SELECT * FROM split20 WHERE side = 'test'"),
        *_mine("rtrain", "r_"),
        *_vectors("r_", "rtest"),
        *_score("r_", "rtest", "rscored"),
        *_metrics("rscored", "re_"),
    ]
    columns = ", ".join(_r(c, c) for c in AVERAGES)
    return _with(
        ctes,
        f"SELECT 'exact_record_groups' AS split, (SELECT n FROM m_tot) AS rows_train, n AS rows_test, unmatched AS rows_unmatched, {columns} FROM e_avg "
        f"UNION ALL SELECT 'stratified_rows', (SELECT n FROM r_tot), n, unmatched, {columns} FROM re_avg",
    )


def _cross() -> str:
    """All folds side by side, told apart by ``run``."""
    c = CLASS_RELATIVE
    sums = ", ".join(f"cast(sum({name}) as bigint) AS {name}" for name in NAMES)
    total = " + ".join(NAMES)
    per_class = " UNION ALL ".join(
        f"SELECT run, {F9}, {v} AS class, {name} AS joint, {total} AS covered FROM cube"
        for v, name in CLASS_COUNTS.items()
    )
    class_n = "CASE class " + " ".join(f"WHEN {v} THEN t.{n}" for v, n in CLASS_COUNTS.items()) + " END"
    order = "confidence DESC, relative_support DESC, lift DESC, antecedent_length, antecedent, class"
    hits = ", ".join(f"count(*) FILTER (Result = {v} AND predicted = {v}) AS t{i}" for i, v in enumerate(LABELS))
    actual = ", ".join(f"count(*) FILTER (Result = {v}) AS a{i}" for i, v in enumerate(LABELS))
    guessed = ", ".join(f"count(*) FILTER (predicted = {v}) AS g{i}" for i, v in enumerate(LABELS))
    f1 = []
    for i in range(3):
        p, r = f"coalesce(t{i} / nullif(g{i}, 0), 0)", f"coalesce(t{i} / nullif(a{i}, 0), 0)"
        f1.append(f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)")
    ctes: Ctes = [
        *LAB,
        *_folds(),
        ("fit", "SELECT i AS run, f.* FROM folds f, range(5) t(i) WHERE f.fold <> i"),
        ("cells", f"SELECT run, {F9}, {_class_counts('')} FROM fit GROUP BY ALL"),
        ("tot", f"SELECT run, {sums}, cast(sum({total}) as bigint) AS n FROM cells GROUP BY run"),
        ("cube", f"SELECT run, {F9}, {sums} FROM cells GROUP BY run, CUBE ({F9})"),
        (
            "scored",
            f"""
SELECT *, support / (class_n / n) AS relative_support FROM (
  SELECT *, confidence / (class_n / n) AS lift FROM (
    SELECT *, support / (covered / n) AS confidence FROM (
      SELECT x.*, t.n, {class_n} AS class_n, joint / t.n AS support,
        {_items()} AS antecedent, {_length()} AS antecedent_length,
        {_key('x.', True)} AS rkey, {_mask('x.')} AS rmask
      FROM ({per_class}) x JOIN tot t USING (run)
      WHERE joint / t.n >= {c['min_support']} AND {_length('x.')} BETWEEN 1 AND {c['max_antecedent_length']})))""",
        ),
        (
            "best",
            f"""SELECT *, row_number() OVER (PARTITION BY run, class ORDER BY {order}) AS place FROM scored
WHERE confidence >= {c['min_confidence']} AND lift >= {c['min_lift']} AND relative_support >= {c['min_relative_support']}""",
        ),
        (
            "rules",
            f"SELECT *, row_number() OVER (PARTITION BY run ORDER BY {order}) AS rank FROM best WHERE place <= {c['max_rules_per_class']}",
        ),
        ("vecs", f"SELECT DISTINCT cast(fold as bigint) AS run, {_key()} AS vkey FROM folds"),
        (
            "first",
            "SELECT v.run, v.vkey, arg_min(r.class, r.rank) AS class FROM vecs v "
            "JOIN rules r ON r.run = v.run AND (v.vkey & r.rmask) = r.rkey GROUP BY ALL",
        ),
        (
            "out",
            f"""SELECT t.run, r.Result, f.class IS NULL AS missed, coalesce(f.class, CASE WHEN phishy >= greatest(suspicious, legitimate) THEN -1
  WHEN suspicious >= legitimate THEN 0 ELSE 1 END) AS predicted
FROM folds r JOIN tot t ON t.run = r.fold LEFT JOIN first f ON f.run = r.fold AND f.vkey = {_key('r.')}""",
        ),
        ("conf", f"SELECT run, {hits}, {actual}, {guessed}, count(*) AS rows_all, count(*) FILTER (missed) AS rows_unmatched FROM out GROUP BY run"),
        (
            "perfold",
            f"""SELECT cast(c.run as varchar) AS fold, t.n AS rows_fit, rows_all, rows_unmatched, (t0 + t1 + t2) / rows_all AS accuracy,
  ({' + '.join(f1)}) / 3 AS macro_f1 FROM conf c JOIN tot t USING (run)""",
        ),
    ]
    return _with(
        ctes,
        f"""SELECT fold, {_i('rows_fit')} AS rows_fit, {_i('rows_all')} AS rows_all, {_i('rows_unmatched')} AS rows_unmatched, {_r('accuracy', 'accuracy')}, {_r('macro_f1', 'macro_f1')} FROM perfold
UNION ALL SELECT 'mean', {_i('sum(rows_fit)')}, {_i('sum(rows_all)')}, {_i('sum(rows_unmatched)')}, {_r('avg(accuracy)', 'accuracy')}, {_r('avg(macro_f1)', 'macro_f1')} FROM perfold""",
    )


def _model_summary() -> str:
    return _with(
        [*_relative_job(), ("cls", "SELECT * FROM (VALUES (-1), (0), (1)) c(class)")],
        """SELECT 'rules' AS part, c.class, count(r.rank) AS amount FROM cls c LEFT JOIN d_rules r USING (class) GROUP BY ALL
UNION ALL SELECT side, Result, count(*) FROM split30 GROUP BY ALL""",
    )


def _relative_evaluation() -> str:
    return _with(
        [*_relative_job(), *_vectors("d_", "test30"), *_score("d_", "test30", "dscored"), *_metrics("dscored", "de_")],
        f"SELECT n AS rows_all, unmatched AS rows_unmatched, {', '.join(_r(c, c) for c in AVERAGES)} FROM de_avg",
    )


def _quality_ctes() -> Ctes:
    return [
        *LAB,
        ("vecs", f"SELECT {F9}, count(DISTINCT Result) AS labels, {_class_counts('')} FROM lab GROUP BY {F9}"),
        (
            "qual",
            f"""SELECT count(*) AS row_count, cast(10 as integer) AS column_count, {_i(' + '.join(f"count(*) FILTER ({n} IS NULL)" for n in RECORD))} AS missing_values,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {F9}, Result FROM lab)) AS duplicate_rows,
  (SELECT count(*) FROM (SELECT DISTINCT {F9}, Result FROM lab)) AS unique_rows,
  (SELECT count(*) FROM vecs) AS feature_group_count, (SELECT count(*) FROM vecs WHERE labels > 1) AS conflicting_group_count,
  {', '.join(f"count(*) FILTER (Result = {c}) AS {name}_rows" for c, name in CLASS_COUNTS.items())} FROM lab""",
        ),
    ]


def _eda() -> str:
    parts = [
        f"""SELECT '{n}' AS column_name, count(*) AS row_count, count(*) FILTER ({n} IS NULL) AS missing_count,
  round(count(*) FILTER ({n} IS NULL) / count(*) * 100, 4) AS missing_percent,
  (SELECT count(*) FROM (SELECT DISTINCT {n} FROM labelled_with_faults)) AS unique_count,
  (SELECT string_agg({n}, ',' ORDER BY {n}) FROM (SELECT DISTINCT {n} FROM labelled_with_faults WHERE {n} IS NOT NULL)) AS domain,
  count({n}) AS present_count, cast(min({n}) as integer) AS min, cast(max({n}) as integer) AS max, {_r(f'avg({n})', 'mean', 8)}, {_r(f'stddev_samp({n})', 'std', 8)},
  {_r(f'quantile_cont({n}, 0.25)', 'p25', 8)}, {_r(f'quantile_cont({n}, 0.5)', 'p50', 8)}, {_r(f'quantile_cont({n}, 0.75)', 'p75', 8)} FROM labelled_with_faults"""
        for n in RECORD
    ]
    return _with([_derived("labelled_with_faults")], " UNION ALL ".join(parts))


def _frequencies() -> str:
    parts = [
        f"SELECT '{n}' AS column_name, cast({n} as integer) AS value, count(*) AS row_count, "
        f"round(count(*) / (SELECT count(*) FROM labelled_with_faults) * 100, 4) AS percent FROM labelled_with_faults GROUP BY {n}"
        for n in RECORD
    ]
    return _with([_derived("labelled_with_faults")], " UNION ALL ".join(parts))


def _correlations() -> str:
    parts = [
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 8) AS correlation FROM lab"
        for a in RECORD
        for b in RECORD
    ]
    return _with(LAB, " UNION ALL ".join(parts))


def _screened(source: str) -> Ctes:
    """``screened``: request_id, url, trimmed, host and url_error of a table of requests."""

    def number(text: str) -> str:
        return "(" + " + ".join(
            f"try_cast(split_part({text}, '.', {i + 1}) as bigint) * {1 << (8 * (3 - i))}" for i in range(4)
        ) + ")"

    blocked = " OR ".join(
        f"num BETWEEN {urls._number(b)} AND {urls._number(b) + (1 << (32 - bits)) - 1}"
        for b, bits in urls.BLOCKED_IPV4
    )
    return [
        _derived(source),
        (
            "p",
            f"""SELECT request_id, url, u AS trimmed, {_scheme('u')} AS s, {_host('u')} AS host, {_bare(_host('u'))} AS h,
  regexp_extract(regexp_extract(u, '{A}', 1), '^(.*)@', 1) AS userinfo FROM (SELECT *, {_trim('url')} AS u FROM {source})""",
        ),
        ("q", f"SELECT *, CASE WHEN regexp_matches(h, '{IPV4}') THEN {number('h')} END AS num FROM p"),
        (
            "screened",
            f"""SELECT request_id, url, trimmed, host, CASE WHEN length(url) > 2048 THEN '{urls.INVALID_URL}'
  WHEN s NOT IN ('http', 'https') OR host = '' OR userinfo NOT IN ('', ':') THEN '{urls.NOT_PUBLIC_HTTP}'
  WHEN h IN ('localhost', 'localhost.localdomain') OR ends_with(h, '.local') OR ends_with(h, '.internal') THEN '{urls.INTERNAL_HOST}'
  WHEN ({blocked}) OR h = '::1' THEN '{urls.INTERNAL_ADDRESS}' END AS url_error FROM q""",
        ),
    ]


def _links() -> str:
    return _with(
        _observed("rendered_pages"),
        f"""SELECT page_id, cast(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 as integer) AS position, link,
  {_absolute('url', 'link')} AS resolved, {_external('link', _bare('host'))} AS external FROM anc""",
    )


def _raw_values() -> str:
    known = {
        "URL_Length": "cast(length(url) as varchar)",
        "SSLfinal_State": f"'{{\"scheme\":\"' || {_scheme('url')} || '\"}}'",
        "having_IP_Address": f"CASE WHEN regexp_matches({_host('url')}, '{IPV4}') OR contains({_host('url')}, ':') THEN 'true' ELSE 'false' END",
    }
    columns = ", ".join(f"{known.get(n, 'cast(NULL as varchar)')} AS {n}" for n in FEATURES)
    return _with([_derived("rendered_pages")], f"SELECT page_id, {columns} FROM rendered_pages")


def _encode_features() -> str:
    values = {n: n for n in FEATURES} | {"SSLfinal_State": "NULL", "web_traffic": "NULL"}
    states = {n: "'verified'" for n in FEATURES} | {
        "SSLfinal_State": "'mapping_unverified'",
        "web_traffic": "traffic_state",
        "age_of_domain": "age_status",
        "popUpWidnow": "CASE WHEN popUpWidnow IS NULL THEN 'mapping_unverified' ELSE 'verified' END",
    }
    return _with(
        _coded(),
        "SELECT page_id, "
        + ", ".join(f"cast({v} as integer) AS {n}" for n, v in values.items())
        + ", "
        + ", ".join(f"{v} AS {n}_status" for n, v in states.items())
        + ", round(rp, 8) AS resource_percent, round(ap, 8) AS anchor_percent FROM codes",
    )


def _encode_gate() -> str:
    resolved = {n: f"{n} IS NOT NULL" for n in FEATURES} | {"SSLfinal_State": "false", "web_traffic": "false"}
    accepted = {
        n: f"coalesce({n} IN ({', '.join(map(str, DOMAINS[n]))}), false)" if resolved[n] != "false" else "false"
        for n in FEATURES
    }
    texts = ", ".join(f"CASE WHEN NOT ({resolved[n]}) THEN '{n}' END" for n in ENCODING_ORDER)
    return _with(
        _coded(),
        f"""SELECT page_id, 'blocked' AS route, {' AND '.join(accepted.values())} AS complete,
  cast({' + '.join(f'({a})::int' for a in accepted.values())} as integer) AS accepted_features,
  concat_ws(',', {texts}) AS unresolved_features FROM codes""",
    )


def _overview() -> str:
    labels = ", ".join(
        f"count(*) FILTER (label = '{text}') AS {text.lower()}" for text in LABELS.values()
    )
    return _with(
        [_derived("history"), FILTERED],
        f"""SELECT count(*) AS total, {labels}, count(*) FILTER (prediction_status = 'predicted') AS predicted,
  count(*) FILTER (prediction_status = 'feature_mapping_unavailable') AS mapping_unverified FROM filtered""",
    )


def _distribution() -> str:
    parts = []
    for n in FEATURES:
        kind, raw = f"json_type(features, '$.{n}')", f"json_extract_string(features, '$.{n}')"
        value = f"CASE WHEN {kind} = 'BOOLEAN' THEN ({raw} = 'true')::int WHEN {kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN cast({raw} as double) END"
        parts.append(
            f"SELECT '{n}' AS feature, cast({value} as integer) AS value, count(*) AS row_count FROM filtered_ok "
            f"WHERE vector_error IS NULL AND prediction_status = 'predicted' AND {value} IN ({', '.join(map(str, DOMAINS[n]))}) GROUP BY 2"
        )
    return _with(
        [_derived("history"), FILTERED, *_checked("filtered", "id"), ("v", " UNION ALL ".join(parts))],
        f"SELECT feature, value, row_count, {_i('sum(row_count) OVER (PARTITION BY feature)')} AS observations FROM v",
    )


def _report() -> str:
    return _with(
        [*_tested(), *_metrics("scored", "e_"), *_quality_ctes()],
        f"""SELECT {', '.join(_r(c, c) for c in AVERAGES)}, row_count, '{','.join(FEATURES)}' AS feature_names, duplicate_rows, unique_rows,
  conflicting_group_count, missing_values, true AS model_loaded, 'Integrity verification not configured' AS integrity FROM e_avg, qual""",
    )


def _fingerprint() -> str:
    names = sorted(RECORD)
    row = "sha256(concat_ws(chr(31), " + ", ".join(f"'{n}' || coalesce('=' || {n}, '-')" for n in names) + "))"
    sums = ", ".join(
        f"cast(sum(cast('0x' || substr(d, {1 + 8 * i}, 8) as bigint)) as bigint) AS p{i}" for i in range(8)
    )
    text = f"'{','.join(names)}:' || row_count || ':' || " + " || ':' || ".join(f"p{i}" for i in range(8))
    return _with(
        [*LAB, ("dig", f"SELECT {row} AS d FROM lab"), ("s", f"SELECT count(*) AS row_count, {sums} FROM dig")],
        f"SELECT row_count, sha256({text}) AS digest FROM s",
    )


def all_sql() -> dict[str, str]:
    mined = [*LAB, *_mine("lab", "m_")]
    requests = [
        *_screened("vector_requests"),
        _derived("vector_provider"),
        ("vector_one", "SELECT url AS asked, min(features) AS features FROM vector_provider GROUP BY url"),
        *_checked("vector_one", "asked"),
    ]
    return {
        "validate_summary": _summary(),
        "invalid_values": _invalid(),
        "vector_validation": _with(
            [_derived("history"), *_checked("history", "id")],
            f"SELECT id, vector_error, {F9} FROM history_ok",
        ),
        "provider_vectors": _with(
            requests,
            "SELECT r.request_id, r.url, CASE WHEN r.url_error IS NOT NULL THEN r.url_error WHEN p.asked IS NULL THEN 'Trusted feature provider failed' "
            "ELSE p.vector_error END AS vector_error, "
            + ", ".join(f"p.{n}" for n in FEATURES)
            + " FROM screened r LEFT JOIN vector_one_ok p ON r.trimmed = p.asked AND r.url_error IS NULL",
        ),
        "routed_history": _with(
            requests,
            """SELECT r.request_id AS id, CASE WHEN r.url_error IS NOT NULL THEN 'refused' WHEN p.asked IS NOT NULL THEN 'predicted'
  ELSE 'feature_mapping_unavailable' END AS prediction_status, r.url_error AS error, r.url_error IS NULL AND p.asked IS NOT NULL AS predicted
FROM screened r LEFT JOIN (SELECT asked FROM vector_one_ok WHERE vector_error IS NULL) p ON r.trimmed = p.asked""",
        ),
        "item_encoding": _with(LAB, f"SELECT record_id, {_transaction()} AS items FROM lab"),
        "item_universe": _universe(),
        "item_matrix": _matrix(),
        "dedup_rows": _with(LAB, f"SELECT DISTINCT {F9}, Result FROM lab"),
        "class_counts": _with(
            [*mined, *_vectors("m_", "lab")],
            "SELECT phishy, suspicious, legitimate, n AS n_samples, majority AS majority_class FROM m_tot, m_major",
        ),
        "frequent_itemsets": _with(
            [*mined, *_itemsets("m_")],
            f"SELECT array_to_string({_items()}, '|') AS items, 'Result=' || {_label('class')} AS class_item, {_i('joint')} AS row_count, {_r('support', 'support')} FROM m_itemsets",
        ),
        "class_rules": _with(mined, f"SELECT {RULE_COLUMNS} FROM m_rules"),
        "generated_rule_count": _with(
            [*mined, *_itemsets("m_"), *_generated("m_", [0.3, 0.5, 0.7])], "SELECT * FROM m_generated"
        ),
        "class_relative_rules": _with(
            [*LAB, *_relative("lab", "d_")],
            f"SELECT {RULE_COLUMNS}, {_r('relative_support', 'relative_support')} FROM d_rules",
        ),
        "filtered_rules": _with(
            mined,
            f"SELECT {RULE_COLUMNS}, {_label('class')} AS class_label FROM m_rules WHERE confidence >= 0.7 AND lift >= 1.2",
        ),
        "top_rules": _with(
            mined,
            f"SELECT * EXCLUDE (antecedent_length, class) FROM (SELECT {RULE_COLUMNS} FROM m_rules WHERE rank <= 10)",
        ),
        "rule_characteristics": _characteristics(),
        "matched_rule_counts": _with(
            MATCHED,
            f"SELECT {F9}, coalesce(matching_rule_count, 0) AS matching_rule_count FROM (SELECT DISTINCT {F9} FROM lab) v LEFT JOIN m_first f ON f.vkey = {_key('v.')}",
        ),
        "open_class_rules": _with(mined, f"SELECT {RULE_COLUMNS} FROM m_rules"),
        "open_matched_rule_counts": _with(
            MATCHED,
            f"SELECT {F9}, coalesce(matching_rule_count, 0) AS matching_rule_count FROM (SELECT DISTINCT {F9} FROM lab) v LEFT JOIN m_first f ON f.vkey = {_key('v.')}",
        ),
        "predictions": _with(
            [*MATCHED, *_score("m_", "lab", "scored")],
            "SELECT record_id, Result AS actual, predicted, matching_rule_count, rank FROM scored",
        ),
        "explanations_topk": _with(
            [*MATCHED, ("tops", "SELECT *, row_number() OVER (PARTITION BY vkey ORDER BY rank) AS position FROM m_match")],
            f"SELECT {_unpacked('t.vkey')}, position, {RULE_COLUMNS.replace('rank,', 'r.rank,').replace('cast(class as', 'cast(r.class as').replace('CASE class', 'CASE r.class')}, {_label('r.class')} AS class_label "
            "FROM (SELECT vkey, rank, position FROM tops WHERE position <= 5) t JOIN m_rules r USING (rank)",
        ),
        "feature_evidence": _with(
            _evidence_ctes(),
            f"SELECT {_unpacked('e.vkey')}, feature, value, allowed_values, matching_rule_count, strongest_rank, array_to_string(r.antecedent, '|') AS strongest_rule "
            "FROM ev e LEFT JOIN m_rules r ON r.rank = e.strongest_rank",
        ),
        "explanation_documents": _documents(),
        "group_split": _with([*LAB, *_group_split()], "SELECT record_id, side FROM bygroup"),
        "row_split": _with([*LAB, *_row_split("s", 0.2)], "SELECT record_id, side FROM s"),
        "row_split_70_30": _with([*LAB, *_row_split("s", 0.3)], "SELECT record_id, side FROM s"),
        "kfold_assignment": _with([*LAB, *_folds()], "SELECT record_id, fold FROM folds"),
        "split_analysis": _analysis(),
        "shared_vectors": _shared(),
        "confusion_matrix": _confusion(),
        "class_metrics": _class_metrics(),
        "coverage": _coverage(),
        "error_rows": _errors(),
        "threshold_experiments": _with(_experiments(), "SELECT * FROM experiments"),
        "selected_threshold": _with(
            _experiments(),
            "SELECT min_confidence, accuracy, macro_f1, kept_rules FROM experiments ORDER BY macro_f1 DESC, accuracy DESC, min_confidence DESC LIMIT 1",
        ),
        "baseline_compare": _compare(),
        "cross_validation": _cross(),
        "model_summary": _model_summary(),
        "class_relative_evaluation": _relative_evaluation(),
        "quality_summary": _with(_quality_ctes(), "SELECT * FROM qual"),
        "conflicting_groups": _with(
            _quality_ctes(), f"SELECT {F9}, {', '.join(NAMES)} FROM vecs WHERE labels > 1"
        ),
        "eda_profile": _eda(),
        "value_frequencies": _frequencies(),
        "correlation_matrix": _correlations(),
        "url_redaction": _redacted("request_urls", "request_id"),
        "url_redaction_pages": _redacted("raw_pages", "page_id"),
        "url_screening": _with(_screened("request_urls"), "SELECT request_id, host, url_error FROM screened"),
        "external_links": _links(),
        "page_observations": _page_observations("raw_pages"),
        "rendered_page_observations": _page_observations("rendered_pages"),
        "raw_feature_values": _raw_values(),
        "registrable_domain": _with(_domains(), "SELECT page_id, host, registrable_domain FROM doms"),
        "domain_age": _with(
            _ages(),
            "SELECT page_id, domain, created_micros, round(age_days, 6) AS age_days, round(age_days / (365.2425 / 12), 6) AS age_months, status FROM ages",
        ),
        "traffic_status": _with(
            [*_domains(), _derived("ranks")],
            "SELECT page_id, host AS domain, k.rank, k.provider, CASE WHEN k.rank IS NULL THEN 'provider_unavailable' ELSE 'available' END AS status "
            "FROM hosts h LEFT JOIN ranks k ON k.domain = h.host",
        ),
        "encode_features": _encode_features(),
        "encode_gate": _encode_gate(),
        "history_overview": _overview(),
        "history_filtered": _with(
            [_derived("history"), FILTERED],
            "SELECT id, url, prediction, label, prediction_status, created_at FROM filtered WHERE label = 'Phishy' AND prediction_status = 'predicted'",
        ),
        "history_rule_counts": _with(
            _history_counts("history"), "SELECT id, prediction_status, label, rule_count FROM counted"
        ),
        "rule_evidence": _with(
            _history_counts("filtered"),
            "SELECT count(*) FILTER (rule_count > 0) AS predictions_with_rules, count(*) FILTER (rule_count = 0) AS predictions_without_rules, "
            "round(avg(rule_count), 10) AS average_matching_rules, count(rule_count) AS prediction_count FROM counted",
        ),
        "feature_distribution": _distribution(),
        "recent_activity": _with(
            _history_counts("filtered"),
            "SELECT id, created_at, url, label, prediction_status AS status, rule_count FROM counted ORDER BY created_at DESC, id DESC LIMIT 20",
        ),
        "report_projection": _report(),
        "dataset_fingerprint": _fingerprint(),
        "rule_store_roundtrip": _with(mined, f"SELECT {RULE_COLUMNS} FROM m_rules"),
        "legacy_history": _with(
            [_derived("history")],
            "SELECT id, url, prediction, label, 'predicted' AS prediction_status, created_at FROM history",
        ),
        "item_table_roundtrip": _with(
            LAB,
            f"SELECT 'Result=' || {_label('Result')} AS class_item, count(*) AS row_count, count(DISTINCT ({F9})) AS unique_rows FROM lab GROUP BY Result",
        ),
    }
