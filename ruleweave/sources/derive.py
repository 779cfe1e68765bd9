"""Page, provider and history inputs derived row by row from the test tables.

Each derivation is a list of SQL expressions over one table.  Spark and the
checking engine read the same text; only integer division and repeated text
are spelled per dialect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ruleweave.session import spread
from ruleweave.sources.frames import table


class SparkText:
    @staticmethod
    def div(a: str, b: int) -> str:
        return f"({a} div {b})"

    @staticmethod
    def each(n: str, body: str) -> str:
        """``body`` for i = 1..n, joined."""
        return f"if({n} > 0, array_join(transform(sequence(1, {n}), i -> {body}), ''), '')"

    @staticmethod
    def texts(*items: str) -> str:
        return f"cast(array({', '.join(items)}) as array<string>)"


class CheckText:
    @staticmethod
    def div(a: str, b: int) -> str:
        return f"({a} // {b})"

    @staticmethod
    def each(n: str, body: str) -> str:
        return f"coalesce(array_to_string(list_transform(range(1, {n} + 1), lambda i: {body}), ''), '')"

    @staticmethod
    def texts(*items: str) -> str:
        return f"cast([{', '.join(items)}] as varchar[])"


@dataclass(frozen=True)
class Derivation:
    source: str
    columns: tuple[tuple[str, str], ...]  # alias, expression
    where: str = "true"
    heavy: bool = False  # much work per row follows

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.source)
        return (
            (spread(rows) if self.heavy else rows)
            .where(self.where)
            .selectExpr(*[f"{text} AS {alias}" for alias, text in self.columns])
        )

    def sql(self) -> str:
        columns = ", ".join(f"{text} AS {alias}" for alias, text in self.columns)
        return f"SELECT {columns} FROM {self.source} WHERE {self.where}"


def _vector(codes: dict[str, str], extra: str = "''") -> str:
    """JSON text of a vector; every code is an expression giving JSON text or ''."""
    pieces = " || ',' || ".join(f"'\"{name}\":' || {code}" for name, code in codes.items())
    return f"('{{' || {pieces} || {extra} || '}}')"


def rendered_pages(d) -> Derivation:
    """Web pages with all kinds of tags, one per order."""
    k, c = "o_orderkey", "o_custkey"
    host = (
        f"CASE WHEN {k} % 29 = 0 THEN '93.184.' || ({k} % 200) || '.' || ({c} % 200) "
        f"WHEN {k} % 31 = 0 THEN '[2606:2800:220:1::' || ({k} % 9 + 1) || ']' "
        f"ELSE 'www.shop' || {c} || CASE {k} % 3 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.com' "
        "ELSE '.example.org' END END"
    )
    url = (
        f"CASE WHEN {k} % 5 = 0 THEN 'http' ELSE 'https' END || '://' || {host} || '/' || "
        f"repeat('item', cast({k} % 19 as int)) || '/' || {k} || "
        f"CASE WHEN {k} % 4 = 0 THEN '?ref=' || ({c} % 7) ELSE '' END"
    )
    script = (
        f"CASE {k} % 6 WHEN 0 THEN '<script>window.open(\"/popup\");</script>' "
        f"WHEN 1 THEN '<script src=\"https://cdn' || ({c} % 5) || '.example.net/app.js\"></script>' "
        "WHEN 2 THEN '<script>var t=\"<a href=http://fake.example>x</a>\";</script>' ELSE '' END"
    )
    image = (
        f"'<img alt=\"a>b\" src=\"' || CASE WHEN (i * {c}) % 3 = 0 THEN "
        f"'https://img' || ({c} % 4) || '.cdn.example.net/' || i ELSE '/img/' || i END || '.png\">'"
    )
    anchor = (
        f"CASE (i + {c}) % 6 WHEN 0 THEN '<a href=\"https://partner' || (i % 3) || '.example.org/p\">' "
        "WHEN 1 THEN '<a href=\"/local/' || i || '\">' WHEN 2 THEN '<A HREF=\"\">' "
        "WHEN 3 THEN '<a class=\"n\" href=\"javascript:void(0)\">' "
        "WHEN 4 THEN '<a href=''//other.example.com/x?a=1&amp;b=2''>' ELSE '<a name=\"x\">' END || 'x</a>'"
    )
    form = (
        f"CASE {k} % 8 WHEN 1 THEN '<form action=\"\"></form>' WHEN 2 THEN '<form action=\"about:blank\"></form>' "
        "WHEN 3 THEN '<form action=\"/submit\"></form>' "
        "WHEN 4 THEN '<form method=post action=https://collect.example.net/in></form>' "
        "WHEN 5 THEN '<form></form>' "
        "WHEN 6 THEN '<form action=\"/a\"></form><form action=\"https://x.example.org\"></form>' "
        "WHEN 7 THEN '<form action=\"/submit\"></form>' ELSE '' END"
    )
    field = (
        f"CASE {k} % 5 WHEN 0 THEN '<input type=\"PASSWORD\" name=\"p\">' "
        "WHEN 1 THEN '<input type=text>' WHEN 2 THEN '<textarea type=\"email\"></textarea>' ELSE '' END"
    )
    html = (
        f"CASE WHEN {k} % 17 = 0 THEN NULL ELSE "
        "'<!DOCTYPE html><html><head><!-- <img src=\"http://hidden.example/x.png\"> -->' || "
        f"CASE WHEN {k} % 2 = 0 THEN '<link rel=\"stylesheet\" href=\"/css/' || ({k} % 4) || '.css\">' ELSE '' END || "
        f"{script} || '</head><body><article>' || "
        f"{d.each(f'cast({k} % 7 as int)', image)} || {d.each(f'cast({k} % 11 as int)', anchor)} || "
        f"{form} || {field} || '</article></body></html>' END"
    )
    return Derivation("orders", (("page_id", k), ("url", url), ("html", html)), heavy=True)


def raw_pages(d) -> Derivation:
    columns = (("page_id", "page_id"), ("url", "url"), ("html", "html"))
    return Derivation("pages", columns, heavy=True)


def request_urls(d) -> Derivation:
    """URLs as users type them, good and bad, one per order."""
    k, c = "o_orderkey", "o_custkey"
    url = (
        f"CASE {k} % 16 WHEN 0 THEN 'ftp://shop' || {c} || '.example' WHEN 1 THEN 'http://localhost/' || {k} "
        f"WHEN 2 THEN 'http://10.' || ({c} % 256) || '.0.1/' WHEN 3 THEN 'http://[::1]/' || {k} "
        f"WHEN 4 THEN 'https://user:pw' || {k} || '@shop.example/p' WHEN 5 THEN 'not-a-url-' || {k} "
        f"WHEN 6 THEN 'https://shop' || {c} || '.example/' || repeat('x', 2100) "
        f"WHEN 7 THEN 'http://172.' || ({c} % 64) || '.1.' || ({k} % 256) || '/a' "
        f"WHEN 8 THEN '  https://Shop' || {c} || '.Example.com:8443/Cart?id=' || {k} || '#top ' "
        f"WHEN 9 THEN 'https://printer' || {c} || '.local/' WHEN 10 THEN 'http://192.0.2.' || ({k} % 256) "
        f"WHEN 11 THEN 'https://shop_' || {c} || '.example/a;v=1?q' "
        f"WHEN 12 THEN 'http://[2606:2800::' || ({k} % 10) || ']:80/' WHEN 13 THEN 'https://api.internal./' "
        f"WHEN 14 THEN 'http://8.8.' || ({k} % 256) || '.' || ({c} % 300) || '/' ELSE 'https://shop' || {c} || '.example' END"
    )
    return Derivation("orders", (("request_id", k), ("url", url)), heavy=True)


def registrations(d) -> Derivation:
    """Registration records, one per customer; one shared domain is customer 0's."""
    c = "c_custkey"
    domain = (
        f"CASE WHEN {c} = 0 THEN 'example.org' WHEN {c} % 2 = 0 THEN 'shop' || {c} || '.co.uk' "
        f"ELSE 'shop' || {c} || '.com' END"
    )
    first = (
        f"(1990 + {c} % 30) || CASE {c} % 5 WHEN 0 THEN '0' || ({c} % 9 + 1) || '1' || ({c} % 10) "
        f"WHEN 1 THEN '-W' || ({c} % 5) || ({c} % 9 + 1) || '-' || ({c} % 7 + 1) WHEN 2 THEN 'W' || ({c} % 5) || ({c} % 9 + 1) "
        f"ELSE '-0' || ({c} % 9 + 1) || '-1' || ({c} % 10) END"
    )
    second = (
        f"(1995 + {c} % 21) || '-1' || ({c} % 3) || '-2' || ({c} % 9) || "
        f"CASE {c} % 4 WHEN 0 THEN ' 1' || ({c} % 10) WHEN 1 THEN 'T0' || ({c} % 10) || '30' ELSE 'T0' || ({c} % 10) || ':30:00,25' END"
    )
    zone = f"CASE {c} % 6 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '-05' WHEN 3 THEN '+0130' ELSE '' END"
    dates = (
        f"CASE {c} % 7 WHEN 1 THEN {d.texts(repr('not-a-date'))} WHEN 2 THEN {d.texts()} WHEN 3 THEN NULL "
        f"ELSE {d.texts(f'({second} || {zone})', f'({first})', repr('unknown'))} END"
    )
    return Derivation("customer", (("domain", domain), ("creation_date", dates)))


def ranks(d) -> Derivation:
    """A traffic listing, one row per supplier."""
    s = "s_suppkey"
    return Derivation(
        "supplier",
        (
            ("domain", f"'www.shop' || {s} || '.com'"),
            ("rank", f"{s} + 1"),
            ("provider", "'listing'"),
        ),
    )


def vector_requests(d) -> Derivation:
    """Requests for vectors, some with blanks around the URL, some unknown to the provider, some refused."""
    k, c = "o_orderkey", "o_custkey"
    url = (
        f"CASE {k} % 17 WHEN 0 THEN '  https://shop' || {c} || '.example/ ' WHEN 1 THEN 'https://gone' || {c} || '.example/' "
        f"WHEN 2 THEN 'http://localhost/' || {c} WHEN 3 THEN 'ftp://shop' || {c} || '.example/' "
        f"ELSE 'https://shop' || {c} || '.example/' END"
    )
    return Derivation("orders", (("request_id", k), ("url", url)), heavy=True)


def vector_provider(d) -> Derivation:
    """Vectors a trusted provider holds for its customers, some of them broken, some URLs twice."""
    c = "c_custkey"
    code = lambda n: f"({d.div(c, 3**n)} % 3 - 1)"
    codes = {
        "SFH": f"CASE WHEN {c} % 23 = 0 THEN '9' WHEN {c} % 29 = 0 THEN '\"x\"' ELSE '' || {code(0)} END",
        "popUpWidnow": code(1),
        "SSLfinal_State": code(2),
        "Request_URL": code(3),
        "URL_of_Anchor": code(4),
        "web_traffic": code(5),
        "URL_Length": code(0),
        "age_of_domain": f"CASE WHEN {c} % 2 = 0 THEN -1 ELSE 1 END",
        "having_IP_Address": f"CASE WHEN {c} % 10 = 0 THEN 0 ELSE 1 END",
    }
    return Derivation(
        "customer",
        (("url", f"'https://shop' || ({c} - CASE WHEN {c} % 31 = 0 THEN 1 ELSE 0 END) || '.example/'"), ("features", _vector(codes))),
        heavy=True,
    )


def history(d) -> Derivation:
    """Prediction history, one row per event, with text, broken and extra codes."""
    e, u = "event_id", "user_id"
    kept = f"CASE WHEN {e} % 13 = 0 THEN '' ELSE ',\"web_traffic\":' || ({d.div(e, 9)} % 3 - 1) END"
    codes = {
        "SFH": (
            f"CASE WHEN {e} % 11 = 0 THEN '\"' || ({e} % 3 - 1) || '\"' WHEN {e} % 23 = 0 THEN '0.5' "
            f"WHEN {e} % 29 = 0 THEN '\"1.7\"' WHEN {e} % 31 = 0 THEN 'true' WHEN {e} % 37 = 0 THEN 'null' "
            f"ELSE '' || ({e} % 3 - 1) END"
        ),
        "popUpWidnow": f"({u} % 3 - 1)",
        "SSLfinal_State": "(cast(floor(value) as bigint) % 3 - 1)",
        "Request_URL": f"({d.div(e, 3)} % 3 - 1)",
        "URL_of_Anchor": f"({d.div(u, 3)} % 3 - 1)",
        "URL_Length": f"({d.div(u, 9)} % 3 - 1)",
        "age_of_domain": f"CASE WHEN {e} % 17 = 0 THEN 0 WHEN {u} % 2 = 0 THEN -1 ELSE 1 END",
        "having_IP_Address": f"CASE WHEN {u} % 10 = 0 THEN 0 ELSE 1 END",
    }
    extra = f"{kept} || CASE WHEN {e} % 19 = 0 THEN ',\"extra\":1' ELSE '' END"
    predicted = "event_type <> 'error'"
    prediction = "CASE event_type WHEN 'signup' THEN -1 WHEN 'click' THEN 0 WHEN 'error' THEN NULL ELSE 1 END"
    label = (
        "CASE event_type WHEN 'signup' THEN 'Phishy' WHEN 'click' THEN 'Suspicious' "
        "WHEN 'error' THEN NULL ELSE 'Legitimate' END"
    )
    features = (
        f"CASE WHEN {predicted} THEN {_vector(codes, extra)} "
        "ELSE '{\"SFH\":{\"encoded_value\":null}}' END"
    )
    return Derivation(
        "events",
        (
            ("id", e),
            ("url", f"'https://u' || {u} || '.example.com/' || event_type"),
            ("prediction", prediction),
            ("label", label),
            ("features", features),
            ("prediction_status", f"CASE WHEN {predicted} THEN 'predicted' ELSE 'feature_mapping_unavailable' END"),
            ("created_at", "ts"),
        ),
        heavy=True,
    )


def labelled_with_faults(d) -> Derivation:
    """Labelled records with missing and foreign codes, for the checks."""
    band = lambda x, lo, hi: f"CASE WHEN {x} < {lo} THEN -1 WHEN {x} <= {hi} THEN 0 ELSE 1 END"
    return Derivation(
        "lineitem",
        (
            ("SFH", f"CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE {band('l_quantity', 17, 34)} END"),
            ("popUpWidnow", band("l_linenumber", 3, 5)),
            ("SSLfinal_State", f"CASE WHEN l_orderkey % 101 = 0 THEN cast(l_quantity as int) ELSE {band('l_linenumber', 2, 4)} END"),
            ("Request_URL", "CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END"),
            ("URL_of_Anchor", band("l_linenumber", 3, 5)),
            ("web_traffic", "CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE cast(l_partkey % 3 - 1 as int) END"),
            ("URL_Length", "cast(l_suppkey % 3 - 1 as int)"),
            ("age_of_domain", "cast(l_suppkey % 3 - 1 as int)"),
            ("having_IP_Address", "CASE l_linestatus WHEN 'F' THEN -1 ELSE 1 END"),
            ("Result", "CASE WHEN l_partkey % 67 = 0 THEN 2 WHEN l_quantity < 20 THEN -1 ELSE 1 END"),
        ),
    )
