"""URL filtering by listed host rules and, beyond them, by mined association rules.

Urls that a listed rule decides are the labels.  Frequent-pattern growth finds
token combinations that go with one verdict; rules are pruned by support and
confidence and then looked up through an inverted index on one token of each.
Only DataFrame functions and Spark's own FP-growth run here.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import ascii_lower, landed

#: (verdict, host, path); a rule holds for the host and everything below it.
LISTED = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.6
#: Mined rules of at most this number are broadcast; more are joined by shuffle.
BROADCAST_RULES = 50_000
DEFAULT = "allow"
_VERDICT = "verdict="


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null url or one without ``://``."""
    rest = F.expr(f"coalesce(if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), ''), '')")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return ascii_lower(host), path


def listed_rule(rules=LISTED) -> Column:
    """The longest listed rule that fits columns host and path, as (rule, verdict), or null."""
    fits = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        inside = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        hit = inside & F.startswith(F.col("path"), F.lit(path))
        found = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(hit, found) if fits is None else fits.when(hit, found)
    return fits


def tokens(url: str = "url") -> Column:
    """Distinct tokens: host endings, path parts and query names, digits shown as ``#``."""
    labels = F.split("host", r"\.")
    endings = F.transform(labels, lambda x, i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    parts = F.transform(F.filter(F.split(F.regexp_replace("path", r"[0-9]+", "#"), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("part="), x))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^[^=]*", 0)))
    return F.array_distinct(F.concat(F.when(F.col("host") != "", endings).otherwise(F.array().cast("array<string>")), parts, F.when(query != "", names).otherwise(F.array().cast("array<string>"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Association rules (antecedent, verdict, confidence, support) from (tokens, verdict).

    Tokens that occur in exactly the same rows stand for each other, so one of
    them is mined; that keeps repeated long urls from multiplying patterns.  A
    rule is dropped if a part of its antecedent is at least as sure of the same
    verdict.  No labelled rows give no rules.
    """
    spark = labelled.sparkSession
    schema = "antecedent array<string>, verdict string, confidence double, support double"
    total = labelled.count()
    if not total:
        return spark.createDataFrame([], schema)
    least = max(1.0, total * min_support)
    marked = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("tokens", "verdict").cast("decimal(20,0)").alias("row"))
    seen = marked.groupBy("token").agg(F.count("*").alias("n"), F.sum("row").alias("rows")).where(F.col("n") >= least)
    # at most (tokens of a row) / min_support names
    names = [r.token for r in seen.groupBy("n", "rows").agg(F.max(F.struct(F.length("token"), "token")).alias("m")).select("m.token").collect()]
    kept = F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>")
    baskets = labelled.select(F.concat(F.array_intersect("tokens", kept), F.array(F.concat(F.lit(_VERDICT), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.startswith(F.element_at("consequent", 1), F.lit(_VERDICT)))
    found = found.select(
        F.sort_array("antecedent").alias("antecedent"),
        F.substring(F.element_at("consequent", 1), len(_VERDICT) + 1, 1000).alias("verdict"),
        "confidence",
        "support",
    )
    found = landed(found.where(F.size("antecedent") > 0), "url-rules")
    # every smaller antecedent of the same verdict, found through one of its tokens
    short = found.select(F.col("antecedent").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    short = short.withColumn("token", F.element_at("part", 1))
    long = found.select("*", F.explode("antecedent").alias("token"))
    covers = (long.verdict == short.v) & (F.size("part") < F.size("antecedent")) & (short.c >= long.confidence) & (F.size(F.array_except("part", "antecedent")) == 0)
    weak = long.join(short, (long.token == short.token) & covers, "left_semi").select("antecedent", "verdict").distinct()
    return landed(found.join(weak, ["antecedent", "verdict"], "left_anti"), "url-rules-pruned")


def judge(pages: DataFrame, listed=LISTED, mined: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of (page_id, url).

    The longest listed rule decides; else the mined rule with the highest
    confidence, then support, then the longer antecedent, then `block` before
    `allow`; else `allow`.  Null urls and urls without ``://`` have an empty host
    and path, no tokens and so the default.  Rules are mined from the pages
    themselves unless given, a repeated row once.  Repeated rows come out as often as they went in;
    null page ids stay null; other columns are ignored; no pages give no rows.
    """
    host, path = host_and_path("url")
    base = pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    base = base.withColumn("host", host).withColumn("path", path).withColumn("hit", listed_rule(listed))
    base = landed(base.withColumn("tokens", tokens()).withColumn("rule", F.col("hit.rule")).withColumn("listed", F.col("hit.verdict")).drop("hit"), "url-base")
    if mined is None:
        mined = mine(base.where("rule is not null").select("tokens", F.col("listed").alias("verdict")))
    index = mined.withColumn("token", F.element_at(F.sort_array("antecedent", asc=False), 1))
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    open_ = base.where("rule is null").select("page_id", "url", "copies", "host", "path", "rule", "listed", "tokens", F.explode_outer("tokens").alias("token"))
    asked = open_.join(index, "token", "left")
    fits = F.col("antecedent").isNotNull() & (F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.when(fits, F.struct("confidence", "support", F.size("antecedent").alias("n"), "verdict"))).alias("best")
    learned = asked.groupBy("page_id", "url", "copies", "host", "path").agg(best)
    learned = learned.select("page_id", "host", "path", "copies", F.lit(None).cast("string").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))
    decided = base.where("rule is not null").select("page_id", "host", "path", "copies", "rule", F.col("listed").alias("verdict"))
    out = decided.unionByName(learned)
    return out.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))), "page_id", "host", "path", "rule", "verdict").drop("col")
