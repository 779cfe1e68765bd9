"""Quality rules: per-text base measures and cross-document line frequency.

Only DataFrame functions run here.  Arrays of a text are worked on in its row;
what is shuffled are line hashes, counted per host over distinct texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.llm.common import BLANKS, landed, let

MIN_WORDS = 10
REPEAT_PERCENT = 20
#: A line is boilerplate of a host if it stands in this many distinct texts, however many the host has: texts written
#: apart do not share whole lines, and a template of one part of a large host is as much a template as that of a small host.
MIN_TEXTS = 20
#: A document is depleted if less than this share of its words stays without such lines.
MIN_LEFT = 0.5
SYMBOLS = "#*$%&|<>"
#: Frequent lines up to this number, and up to this number of one host, are broadcast; more go by shuffle.
BROADCAST_LINES, HOST_LINES = 200_000, 2_000
_GAP = "[ \\t-\\r]+"
#: Gaps that are not a single space already.
_LONG_GAP = "[ \\t-\\r]{2,}|[\\t-\\r]"


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP))


def repeat_words(items: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the array, each once."""

    def window(hashes: Column) -> Column:
        return F.slice(
            F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2), F.get(hashes, i + 3), F.get(hashes, i + 4))),
            1, F.size(hashes) - 4,
        )

    def covered(windows: Column) -> Column:
        tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            return F.filter(rows, lambda x, i: (F.get(rows, i - 1)["h"] == x["h"]) | F.coalesce(F.get(rows, i + 1)["h"] == x["h"], F.lit(False)))

        def span(starts: Column) -> Column:
            steps = F.transform(starts, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(starts, i + 1) - x, F.lit(5))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(tagged, twice), lambda rows: let(F.sort_array(F.transform(rows, lambda x: x["i"])), span))

    def judged(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered(windows))

    hashed = F.transform(items, lambda x: F.xxhash64(x))
    return F.when(F.size(items) < 6, F.lit(0).cast("long")).otherwise(let(let(hashed, window), judged))


def base_measures(documents: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed for each row.

    A null text has no words and no lines, so every count is 0 and it fails.
    Window equality is that of 64-bit hashes within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    frame = documents.withColumn("_words", words(text))
    frame = frame.withColumn("_repeat", repeat_words(F.col("_words"))).withColumn("n_words", F.size("_words").cast("long")).drop("_words")
    measured = {
        "word_chars": F.char_length(reduce(lambda rest, blank: F.replace(rest, F.lit(blank), F.lit("")), BLANKS, text)).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_repeat"),
    }
    frame = frame.withColumns(measured).drop("_repeat")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return frame.withColumn("base_failed", failed)


def line_key(line: Column) -> Column:
    """Hash of a line in lower case, digits as 0, runs of blanks as one; null without a word."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), "[1-9]", "0"), _LONG_GAP, " "), F.lit(BLANKS))
    return let(plain, lambda x: F.when(x != "", F.xxhash64(x)))


def _keys(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), line_key), lambda x: x.isNotNull()))


def frequent_lines(documents: DataFrame, host: str = "source", min_texts: int = MIN_TEXTS) -> DataFrame:
    """(host, line) of line hashes that stand in too many distinct texts of a host.

    Copies of a text count once, so that a group of copies alone makes no line
    frequent.  The limit is a number of texts, not a share, so it does not grow
    with the host.  Null hosts are a host of their own.
    """
    texts = documents.where(F.col("text").isNotNull()).select(F.col(host).alias("host"), F.xxhash64("text").alias("same"), "text")
    pairs = texts.select("host", "same", F.explode(_keys(F.col("text"))).alias("line"))
    counted = pairs.groupBy("host", "line").agg(F.countDistinct("same").alias("n")).where(F.col("n") >= min_texts)
    return landed(counted.select("host", "line"), "frequent-lines")


def judge(documents: DataFrame, host: str = "source", min_left: float = MIN_LEFT) -> DataFrame:
    """Every row with its measures, left_text, n_left_words and kept; other columns stay.

    left_text is the text without frequent lines, the others in their order; a
    text without frequent lines stays as it is, null too.  A row is rejected if its base measures fail, or if fewer than MIN_WORDS words
    or less than `min_left` of its words stand outside frequent lines.  Rows with
    equal texts of one host get equal results; an empty table stays empty.
    """
    frequent = frequent_lines(documents, host)
    measured = base_measures(documents)
    lines, most = frequent.groupBy("host").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    if lines <= BROADCAST_LINES and most <= HOST_LINES:
        by_host = frequent.groupBy(F.col("host").alias("_host")).agg(F.collect_list("line").alias("_lines"))
        measured = measured.join(F.broadcast(by_host), F.col(host).eqNullSafe(F.col("_host")), "left")
    else:
        rows = documents.where(F.col("text").isNotNull()).select(F.col(host).alias("host"), F.xxhash64("text").alias("_same"), F.explode(_keys(F.col("text"))).alias("line"))
        rows = rows.distinct().alias("r").join(frequent.alias("f"), F.expr("r.line = f.line AND r.host <=> f.host"), "left_semi")
        own = rows.groupBy(F.col("host").alias("_host"), "_same").agg(F.collect_list("line").alias("_lines"))
        same = F.col(host).eqNullSafe(F.col("_host")) & (F.xxhash64("text") == F.col("_same"))
        measured = measured.join(own, same, "left").drop("_same")
    text = F.coalesce(F.col("text"), F.lit(""))

    def left(bad: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains(bad, line_key(x)), F.lit(False)))
        return F.array_join(lines, "\n")

    bad = F.array_intersect(_keys(text), F.col("_lines"))
    cut = F.when(F.col("_lines").isNotNull(), let(bad, lambda b: F.when(F.size(b) > 0, left(b))))
    measured = measured.withColumn("_left", cut).drop("_lines", "_host")
    n_left = F.when(F.col("_left").isNull(), F.col("n_words")).otherwise(F.size(words(F.col("_left"))).cast("long"))
    measured = measured.withColumns({"n_left_words": n_left, "left_text": F.coalesce("_left", "text")}).drop("_left")
    depleted = (F.col("n_left_words") < MIN_WORDS) | (F.col("n_left_words") < min_left * F.col("n_words"))
    return measured.withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(documents: DataFrame, host: str = "source", min_left: float = MIN_LEFT) -> DataFrame:
    """The kept rows, `text` without frequent lines; other columns stay."""
    judged = judge(documents, host, min_left)
    # in one array, so that the filter is not moved below the measures, which would then be taken twice
    kept = judged.select(*documents.drop("text").columns, F.inline(F.array(F.struct("kept", F.col("left_text").alias("text")))))
    return kept.where("kept").select(documents.columns)
