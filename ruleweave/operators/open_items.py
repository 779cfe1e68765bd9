"""Mining and matching of open item sets, where items cannot be packed into a key.

Equal baskets are counted first and mined once, by pattern growth over Spark's
groupings, so the rows of a large table never stand before the miner one by one.  Whether a basket holds a rule is a set
containment join: every rule waits at its rarest item, so only baskets with that
item are held against it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleweave.operators.mining import Mining
from ruleweave.session import settle

#: Stands before the class of a basket, so that it is no item's namesake.
_CLASS = "\x01"


def _items(column: str = "items"):
    """Distinct items without nulls."""
    return F.array_distinct(F.array_compact(F.coalesce(F.col(column), F.array().cast("array<string>"))))


def frequent_sets(baskets: DataFrame, least: int) -> DataFrame:
    """``items, freq`` of the item sets that stand in ``least`` of the weighted baskets (distinct ``items``, ``n``).

    Pattern growth as in FP-growth, one level at a time: a set waits with what its
    baskets hold beyond it, equal remainders as one weighted row, and is extended
    by each item of them.  Items go from rare to frequent, so the remainders are
    made of frequent items and many are equal.  Everything is grouped by Spark; no
    tree is held anywhere.
    """
    held = settle(baskets.withColumn("basket", F.monotonically_increasing_id()))
    counts = held.select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)
    # at most the mean basket size over the least support
    names = settle(counts.withColumn("code", F.row_number().over(Window.orderBy("freq", "item"))))
    coded = held.select("basket", "n", F.explode("items").alias("item")).join(names, "item")
    coded = coded.groupBy("basket").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("code")).alias("rest"))
    bases = coded.groupBy("rest").agg(F.sum("n").alias("n")).withColumn("codes", F.array().cast("array<int>"))
    levels = []
    while True:
        grown = bases.select("codes", "rest", "n", F.posexplode("rest").alias("at", "code"))
        grown = grown.select(F.array_append("codes", F.col("code")).alias("codes"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "n")
        grown = settle(grown.groupBy("codes", "rest").agg(F.sum("n").alias("n")))
        often = settle(grown.groupBy("codes").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least))
        if often.isEmpty():
            break
        levels.append(often)
        bases = grown.where(F.size("rest") > 0).join(often.select("codes"), "codes")
    if not levels:
        return baskets.select("items", F.col("n").alias("freq")).limit(0)
    every = reduce(DataFrame.unionByName, levels).withColumn("set", F.monotonically_increasing_id())
    named = settle(every).select("set", "freq", F.explode("codes").alias("code")).join(names.select("code", "item"), "code")
    return named.groupBy("set").agg(F.collect_list("item").alias("items"), F.first("freq").alias("freq")).select("items", "freq")


def class_rules(baskets: DataFrame, mining: Mining) -> DataFrame:
    """Rules of baskets (``items``, ``consequent``) whose consequent is a class, unranked.

    Repeated and null items count once or not at all.  A basket without a class
    supports antecedents only.
    """
    tagged = F.concat(F.lit(_CLASS), F.col("consequent"))
    rows = baskets.select(F.array_sort(_items()).alias("items"), tagged.alias("class"))
    rows = settle(rows.groupBy("items", "class").agg(F.count("*").alias("n")))
    n = rows.agg(F.sum("n")).first()[0]
    if not n:
        return baskets.sparkSession.createDataFrame([], "antecedent array<string>, consequent string, support double, confidence double, lift double, antecedent_length int")
    transactions = rows.select(F.array_compact(F.array_append("items", F.col("class"))).alias("items"), "n")
    found = settle(frequent_sets(transactions, math.ceil(mining.min_support * n)))
    is_class = lambda item: item.startswith(_CLASS)
    sets = found.select(
        F.array_sort(F.filter("items", lambda i: ~is_class(i))).alias("antecedent"), F.filter("items", is_class).alias("classes"), "freq"
    )
    covered = sets.where("size(classes) = 0").select("antecedent", F.col("freq").alias("covered"))
    classes = rows.where("class is not null").groupBy("class").agg(F.sum("n").alias("class_n"))
    joint = sets.where("size(classes) = 1 and size(antecedent) > 0").select("antecedent", F.col("classes")[0].alias("class"), "freq")
    rules = joint.join(covered, "antecedent").join(classes, "class")
    if mining.max_len is not None:
        rules = rules.where(F.size("antecedent") < mining.max_len)
    rules = (
        rules.withColumn("support", F.col("freq") / F.lit(n))
        .withColumn("confidence", F.col("support") / (F.col("covered") / F.lit(n)))
        .withColumn("lift", F.col("confidence") / (F.col("class_n") / F.lit(n)))
    )
    kept = (F.col("support") >= mining.min_support) & (F.col("confidence") >= mining.min_confidence) & (F.col("lift") >= mining.min_lift)
    consequent = F.substring("class", 2, 1 << 30).alias("consequent")
    return rules.where(kept).select("antecedent", consequent, "support", "confidence", "lift", F.size("antecedent").alias("antecedent_length"))


def matches(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """``id, rule`` of every basket (``id``, ``items``) that holds all of a rule's ``antecedent`` items.

    Rules with an item that no basket has are dropped before the join, and an empty
    antecedent matches nothing.
    """
    held = baskets.select("id", _items().alias("items"))
    wanted = rules.select("rule", _items("antecedent").alias("antecedent"))
    parts = wanted.select("rule", F.explode("antecedent").alias("item"))
    # frequencies of the items that rules ask for, summed up before they are dealt
    named = held.select(F.explode("items").alias("item")).join(parts.select("item").distinct(), "item", "left_semi")
    counts = named.groupBy("item").agg(F.count("*").alias("baskets"))
    rarest = parts.join(counts, "item", "left").groupBy("rule").agg(
        F.min_by("item", F.struct("baskets", "item")).alias("item"), F.bool_and(F.col("baskets").isNotNull()).alias("possible")
    )
    waiting = settle(wanted.join(rarest.where("possible").drop("possible"), "rule"))
    sought = waiting.select("item").distinct()
    met = held.select("id", "items", F.explode("items").alias("item")).join(sought, "item", "left_semi")
    inside = F.size(F.array_except("antecedent", "items")) == 0
    return met.join(waiting, "item").where(inside).select("id", "rule")
