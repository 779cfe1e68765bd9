"""Rule evidence for records, built per distinct vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweave.contract import DOMAINS, FEATURES
from ruleweave.functions import keys
from ruleweave.functions.items import label_text
from ruleweave.operators.scoring import feature_evidence, matches, top_matches
from ruleweave.session import settle


def distinct_vectors(frame: DataFrame) -> DataFrame:
    """Vectors that occur: at most 3**9 rows, by partial aggregation."""
    return (
        frame.select(keys.pack().alias("vector")).where(F.col("vector").isNotNull()).distinct()
    )


#: The fields of a rule that explanations show.
VIEW = ("antecedent", "consequent", "class", "class_label", "support", "confidence", "lift", "antecedent_length")
#: What documents say about their evidence.
RANKING = "confidence, lift, support and length descending, then class and antecedent ascending"
LIMITATIONS = (
    "Evidence comes from mined rules; it shows no causes and is no calibrated probability, "
    "and the meaning of feature codes is not interpreted."
)


def vector_matches(vectors: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule matches of the given vectors only."""
    return matches(rules).join(F.broadcast(vectors.select("vector")), "vector", "left_semi")


def _views(rules: DataFrame) -> DataFrame:
    """What explanations show of each rule, told apart by run and rank."""
    return rules.select("run", "rank", *[label_text(F.col("class")).alias(c) if c == "class_label" else F.col(c) for c in VIEW])


def top_rules_per_vector(vectors: DataFrame, rules: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` strongest matching rules of every vector and run, one row each."""
    return _top(vector_matches(vectors, rules), rules, k)


def _top(matched: DataFrame, rules: DataFrame, k: int) -> DataFrame:
    return top_matches(matched, k).join(F.broadcast(_views(rules).drop("class")), ["run", "rank"])


def evidence(vectors: DataFrame, rules: DataFrame) -> DataFrame:
    """Nine rows per vector: feature, value, domain, matching rules, strongest rule.

    Features without any matching rule are kept with a count of 0.  ``strongest``
    is the whole rule, ``strongest_rule`` its antecedent as text.  The rules are
    those of one run; of several each gives the rows of the features it uses.
    """
    return _evidence(vectors, vector_matches(vectors, rules), rules)


def _evidence(vectors: DataFrame, matched: DataFrame, rules: DataFrame) -> DataFrame:
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(name).alias("feature"),
                keys.value(F.col("vector"), i).cast("int").alias("value"),
                F.array(*[F.lit(v) for v in DOMAINS[name]]).alias("allowed_values"),
            )
            for i, name in enumerate(FEATURES)
        ]
    )
    found = feature_evidence(matched).select(
        "run", "vector", "position", "matching_rule_count", "strongest_rank"
    )
    strongest = _views(rules).select(
        "run",
        F.col("rank").alias("strongest_rank"),
        F.array_join("antecedent", "|").alias("strongest_rule"),
        F.struct(*VIEW).alias("strongest"),
    )
    return (
        vectors.select("vector", F.inline(entries))
        .join(found, ["vector", "position"], "left")
        .join(F.broadcast(strongest), ["run", "strongest_rank"], "left")
        .withColumn("matching_rule_count", F.coalesce("matching_rule_count", F.lit(0)).cast("long"))
    )


def explanations(vectors: DataFrame, rules: DataFrame, k: int = 5) -> DataFrame:
    """One document per vector: total matches, top rules, evidence, a flag and what the evidence means.

    The rules are those of one run.  A vector has at most 511 * 3 matches and nine
    features, so the arrays are bounded; rows join this table on the packed vector.
    """
    matched = settle(vector_matches(vectors, rules))  # three tables are taken from it
    top = (
        _top(matched, rules, k)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list(F.struct("position", *VIEW))).alias("matching_rules"))
    )
    shown = ("position", "feature", "value", "allowed_values", "matching_rule_count", "strongest_rule", "strongest")
    features = (
        _evidence(vectors, matched, rules)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list(F.struct(*shown))).alias("feature_evidence"))
    )
    counts = matched.groupBy("vector").agg(F.count("*").alias("matching_rule_count"))
    joined = features.join(counts, "vector", "left").join(top, "vector", "left")
    return (
        joined.withColumn("matching_rule_count", F.coalesce("matching_rule_count", F.lit(0)).cast("long"))
        .withColumn("has_matching_rules", F.col("matching_rule_count") > 0)
        .withColumn("ranking", F.lit(RANKING))
        .withColumn("limitations", F.lit(LIMITATIONS))
    )
