"""Public suffix rules as a trie of labels, read from the right."""

from __future__ import annotations

import sys
from collections.abc import Iterable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get these functions by value, so executors need none of this package's files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A rule set is reference data of some ten thousand rows; a table beyond this is not one.
MOST_RULES = 1_000_000
_RULE, _EXCEPTION = "", "!"  # marks at a node; no label is empty or has an exclamation mark


def trie(rules: Iterable[str]) -> dict:
    """Nested labels from the right; labels beyond ASCII also stand in their encoded form."""
    root: dict = {}
    for rule in rules:
        plain = rule.strip().lower().strip(".")
        for text in {plain.lstrip("!"), _encoded(plain.lstrip("!"))}:
            node = root
            for label in reversed(text.split(".")):
                node = node.setdefault(label, {})
            node[_EXCEPTION if plain.startswith("!") else _RULE] = {}
    return root


def _encoded(name: str) -> str:
    try:
        return name if name.isascii() else ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split("."))
    except UnicodeError:
        return name


def registrable(root: dict, host: str | None) -> str | None:
    """One label more than the public suffix of a host; None if there is none or nothing is left of it.

    All nodes that fit the labels so far are followed at once, by name and by
    wildcard.  An exception wins and is one label too long; else the longest rule does.
    """
    if host is None:
        return None
    name = host.strip(" ").lower().rstrip(".")
    labels = name.split(".")
    if "" in labels:
        return None
    nodes, length = [root], 0
    for depth, label in enumerate(reversed(labels), 1):
        nodes = [node[x] for node in nodes for x in (label, "*") if x in node]
        if not nodes:
            break
        if any(_EXCEPTION in node for node in nodes):
            length = depth - 1
            break
        if any(_RULE in node for node in nodes):
            length = depth
    return ".".join(labels[-length - 1 :]) if 0 < length < len(labels) else None


def registrable_domain(host: Column, suffixes: DataFrame) -> Column:
    """`registrable` of a host column by the ``rule`` column of a table."""
    rules = [r["rule"] for r in suffixes.where("rule is not null").select("rule").distinct().limit(MOST_RULES + 1).collect()]
    if len(rules) > MOST_RULES:
        raise ValueError(f"a suffix list has at most {MOST_RULES} rules")
    shared = suffixes.sparkSession.sparkContext.broadcast(trie(rules))

    @F.arrow_udf(T.StringType())
    def found(hosts: pa.Array) -> pa.Array:
        root, known = shared.value, hosts.dictionary_encode()
        domains = pa.array([registrable(root, h.as_py()) for h in known.dictionary], pa.string())
        return domains.take(known.indices)

    return found(host)


def read_suffix_list(spark: SparkSession, path: str, private: bool = True) -> DataFrame:
    """The ``rule`` column of files in the usual list format.

    A line holds a rule up to its first white space; lines that start with // are
    comments, one of which opens the private part of a file.
    """
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\R").alias("lines"))
    mark = F.array_position("lines", "// ===BEGIN PRIVATE DOMAINS===")
    kept = F.col("lines") if private else F.when(mark > 0, F.slice("lines", F.lit(1), mark.cast("int"))).otherwise(F.col("lines"))
    rules = lines.select(F.explode(kept).alias("line")).select(F.regexp_extract("line", r"^\s*(\S+)", 1).alias("rule"))
    return rules.where((F.col("rule") != "") & ~F.col("rule").startswith("//")).distinct()
