"""Lookups that services answer one by one, as joins with tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.contract import FEATURES
from ruleweave.functions import suffixes as suffixes_of
from ruleweave.functions import urls, vectors
from ruleweave.functions.dates import parse_date
from ruleweave.operators.joins import Measured, lookup

MONTH_DAYS = 365.2425 / 12

# A short suffix list for use without a full one.
COMMON_SUFFIXES = (
    "com", "net", "org", "edu", "gov", "int", "mil", "info", "biz", "io", "co",
    "eu", "de", "fr", "es", "it", "nl", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk",
    "au", "com.au", "net.au", "org.au", "nz", "co.nz", "jp", "co.jp", "ne.jp", "or.jp",
    "br", "com.br", "in", "co.in", "cn", "com.cn", "za", "co.za",
    "us", "ca", "ch", "at", "be", "se", "no", "dk", "fi", "pl", "ru", "tr", "com.tr",
    "*.ck", "!www.ck",
)

def common_suffixes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(rule,) for rule in COMMON_SUFFIXES], "rule string")


def registrable_domain(frame: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """Add ``registrable_domain``: one label more than the longest public suffix.

    ``suffixes`` has a ``rule`` column with plain, ``*.`` and ``!`` rules.  The
    rules travel as one trie and each host is matched in one walk, without a join.
    NULL if no rule fits or the host is itself a suffix.
    """
    return frame.withColumn("registrable_domain", suffixes_of.registrable_domain(F.col(host), suffixes))


def earliest_date(values: Column) -> Column:
    """Earliest valid date of an array of texts; NULL if none is valid."""
    return F.array_min(F.filter(F.transform(values, parse_date), lambda d: d.isNotNull()))


def registration_age(
    frame: DataFrame, registrations: DataFrame | None, as_of: Column, host: str = "host", known: Measured | None = None
) -> DataFrame:
    """Add ``domain_information`` for the registrable domain of each row.

    ``registrations`` holds ``domain`` and ``creation_date`` (array of texts) and
    may be large; it is reduced to one date per domain before the join.
    """
    domain = F.col("registrable_domain")
    if registrations is None:
        frame = frame.withColumn("created", F.lit(None).cast("timestamp")).withColumn(
            "known", F.lit(None).cast("boolean")
        )
    else:
        dates = registrations.groupBy(F.col("domain").alias("registrable_domain")).agg(
            F.min(earliest_date(F.col("creation_date"))).alias("created"),
            F.lit(True).alias("known"),
        )
        frame = lookup(frame, dates, "registrable_domain", known=known)
    days = F.greatest(
        F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros("created")) / F.lit(86_400_000_000)
    )
    days = F.when(F.col("created").isNotNull(), days)
    status = (
        F.when(domain.isNull(), "registrable_domain_unavailable")
        .when(F.col("known").isNull(), "provider_unavailable")
        .when(F.col("created").isNull(), "creation_date_unavailable")
        .otherwise("available")
    )
    return frame.withColumn(
        "domain_information",
        F.struct(
            F.coalesce(domain, F.col(host)).alias("domain"),
            F.col("created").alias("creation_date"),
            days.alias("age_days"),
            (days / F.lit(MONTH_DAYS)).alias("age_months"),
            status.alias("status"),
        ),
    ).drop("created", "known")


def traffic(frame: DataFrame, ranks: DataFrame | None = None, host: str = "host", known: Measured | None = None) -> DataFrame:
    """Add ``web_traffic``; a rank is carried along but never trusted as a code.

    ``ranks`` holds ``domain, rank, provider``; without it, or without a row for
    the host, the provider counts as unavailable.
    """
    if ranks is None:
        frame = frame.withColumns(
            {"rank": F.lit(None).cast("long"), "provider": F.lit(None).cast("string")}
        )
    else:
        best = ranks.groupBy(F.col("domain").alias(host)).agg(
            F.min_by("provider", "rank").alias("provider"), F.min("rank").alias("rank")
        )
        frame = lookup(frame, best, host, known=known)
    status = F.when(F.col("rank").isNull(), "provider_unavailable").otherwise("available")
    return frame.withColumn(
        "web_traffic",
        F.struct(
            F.col(host).alias("domain"),
            F.col("rank").cast("long").alias("rank"),
            F.col("provider"),
            status.alias("status"),
        ),
    ).drop("rank", "provider")


def provider_vectors(requests: DataFrame, provider: DataFrame | None) -> DataFrame:
    """Vectors a trusted provider table supplies, one row per request, checked.

    Requests are screened first: a URL that is not public HTTP is never looked up
    and keeps the error of the screening.  The provider is asked for the trimmed
    URL; of several rows it has for one URL the smallest text counts, a missing one
    never.  A missing provider or row is an error of its own; the rest are those of
    ``vectors.check_vectors``.
    """
    screened = urls.screen(requests).drop("parts", "ipv6")
    refused = F.col("url_error")
    if provider is None:
        missing = F.lit("Feature encoding is unavailable: mapping_unverified")
        return screened.withColumn("features", F.lit(None).cast("string")).select(
            "*", F.coalesce(refused, missing).alias("vector_error")
        ).drop("url_error")
    supplied = _one_vector(provider).withColumn("supplied", F.lit(True))
    asked = screened.withColumn("asked", F.when(refused.isNull(), urls.trimmed(F.col("url"))))
    unsupplied = F.when(F.col("supplied").isNull(), "Trusted feature provider failed").otherwise(F.col("vector_error"))
    return lookup(asked, supplied, "asked").withColumn("vector_error", F.coalesce(refused, unsupplied)).drop("supplied", "asked", "url_error")


def _one_vector(provider: DataFrame) -> DataFrame:
    """The checked vector of every URL (``asked``) of a provider table."""
    one = provider.where("features is not null").groupBy(F.col("url").alias("asked")).agg(F.min("features").alias("features"))
    return vectors.spread_codes(vectors.check_vectors(one)).drop("names", "raw", "codes")


def with_vectors(screened: DataFrame, provider: DataFrame, name: str) -> DataFrame:
    """Add the valid vector that a provider has for the ``url`` of screened rows, as a struct of nine codes or NULL."""
    valid = _one_vector(provider).where("vector_error is null")
    valid = valid.select("asked", F.struct(*FEATURES).alias(name))
    asked = screened.withColumn("asked", F.when(F.col("url_error").isNull(), F.col("url")))
    return lookup(asked, valid, "asked").drop("asked")
