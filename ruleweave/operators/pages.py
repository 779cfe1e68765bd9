"""Raw pages to observations, codes and routed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.contract import FEATURES, UNVERIFIED
from ruleweave.functions import codes, html, urls
from ruleweave.functions.once import once
from ruleweave.operators import providers
from ruleweave.operators.joins import measured


def observe(pages: DataFrame, strict_fetch: bool = False) -> DataFrame:
    """Observations of pages with ``url`` and ``html`` (NULL: the fetch failed).

    A failed fetch leaves empty lists, which later encode as verified codes;
    with ``strict_fetch`` the lists are NULL and stay unresolved.
    """
    fetched = F.col("html").isNotNull()

    def collected(value: Column, kind: str) -> Column:
        missing = F.lit(None) if strict_fetch else F.array()
        return F.when(fetched, value).otherwise(missing.cast(kind))

    screened = urls.screen(pages).withColumn("url", urls.trimmed(F.col("url")))
    found = screened.withColumn("seen", html.scan(F.col("html")))
    seen_here = F.col("seen")
    scheme, name = F.col("parts")["scheme"], F.col("parts")["host"]
    https = scheme == "https"
    seen = (
        found.withColumn("host", name)
        .withColumn("page_host", urls.bare(name))
        .withColumn("hostname_is_ip", urls.is_ip_literal(name, F.col("ipv6")))
        .withColumn(
            "resource_urls",
            collected(html.resources(seen_here), "array<struct<url:string,kind:string>>"),
        )
        .withColumn("anchor_hrefs", collected(seen_here["anchors"], "array<string>"))
        .withColumn("form_actions", collected(seen_here["forms"], "array<string>"))
        .withColumn("popup_credential_fields", seen_here["popup"])
        .withColumn(
            "page",
            F.struct(
                F.when(fetched, "available").otherwise("unavailable").alias("status"),
                F.when(fetched, F.size("form_actions")).alias("forms"),
                F.when(fetched, F.size("anchor_hrefs")).alias("anchors"),
                F.when(fetched, F.size("resource_urls")).alias("external_reference_candidates"),
            ),
        )
        .withColumn(
            "ssl_state",
            F.struct(
                scheme.alias("scheme"),
                F.when(https, fetched).alias("tls_verified"),
                F.lit(UNVERIFIED).alias("mapping_status"),
                F.when(https & fetched, "observation_available")
                .when(https, "extraction_error")
                .when(fetched, "not_applicable")
                .alias("observation_status"),
            ),
        )
    )
    return seen.drop("html", "seen", "ipv6")


def raw_features() -> Column:
    """The nine features with a raw value; features without one hold NULL."""
    known = {
        "URL_Length": F.length("url"),
        "SSLfinal_State": F.to_json(F.struct(F.col("parts")["scheme"].alias("scheme"))),
        "having_IP_Address": F.col("hostname_is_ip"),
    }
    return F.struct(
        *[
            F.struct(known.get(name, F.lit(None)).cast("string").alias("raw_value")).alias(name)
            for name in FEATURES
        ]
    )


def analyze(
    pages: DataFrame,
    suffixes: DataFrame,
    as_of: Column,
    registrations: DataFrame | None = None,
    ranks: DataFrame | None = None,
    strict_fetch: bool = False,
) -> DataFrame:
    """Observations with registration age and traffic state.

    Page bodies are dropped before the lookups, so the joins move only
    observations.
    """
    seen = observe(pages, strict_fetch)
    placed = providers.registrable_domain(seen, "host", suffixes)
    # both keys stand in the pages already: they are read once to measure them
    keys = [key for key, table in (("registrable_domain", registrations), ("host", ranks)) if table is not None]
    known = measured(placed, keys) if keys else {}
    aged = providers.registration_age(placed, registrations, as_of, known=known.get("registrable_domain"))
    info = F.col("domain_information")
    return (
        providers.traffic(aged, ranks, known=known.get("host"))
        .withColumn("domain_age_months", info["age_months"])
        .withColumn("domain_age_status", F.when(info["status"] != "available", info["status"]))
        .withColumn("raw_features", raw_features())
    )


def encode(observations: DataFrame) -> DataFrame:
    """Add ``cells`` (one per feature), ``complete`` and ``unresolved_features``."""
    shares = once(observations, resource_percent=codes.resource_percent(), anchor_percent=codes.anchor_percent())
    return (
        once(shares, cells=codes.cells())
        .withColumn("complete", F.forall("cells", lambda c: c["accepted"]))
        .withColumn("unresolved_features", codes.unresolved_features())
    )


def add_route(encoded: DataFrame) -> DataFrame:
    """Add ``route``: rows to score, blocked rows, and rows refused for their URL.

    Only complete rows may be scored.  The route is a column, so pages are
    parsed once however many branches follow.
    """
    return encoded.withColumn(
        "route",
        F.when(F.col("url_error").isNotNull(), "refused")
        .when(F.col("complete"), "scored")
        .otherwise("blocked"),
    )


def code(name: str) -> Column:
    """The code of a feature of an encoded page."""
    return codes.cell(name)["encoded_value"]


def ready_rows(routed: DataFrame) -> DataFrame:
    """The rows to score, with their nine codes as columns."""
    return routed.where(F.col("route") == "scored").withColumns(
        {name: code(name) for name in FEATURES}
    )


def blocked_rows(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("route") == "blocked")
