"""Feature codes from page observations.

Every feature becomes a cell ``raw_value, encoded_value, mapping_status,
explanation``.  A code is given only where the observation supports it;
everything else is an explicit unresolved state.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweave.contract import DOMAINS, FEATURES, PROVIDER_STATES, UNVERIFIED, VERIFIED
from ruleweave.functions import urls

# The order in which features are encoded and reported unresolved.
ENCODING_ORDER = (
    "URL_Length",
    "Request_URL",
    "URL_of_Anchor",
    "SFH",
    "popUpWidnow",
    "age_of_domain",
    "having_IP_Address",
    "SSLfinal_State",
    "web_traffic",
)

# Thresholds of the codes.
URL_LENGTH = (54, 75)
RESOURCE_PERCENT = (22, 61)
ANCHOR_PERCENT = (31, 67)
AGE_MONTHS = 6


def _verified(raw: Column, code: Column, why: str) -> Column:
    return F.struct(
        raw.cast("string").alias("raw_value"),
        code.cast("int").alias("encoded_value"),
        F.lit(VERIFIED).alias("mapping_status"),
        F.lit(why).alias("explanation"),
    )


def _unresolved(raw: Column, why: str, status: Column | None = None) -> Column:
    status = F.lit(UNVERIFIED) if status is None else status
    return F.struct(
        raw.cast("string").alias("raw_value"),
        F.lit(None).cast("int").alias("encoded_value"),
        status.alias("mapping_status"),
        F.lit(why).alias("explanation"),
    )


def _provider_status(status: Column) -> Column:
    return F.when(status.isin(*PROVIDER_STATES), status).otherwise(UNVERIFIED)


def _three_way(value: Column, limits: tuple[int, int]) -> Column:
    """Below the first limit 1, up to the second 0, above -1."""
    return F.when(value < limits[0], 1).when(value <= limits[1], 0).otherwise(-1)


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100, whole), F.lit(0.0))


def resource_percent() -> Column:
    """Share of resources on other hosts; NULL if resources were not collected."""
    found = F.col("resource_urls")
    outside = F.filter(found, lambda r: urls.is_external(r["url"], F.col("page_host")))
    return F.when(found.isNotNull(), _percent(F.size(outside), F.size(found)))


def anchor_percent() -> Column:
    """Share of anchors to other hosts; empty and script targets are never external.

    A relative target resolves to the page's own host, so only targets that
    name a host need to be looked at.
    """
    found = F.col("anchor_hrefs")
    outside = F.filter(found, lambda a: urls.is_external(a, F.col("page_host")))
    return F.when(found.isNotNull(), _percent(F.size(outside), F.size(found)))


def url_length() -> Column:
    size = F.length("url")
    return _verified(size, _three_way(size, URL_LENGTH), "URL length below 54, up to 75, or longer.")


def request_url() -> Column:
    share = F.col("resource_percent")
    return F.when(
        share.isNull(), _unresolved(share, "Resource URLs were not collected.")
    ).otherwise(
        _verified(
            share,
            _three_way(share, RESOURCE_PERCENT),
            "Percent of resource URLs on other hosts: below 22, up to 61, or more.",
        )
    )


def url_of_anchor() -> Column:
    share = F.col("anchor_percent")
    return F.when(
        share.isNull(), _unresolved(share, "Anchor targets were not collected.")
    ).otherwise(
        _verified(
            share,
            _three_way(share, ANCHOR_PERCENT),
            "Percent of anchors to other hosts among all anchors: below 31, up to 67, or more.",
        )
    )


def form_handler() -> Column:
    """No form or any empty handler is -1, else any foreign handler 0, else 1."""
    actions = F.col("form_actions")
    values = F.transform(actions, urls.trimmed)
    empty = F.exists(values, lambda v: (v == "") | (F.lower(v) == "about:blank"))
    foreign = F.exists(values, lambda v: urls.is_external(v, F.col("page_host")))
    raw = F.to_json(values)
    return (
        F.when(actions.isNull(), _unresolved(raw, "Form handlers were not collected."))
        .when(F.size(actions) == 0, _verified(raw, F.lit(-1), "The page has no form handler."))
        .when(empty, _verified(raw, F.lit(-1), "A form handler is empty or about:blank."))
        .when(foreign, _verified(raw, F.lit(0), "A form handler is on another host."))
        .otherwise(_verified(raw, F.lit(1), "All form handlers stay on the page host."))
    )


def popup() -> Column:
    raw = F.col("popup_credential_fields")
    return F.when(raw.isNull(), _unresolved(raw, "Popup evidence was not collected.")).otherwise(
        _verified(raw, F.when(raw, -1).otherwise(1), "A popup that asks for credentials, or not.")
    )


def domain_age() -> Column:
    months = F.col("domain_age_months")
    return F.when(
        months.isNull(),
        _unresolved(
            months,
            "No trusted registration age is known.",
            _provider_status(F.col("domain_age_status")),
        ),
    ).otherwise(
        _verified(
            months,
            F.when(months >= AGE_MONTHS, 1).otherwise(-1),
            "Registered for at least six months, or less.",
        )
    )


def ip_address() -> Column:
    raw = F.col("hostname_is_ip")
    return F.when(raw.isNull(), _unresolved(raw, "The host was not inspected.")).otherwise(
        _verified(raw, F.when(raw, -1).otherwise(1), "The host is a literal address, or a name.")
    )


def ssl_state() -> Column:
    return _unresolved(
        F.to_json("ssl_state"), "No mapping of TLS observations to this code is established."
    )


def web_traffic() -> Column:
    return _unresolved(
        F.to_json("web_traffic"),
        "No traffic source with a known cutoff is established.",
        _provider_status(F.col("web_traffic")["status"]),
    )


CELLS = {
    "URL_Length": url_length,
    "Request_URL": request_url,
    "URL_of_Anchor": url_of_anchor,
    "SFH": form_handler,
    "popUpWidnow": popup,
    "age_of_domain": domain_age,
    "having_IP_Address": ip_address,
    "SSLfinal_State": ssl_state,
    "web_traffic": web_traffic,
}


def cells() -> Column:
    """The nine cells in contract order, each with its ``feature`` and whether it is
    ``accepted``: verified, with a code in the feature's domain.
    """
    names = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"), F.array(*[F.lit(v) for v in DOMAINS[name]]).alias("domain")
            )
            for name in FEATURES
        ]
    )

    def judged(feature: Column, cell: Column) -> Column:
        inside = F.coalesce(
            F.array_contains(feature["domain"], cell["encoded_value"]), F.lit(False)
        )
        return F.struct(
            feature["name"].alias("feature"),
            *[cell[f].alias(f) for f in ("raw_value", "encoded_value", "mapping_status", "explanation")],
            ((cell["mapping_status"] == VERIFIED) & inside).alias("accepted"),
        )

    return F.zip_with(names, F.array(*[CELLS[name]() for name in FEATURES]), judged)


def cell(name: str) -> Column:
    return F.col("cells")[FEATURES.index(name)]


def unresolved_features() -> Column:
    """Unresolved features in encoding order."""
    order = F.array(*[F.lit(name) for name in ENCODING_ORDER])
    open_cells = F.filter("cells", lambda c: c["mapping_status"] != VERIFIED)
    return F.array_intersect(order, F.transform(open_cells, lambda c: c["feature"]))
