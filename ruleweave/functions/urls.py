"""URL parts, screening, redaction and link resolution as column expressions.

URLs are split with the pattern of RFC 3986; hosts keep underscores and any
other characters, which the built-in URL parser refuses.

``split_url`` adds the parts of a URL as one struct column.  The other functions
take that column, so no pattern is evaluated twice and expressions stay small.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_URL_CHARS = 2048

# Screening outcomes.
INVALID_URL = "Enter a valid URL"
NOT_PUBLIC_HTTP = "Only public HTTP(S) URLs are accepted"
INTERNAL_HOST = "Internal hostnames are not allowed"
INTERNAL_ADDRESS = "Private or internal addresses are not allowed"
BAD_IPV6 = "Invalid IPv6 URL"

# IPv4 networks that are not public, from the special-purpose
# address registries, and the two public exceptions inside them.
BLOCKED_IPV4 = (
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("224.0.0.0", 4),
    ("240.0.0.0", 4),
)
PUBLIC_IPV4 = ("192.0.0.9", "192.0.0.10")

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"(?s)^[^#]*#(.*)$"
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def trimmed(url: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(url, r"^\s+|\s+$", "")


def _text(url: Column) -> Column:
    """Without leading blanks and control characters, line breaks and tabs."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def _parts(text: Column) -> Column:
    return F.struct(
        F.lower(F.regexp_extract(text, _SCHEME, 1)).alias("scheme"),
        F.regexp_extract(text, _AUTHORITY, 1).alias("server"),
        F.regexp_extract(text, _PATH, 1).alias("path"),
        F.regexp_extract(text, _QUERY, 1).alias("query"),
        F.regexp_extract(text, _FRAGMENT, 1).alias("fragment"),
    )


def parts(url: Column) -> Column:
    """``scheme, server, path, query, fragment`` of a URL; absent parts are empty."""
    return let(_text(url), _parts)


def host(server: Column) -> Column:
    """Lower-case host of a server part, without user, port and brackets."""
    bracketed = F.regexp_extract(server, r"^(?:.*@)?[^\[]*\[([^\]]*)", 1)
    plain = F.regexp_extract(server, r"^(?:.*@)?([^:@]*)", 1)
    return F.lower(F.when(server.contains("["), bracketed).otherwise(plain))


def bare(name: Column) -> Column:
    """Host without trailing dots."""
    return F.regexp_replace(name, r"\.+$", "")


def split_url(frame: DataFrame, url: Column, to: str = "parts") -> DataFrame:
    """Add the parts of ``url`` and its ``host`` as the struct column ``to``."""
    return frame.withColumn(to, parts(url)).withColumn(
        to, F.col(to).withField("host", host(F.col(to)["server"]))
    )


def redact(p: Column) -> Column:
    """Scheme, host and path only: no user, port, parameters, query or fragment."""
    scheme, name = p["scheme"], p["host"]
    shown = F.regexp_replace(p["path"], r";[^/]*$", "")
    shown = F.when(shown == "", "/").otherwise(shown)
    slash = F.when((name != "") & ~shown.startswith("/"), "/").otherwise("")
    prefix = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
    keep_empty = scheme.isin("http", "https", "ftp", "file") & shown.startswith("/")
    marks = F.when((name != "") | keep_empty | shown.startswith("//"), "//").otherwise("")
    return F.concat(prefix, marks, name, slash, shown)


# -- literal addresses -----------------------------------------------------------


def is_ipv4(name: Column) -> Column:
    return name.rlike(_IPV4)


def _number(address: str) -> int:
    a, b, c, d = (int(part) for part in address.split("."))
    return a << 24 | b << 16 | c << 8 | d


def _ipv4_number(name: Column) -> Column:
    octets = [
        F.split(name, r"\.").getItem(i).try_cast("long") * (1 << (8 * (3 - i))) for i in range(4)
    ]
    return reduce(lambda a, b: a + b, octets)


def _ipv4_blocked(number: Column) -> Column:
    inside = [
        number.between(_number(base), _number(base) + (1 << (32 - bits)) - 1)
        for base, bits in BLOCKED_IPV4
    ]
    public = number.isin(*[_number(address) for address in PUBLIC_IPV4])
    return reduce(lambda a, b: a | b, inside) & ~public


def _hex_groups(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def _ipv6_spelled(address: Column) -> Column:
    """A dotted quad at the end rewritten as two hex groups."""
    quad = F.regexp_extract(address, r"([^:]*\.[^:]*)$", 1)
    return F.when(~address.contains("."), address).when(
        is_ipv4(quad),
        let(
            _ipv4_number(quad),
            lambda n: F.concat(
                F.regexp_extract(address, r"^(.*:)[^:]*$", 1),
                F.hex(F.shiftright(n, 16)),
                F.lit(":"),
                F.hex(n.bitwiseAND(65535)),
            ),
        ),
    )


def _ipv6_expanded(address: Column) -> Column:
    head = _hex_groups(F.regexp_extract(address, r"^(.*?)(?:::.*)?$", 1))
    tail = _hex_groups(F.regexp_extract(address, r"::(.*)$", 1))

    def padded(sides: Column) -> Column:
        missing = 8 - F.size(sides["head"]) - F.size(sides["tail"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        # A gap stands for at least one group; without one there are exactly eight.
        fits = F.when(address.contains("::"), missing >= 1).otherwise(missing == 0)
        return F.when(fits, F.concat(sides["head"], zeros, sides["tail"]))

    return let(F.struct(head.alias("head"), tail.alias("tail")), padded)


def ipv6_groups(name: Column) -> Column:
    """The eight 16-bit groups of an IPv6 literal; NULL if it is not one."""
    address = let(F.regexp_replace(name, r"%[^%]+$", ""), _ipv6_spelled)
    groups = let(address, _ipv6_expanded)
    numbers = let(
        groups,
        lambda g: F.when(
            F.forall(g, lambda x: x.rlike("^[0-9a-fA-F]{1,4}$")),
            F.transform(g, lambda x: F.conv(x, 16, 10).cast("int")),
        ),
    )
    return F.when(
        name.contains(":") & name.rlike(r"^[0-9a-fA-F:.]+(%[^%]+)?$") & ~name.contains(":::"),
        numbers,
    )


def _ipv6_blocked(g: Column) -> Column:
    middle_zero = reduce(lambda a, b: a & b, [g[i] == 0 for i in range(2, 7)])
    # Public blocks inside 2001::/23.
    public_2001 = (
        ((g[1] == 1) & middle_zero & g[7].isin(1, 2))
        | (g[1] == 3)
        | ((g[1] == 4) & (g[2] == 0x112))
        | g[1].between(0x20, 0x2F)
        | g[1].between(0x30, 0x3F)
    )
    # Only 2000::/3 and the old site-local block are not reserved.
    outside = ~g[0].between(0x2000, 0x3FFF) & ~g[0].between(0xFEC0, 0xFEFF)
    special = (
        ((g[0] == 0x2001) & (g[1] < 0x200) & ~public_2001)
        | ((g[0] == 0x2001) & (g[1] == 0xDB8))
        | (g[0] == 0x2002)
    )
    return outside | special


def is_ip_literal(name: Column, ipv6: Column) -> Column:
    return ipv6.isNotNull() | is_ipv4(name)


def blocked_address(name: Column, ipv6: Column) -> Column:
    """True for a literal address that is not public; false for any other host.

    ``ipv6`` holds the groups of an IPv6 literal, else NULL.
    """
    blocked = F.when(ipv6.isNotNull(), _ipv6_blocked(ipv6)).when(
        is_ipv4(name), let(_ipv4_number(name), _ipv4_blocked)
    )
    return F.coalesce(blocked, F.lit(False))


def screening_error(url: Column, p: Column, ipv6: Column) -> Column:
    """Why a URL is refused, or NULL; ``p`` holds the parts of the trimmed URL and
    ``ipv6`` the groups of its host.  Names are not resolved.
    """
    name = bare(p["host"])
    server = p["server"]
    user = F.regexp_extract(server, r"^(.*)@", 1)
    internal = name.isin("localhost", "localhost.localdomain") | name.rlike(
        r"\.(local|internal)$"
    )
    bad_brackets = server.rlike(r"[\[\]]") & (
        ~server.rlike(r"^(.*@)?\[[^\[\]]*\](:[^\[\]]*)?$") | ipv6.isNull()
    )
    return (
        F.when(url.isNull() | (F.length(url) > MAX_URL_CHARS), INVALID_URL)
        .when(bad_brackets, BAD_IPV6)
        .when(
            ~p["scheme"].isin("http", "https") | (p["host"] == "") | ~user.isin("", ":"),
            NOT_PUBLIC_HTTP,
        )
        .when(internal, INTERNAL_HOST)
        .when(blocked_address(name, ipv6), INTERNAL_ADDRESS)
    )


def screen(frame: DataFrame, url: str = "url") -> DataFrame:
    """Add ``parts`` of the trimmed URL, ``ipv6`` groups of its host and ``url_error``."""
    return (
        split_url(frame, trimmed(F.col(url)))
        .withColumn("ipv6", ipv6_groups(F.col("parts")["host"]))
        .withColumn("url_error", screening_error(F.col(url), F.col("parts"), F.col("ipv6")))
    )


# -- links -------------------------------------------------------------------------


def _without_dots(text: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""

    def join(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda done, part: F.when(
                part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
            )
            .when(part == ".", done)
            .otherwise(F.concat(done, F.array(part))),
        )
        ending = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
        return F.regexp_replace(F.concat(F.array_join(kept, "/"), ending), "^(?!/)", "/")

    return F.when(text.rlike(r"(^|/)\.\.?(/|$)"), let(F.split(text, "/"), join)).otherwise(text)


def _after(mark: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(mark), text)).otherwise("")


def resolve(base: Column, page: Column, link: Column) -> Column:
    """Absolute form of the text ``link`` on the http(s) page with parts ``page``."""
    start = F.concat(page["scheme"], F.lit("://"), page["server"])

    def absolute(p: Column) -> Column:
        ending = F.concat(_after("?", p["query"]), _after("#", p["fragment"]))
        folder = F.regexp_replace(page["path"], r"[^/]*$", "")
        relative = F.regexp_replace(F.concat(folder, F.lit("/"), p["path"]), r"/{2,}", "/")
        same_page = F.concat(
            start,
            page["path"],
            F.when(p["query"] != "", _after("?", p["query"])).otherwise(_after("?", page["query"])),
            _after("#", p["fragment"]),
        )
        return (
            F.when((p["scheme"] != "") & (p["scheme"] != page["scheme"]), link)
            .when(
                p["server"] != "",
                F.concat(page["scheme"], F.lit("://"), p["server"], p["path"], ending),
            )
            .when(p["path"] == "", same_page)
            .when(p["path"].startswith("/"), F.concat(start, _without_dots(p["path"]), ending))
            .otherwise(F.concat(start, _without_dots(relative), ending))
        )

    # Two plain forms need no taking apart: a rooted path, and a full URL.
    rooted = link.rlike(r"^/(?!/)[^?#\x00-\x20]*$") & ~link.contains("/.")
    full = link.rlike(r"^[a-z][a-z0-9+.\-]*://[^/?#\x00-\x20]+/[^?#\x00-\x20]*$")
    return (
        F.when(link == "", base)
        .when(rooted, F.concat(start, link))
        .when(full, link)
        .otherwise(let(parts(link), absolute))
    )


def is_external(url: Column, page_host: Column) -> Column:
    """True if the URL has a host that is neither the page host nor below it."""
    named = let(
        bare(host(F.regexp_extract(_text(url), _AUTHORITY, 1))),
        lambda name: (name != "")
        & (name != page_host)
        & ~name.endswith(F.concat(F.lit("."), page_host)),
    )
    # A URL names a host only after two slashes.
    return url.contains("/") & url.rlike(r"/[\t\r\n]*/") & named
