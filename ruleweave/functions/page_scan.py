"""One pass over the markup of a page.

Tags, comments and raw text end where the standard library's parser ends them, but
no part of a page is searched again and again: what has once been looked for up
to the end and not been found is not looked for from a later place, and a place
inside a broken tag that led nowhere is not followed again.  So the time grows
with the size of the page whatever it holds.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

from pyspark import cloudpickle

# Tasks get these functions by value, so executors need none of this package's files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Element kinds whose URL counts as a page resource, input types that ask for credentials.
RESOURCE_KINDS = ("img", "script", "link", "video", "audio")
CREDENTIAL_TYPES = ("password", "email")
#: Attribute looked at by element kind.
ATTRIBUTES = dict.fromkeys(("img", "script", "video", "audio"), "src") | {
    "link": "href", "a": "href", "form": "action", "input": "type", "textarea": "type",
}

_BETWEEN = r"(?:\s|/(?!>))*"
_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*")
_GAP = re.compile(_BETWEEN)
# an attribute starts after a blank, a slash or a quote; its value is quoted or runs to a blank or >
_ATTRIBUTE = re.compile(r"(?<=[\s/'\"])([^\s/>][^\s/=>]*)(?:\s*=+\s*('[^']*'|\"[^\"]*\"|(?!['\"])[^\s>]*))?" + _BETWEEN)
_COMMENT_END = re.compile(r"--\s*>")
_SECTION = re.compile(r"<!\[([a-zA-Z][-_.a-zA-Z0-9]*)")
_RAW_END = {kind: re.compile(rf"</\s*{kind}\s*>", re.I) for kind in ("script", "style")}
_SECTION_END = {
    **dict.fromkeys(("temp", "cdata", "ignore", "include", "rcdata"), re.compile(r"\]\s*\]\s*>")),
    **dict.fromkeys(("if", "else", "endif"), re.compile(r"\]\s*>")),
}


class _Search:
    """Searches that rise through a page; a pattern that was not found once is not searched again."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def end(self, pattern: re.Pattern, start: int) -> re.Match | None:
        if pattern in self.missing:
            return None
        found = pattern.search(self.page, start)
        if not found:
            self.missing.add(pattern)
        return found


def _attributes(page: str, at: int, dead: set[int]) -> tuple[dict[str, str], int]:
    """The attributes from a place on, and where they end; the last of equal names counts.

    At a place of `dead` the reading stops at once.
    """
    found: dict[str, str] = {}
    while at not in dead and (m := _ATTRIBUTE.match(page, at)):
        name, value = m.groups("")
        if value[:1] == value[-1:] and value[:1] in ("'", '"'):
            value = value[1:-1]
        found[name.lower()] = value
        at = m.end()
    return found, at


def tags(page: str) -> Iterator[tuple[str, dict[str, str], str | None]]:
    """Kind, raw attributes and, of scripts and styles, the body of every start tag in order.

    A script or style that is never closed has the rest of the page as its body.
    """
    search, dead = _Search(page), set()
    last = page.rfind(">")
    at = page.find("<")
    while 0 <= at < last:  # no tag ends behind the last >
        mark = page[at + 1]
        name = _NAME.match(page, at + 1)
        if name:
            kind = name.group().lower()
            first = _GAP.match(page, name.end()).end()
            found, end = _attributes(page, first, dead)
            if page.startswith((">", "/>"), end):
                closed = page[end] == "/"
                at = end + 1 + closed
                body = None
                if kind in _RAW_END and not closed:
                    stop = search.end(_RAW_END[kind], at)
                    body = page[at : stop.start() if stop else len(page)]
                    at += len(body)
                yield kind, found, body
            elif end >= len(page) or end in dead or page[end] == "/" or page[end] == "=" or page[end].isascii() and page[end].isalpha():
                # never complete: the tag is text up to the next >
                dead.update(_starts(page, first, end))
                at = page.find(">", at + 1) + 1
            else:
                at = end
        elif mark in "/?":
            at = page.find(">", at + 2) + 1
        elif mark == "!":
            at = _declaration(page, at, search)
        else:
            at += 1
        at = page.find("<", at)


def _starts(page: str, at: int, end: int) -> Iterator[int]:
    """The places where attributes were looked for between two places, both included."""
    while at < end:
        yield at
        at = _ATTRIBUTE.match(page, at).end()
    yield end


def _declaration(page: str, at: int, search: _Search) -> int:
    """Where a comment, marked section or other declaration ends."""
    stop = None
    if page.startswith("<!--", at):
        stop = search.end(_COMMENT_END, at + 4)
    elif section := _SECTION.match(page, at):
        ending = _SECTION_END.get(section[1].lower())
        stop = ending and search.end(ending, at + 3)
    else:
        return page.find(">", at + 2) + 1
    return stop.end() if stop else page.find(">", at + 1) + 1


def observe(page: str | None) -> dict | None:
    """What a page shows: resources (kind and link), targets of anchors, handlers of forms, popup with credentials.

    References in attributes are decoded.  Resources without a link are left out;
    an anchor or form without one has the empty string.
    """
    if page is None:
        return None
    resources, anchors, forms, opens, asks = [], [], [], False, False
    for kind, attributes, body in tags(page):
        if kind not in ATTRIBUTES:
            continue
        value = unescape(attributes.get(ATTRIBUTES[kind], ""))
        if kind == "a":
            anchors.append(value)
        elif kind == "form":
            forms.append(value)
        elif kind in RESOURCE_KINDS:
            opens = opens or "window.open" in (body or "").lower()
            if value:
                resources.append({"link": value, "kind": kind})
        else:
            asks = asks or value.lower() in CREDENTIAL_TYPES
    return {"resources": resources, "anchors": anchors, "forms": forms, "popup": opens and asks}
