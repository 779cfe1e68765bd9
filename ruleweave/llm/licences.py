"""Licence scan: notice phrases by Aho-Corasick, identifier expressions by shunting-yard."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ruleweave.llm.common import batches_of, rows_of

#: Phrases that the base columns count, with their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Notice phrases the method adds.
NOTICES = (
    ("mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license", "apache"),
    ("bsd 2 clause", "bsd-2-clause"),
    ("bsd 3 clause", "bsd-3-clause"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("isc license", "isc"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("gnu general public license", "gpl"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("creative commons attribution", "cc-by"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("cc0", "cc0"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "all-rights-reserved"),
)
TAG = "spdx license identifier"
#: How freely a licence lets a text be used, by the longest prefix of its label.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0,
    "cc-by": 0.9, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.2, "cc-by-nc": 0.1, "all-rights-reserved": 0.05,
}
UNKNOWN = 0.5
#: What an exception adds to the freedom of the licence it is attached to.
EXCEPTION = 0.2

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAG = re.compile(r"SPDX-License-Identifier[ \t]*:", re.IGNORECASE)
_SYMBOL = re.compile(r"[()]|[A-Za-z0-9.+\-]+")
_NEXT = re.compile(rf"[ \t]*({_SYMBOL.pattern})")
_STRENGTH = {"or": 1, "and": 2, "with": 3}

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)


def freedom(label: str) -> float:
    known = [k for k in FREEDOM if label == k or label.startswith(k + "-")]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels and freedom of a licence expression, or None if it is not one.

    `or` leaves the choice, so the freer side counts; `and` binds to both, so the
    less free one does; `with` attaches an exception.  Precedence is with, and,
    or; brackets group.  Operators are read in any case.
    """
    output: list[tuple[set[str], float]] = []
    operators: list[str] = []

    def apply() -> bool:
        name = operators.pop()
        if len(output) < 2:
            return False
        (more, y), (labels, x) = output.pop(), output.pop()
        if name == "with":
            output.append((labels, min(1.0, x + EXCEPTION)))
        else:
            output.append((labels | more, max(x, y) if name == "or" else min(x, y)))
        return True

    operand = True  # what has to come next
    for symbol in _SYMBOL.findall(expression):
        word = symbol.lower()
        if word == "(":
            if not operand:
                return None
            operators.append(word)
        elif word == ")":
            if operand:
                return None
            while operators and operators[-1] != "(":
                if not apply():
                    return None
            if not operators:
                return None
            operators.pop()
        elif word in _STRENGTH:
            if operand:
                return None
            while operators and operators[-1] != "(" and _STRENGTH[operators[-1]] >= _STRENGTH[word]:
                if not apply():
                    return None
            operators.append(word)
            operand = True
        else:
            if not operand:
                return None
            output.append(({word}, freedom(word)))
            operand = False
    while operators:
        if operators[-1] == "(" or not apply():
            return None
    return output[0] if len(output) == 1 and not operand else None


def leading(text: str, at: int = 0) -> str:
    """The longest complete licence expression that starts at a place of a text, or ''.

    Reading ends at the first symbol that cannot continue an expression: words
    after it, a comment end such as `--`, the end of a sentence or of the line.
    """
    start = whole = at
    depth, operand = 0, True  # open brackets; whether an operand has to come next
    while found := _NEXT.match(text, at):
        symbol, at = found[1], found.end()
        name = symbol if symbol in "()" else symbol.rstrip(".-")
        word = name.lower()
        if not name or operand != (word != ")" and word not in _STRENGTH) or word == ")" and not depth:
            break
        if word in _STRENGTH:
            operand = True
        elif word == "(":
            depth += 1
        else:
            depth -= word == ")"
            operand = False
        if not depth and not operand:
            whole = found.start(1) + len(name)
        if name != symbol:
            break
    return text[start:whole]


def automaton():
    """All phrases, with a blank on either side."""
    found: dict[str, list] = {}
    for phrase, label in BASE:
        found.setdefault(f" {phrase} ", []).append((True, label))
    for phrase, label in NOTICES:
        found.setdefault(f" {phrase} ", []).append((False, label))
    found.setdefault(f" {TAG} ", []).append((False, None))
    tree = ahocorasick.Automaton()
    for phrase, meaning in found.items():
        tree.add_word(phrase, (len(phrase), meaning))
    tree.make_automaton()
    return tree


def scan_text(text: str | None, tree) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    text = text or ""
    words = text.encode("utf-8").translate(_FOLD).split()
    line = (b" " + b" ".join(words) + b" ").decode("utf-8")
    places, base, labels, tagged = [], set(), set(), False
    at = word = 0
    for end, (length, meanings) in tree.iter(line):
        start = end - length + 1
        if start >= at:
            word += line.count(" ", at, start)
            here = word
            at = start
        else:
            here = word - line.count(" ", start, at)
        for is_base, label in meanings:
            if label is None:
                tagged = True
                continue
            if is_base:
                places.append(here)
                base.add(label)
            labels.add(label)
    # labels from expressions are weighed with their operators, those of notices bind all
    weights = [freedom(x) for x in labels]
    if tagged:
        for tag in _TAG.finditer(text):
            value = evaluate(leading(text, tag.end()))
            if value:
                labels |= value[0]
                weights.append(value[1])
    score = min(weights, default=0.0)
    return (
        len(words), len(places), min(places) if places else None, max(places) if places else None,
        ",".join(sorted(base)), ",".join(sorted(labels)), score,
    )


def scan(documents: DataFrame) -> DataFrame:
    """Licence findings of every whole text.

    Words are runs of digits, letters a to z in either case and characters beyond
    ASCII.  n_base counts all places of the base phrases, overlapping ones too;
    labels holds the base labels, those of other notices and those of identifier
    expressions.  score is how freely the text may be used (0 to 1): the least
    free of its notices and expressions, 0 without any.  An expression is read up
    to the first symbol that cannot continue it; one without a complete beginning
    adds nothing.  A null text is empty.  Repeated rows and null ids are kept as they
    are; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = automaton()
        return batches_of(((doc, *scan_text(text, tree)) for doc, text in rows_of(batches)), SCHEMA)

    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return documents.select("doc_id", "text").mapInArrow(run, kinds)
