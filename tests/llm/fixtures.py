"""Small tables with the awkward cases every operator has to bear."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, row long, host string, hit string"
WORDS = "amber birch cedar delta ember fjord grove heath islet jetty knoll larch maple north ocean poppy".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "s", "ing", "ed")) for _ in range(n))


def awkward() -> list[tuple]:
    """(doc_id, text, source) with nulls, empty and long texts, copies, ties and odd characters."""
    long = prose(99, 4000)
    passage = prose(5, 40)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "   \n\t ", None), (4, "one", "b"), (5, prose(1, 60), "a"),
        (9, prose(1, 60), "b"), (7, prose(2, 90), None), (8, prose(2, 90).replace("amber", "topaz", 1), "a"),
        (10, long, "a"), (11, long + " tail", "a"), (12, prose(3, 30) + "\n" + passage, "a"),
        (13, passage + "\n" + prose(4, 30), "b"), (14, "añb 東京 Ünder the MIT License\u00a0x", "b"),
        (15, "under the mit license, UNDER THE MIT LICENSE cc by nc cc by nc", "a"),
        (16, "x\n" * 30 + "# $ % <|>", "a"), (17, "a b c d e " * 12, "b"), (18, "a" * 300, "b"),
        (19, "\x85 \u2028\x1c'll don't 12 3 \U0001f600  end ", "b"), (None, prose(6, 20), "a"), (None, None, None),
        (20, "SPDX-License-Identifier: (MIT OR GPL-2.0) AND BSD-3-Clause", "a"),
    ]
    return rows + [(5, prose(1, 60), "a")]


def docs_frame(spark, rows):
    """With columns whose names clash with those operators make for themselves."""
    full = [(d, t, "en", s, len(t or ""), 7, 8, 9, "h", "x") for d, t, s in rows]
    return spark.createDataFrame(full, DOCS)
