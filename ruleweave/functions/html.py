"""Page observations from raw HTML as columns.

A page is read once, in Arrow batches, by the scanner of `page_scan`: the state of
comments, scripts and quotes goes from tag to tag, which column functions cannot
carry along a page without copying what they have collected at every tag.
Everything after the scan is column functions again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ruleweave.functions import page_scan, urls

_TEXTS = T.ArrayType(T.StringType())
_RESOURCES = T.ArrayType(T.StructType().add("link", T.StringType()).add("kind", T.StringType()))
_SEEN = T.StructType().add("resources", _RESOURCES).add("anchors", _TEXTS).add("forms", _TEXTS).add("popup", T.BooleanType())


@F.arrow_udf(_SEEN)
def _scan(pages: pa.Array) -> pa.Array:
    return pa.array([page_scan.observe(page.as_py()) for page in pages], to_arrow_type(_SEEN))


def scan(html: Column) -> Column:
    """``resources``, ``anchors``, ``forms`` and ``popup`` of a page; NULL for no page.

    resources has link and kind of every resource with a source, in page order;
    anchors the target of every anchor and forms the handler of every form, empty
    if it has none; popup is true if a script opens a window and the page asks for
    credentials.
    """
    return _scan(html)


def resources(seen: Column) -> Column:
    """``url, kind`` of every resource, resolved against the page's URL."""
    return F.transform(
        seen["resources"],
        lambda item: F.struct(
            urls.resolve(F.col("url"), F.col("parts"), item["link"]).alias("url"),
            item["kind"].alias("kind"),
        ),
    )
