"""Order-insensitive fingerprints of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECE = 8  # hex digits per summed piece of a row digest
_PIECES = 64 // _PIECE


def _cell(name: str) -> Column:
    """A column as text, with NULL and the empty text told apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("-"))


def fingerprint(frame: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: ``row_count`` and ``digest`` of a table of flat columns.

    Row digests are summed piece by piece, so the result does not depend on row
    order or partitioning, counts duplicates, and needs no sort and no collected
    list.  Columns enter by name.  A table grouped to distinct rows gives the
    same result as its rows if ``weight`` names its count column.
    """
    names = sorted(name for name in frame.columns if name != weight)
    row = F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(n), _cell(n)) for n in names]), 256)
    n = F.lit(1) if weight is None else F.col(weight)
    pieces = []
    for i in range(_PIECES):
        number = F.conv(F.substring("row_digest", 1 + i * _PIECE, _PIECE), 16, 10)
        pieces.append(F.sum(number.cast("decimal(10,0)") * F.col("times")).alias(f"p{i}"))
    sums = frame.select(row.alias("row_digest"), n.cast("decimal(18,0)").alias("times")).agg(
        F.coalesce(F.sum("times"), F.lit(0)).cast("long").alias("row_count"), *pieces
    )
    text = F.concat_ws(
        ":",
        F.lit(",".join(names)),
        F.col("row_count").cast("string"),
        *[
            F.coalesce(F.col(f"p{i}"), F.lit(0)).cast("decimal(38,0)").cast("string")
            for i in range(_PIECES)
        ],
    )
    return sums.select("row_count", F.sha2(text, 256).alias("digest"))
