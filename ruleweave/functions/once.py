"""Columns that are computed once per row, where they are written.

Spark moves a filter down through projections and puts their expressions into it,
as often as it names them, and through a repartition, into the few tasks that read
a packed file.  Columns of a generator are values to it: what filters by them stays
above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(frame: DataFrame, **columns: Column) -> DataFrame:
    """The frame with further columns, of which no filter, join or projection takes the expressions apart.

    Columns of the same names are replaced where they stand.
    """
    made = F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    new = {name.lower(): name for name in columns}
    if not any(c.lower() in new for c in frame.columns):
        return frame.select("*", made)
    names = [new.pop(c.lower(), c) for c in frame.columns] + list(new.values())
    kept = [c for c in frame.columns if c.lower() not in {name.lower() for name in columns}]
    return frame.select(*[F.col(f"`{c}`") for c in kept], made).select(*[F.col(f"`{c}`") for c in names])
