"""Packed feature keys.

A key holds two bits per feature: 0 means "feature not used", 1..3 stand for
the values -1, 0, 1.  A full vector uses all nine features; a rule antecedent
uses some of them.  There are 4**9 keys in all and 3**9 full vectors, which is
the proven size bound of every table keyed by them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleweave.contract import FEATURES, SHARED_DOMAIN

KEY_COUNT = 4 ** len(FEATURES)
LOW_BITS = sum(1 << (2 * i) for i in range(len(FEATURES)))

# Items sort as text inside an antecedent, so features come in text order.
TEXT_ORDER = sorted(range(len(FEATURES)), key=lambda i: FEATURES[i])


def pack() -> Column:
    """Key of the nine feature columns; NULL if any is outside the shared domain."""
    parts = [
        F.shiftleft(F.when(F.col(name).isin(*SHARED_DOMAIN), F.col(name).cast("int") + 2), 2 * i)
        for i, name in enumerate(FEATURES)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def slot(key: Column, i: int) -> Column:
    """The two bits of feature ``i``."""
    return F.shiftright(key, 2 * i).bitwiseAND(3)


def value(key: Column, i: int) -> Column:
    """Value of feature ``i``; NULL if the key does not use it."""
    bits = slot(key, i)
    return F.when(bits > 0, bits - 2)


def used(key: Column) -> Column:
    """One marker bit (the low bit of its slot) per used feature."""
    return key.bitwiseOR(F.shiftright(key, 1)).bitwiseAND(LOW_BITS)


def length(key: Column) -> Column:
    """Number of used features."""
    return F.bit_count(used(key))


def item(name: str, code: Column) -> Column:
    return F.concat(F.lit(f"{name}="), code.cast("string"))


def antecedent(key: Column) -> Column:
    """Sorted ``feature=value`` items of a key."""
    items = F.array(*[item(FEATURES[i], value(key, i)) for i in TEXT_ORDER])
    return F.filter(items, lambda x: x.isNotNull())


def feature_columns(key: Column) -> list[Column]:
    """The nine features of a key as named int columns."""
    return [value(key, i).cast("int").alias(name) for i, name in enumerate(FEATURES)]


def keep_masks(features: range) -> list[int]:
    """Bit masks that blank every subset of ``features`` and keep the rest."""
    everything = KEY_COUNT - 1
    masks = []
    for subset in range(1 << len(features)):
        blank = sum(3 << (2 * i) for n, i in enumerate(features) if subset >> n & 1)
        masks.append(everything & ~blank)
    return masks
