"""Store filters: key equality, membership, ordered limit, ordered text per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_eq(df: DataFrame, **kv) -> DataFrame:
    """Conjunction of ``field == value`` (pushed down to the scan)."""
    cond: Column = F.lit(True)
    for k, v in kv.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


def where_in(df: DataFrame, col: str, ids) -> DataFrame:
    """Membership; ``ids`` is a DataFrame (left-semi join) or a Python list.

    An empty list selects nothing (the reference passes an empty ``$in``).
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)).distinct(), col, "left_semi")
    ids = list(ids)
    if not ids:
        return df.limit(0)
    return df.filter(F.col(col).isin(ids))


def first_n(df: DataFrame, order, n: int) -> DataFrame:
    """The first ``n`` rows in a fixed order (TakeOrderedAndProject)."""
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return df.orderBy(*order).limit(n)


def ordered_text(df: DataFrame, keys, order: str, text, sep: str = "") -> DataFrame:
    """C4: per group, texts joined in ``order`` (one output value per group)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    text = F.col(text) if isinstance(text, str) else text
    return df.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))),
                        lambda s: s["t"]), sep).alias("text"))
