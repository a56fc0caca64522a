"""Sums over many dimensions in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_dimensions(df: DataFrame, dimensions: list[str], sums: dict[str, str], unknown: str = "unattributed") -> DataFrame:
    """``dimension, key, rows, *sums``: totals by each dimension on its own and over all, in one pass of grouping sets.

    A null of a dimension is a bucket of its own, named ``unknown``, and not mixed up
    with the total. Nulls add nothing to a sum; a sum of only nulls is null.
    """
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = df.groupingSets(sets, *dimensions).agg(
        F.grouping_id(*dimensions).alias("_set"), F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    full = (1 << len(dimensions)) - 1
    name, key = F.lit("total"), F.lit("")
    for i, d in enumerate(dimensions):
        only = F.col("_set") == full - (1 << (len(dimensions) - 1 - i))
        name, key = F.when(only, d).otherwise(name), F.when(only, F.coalesce(F.col(d).cast("string"), F.lit(unknown))).otherwise(key)
    return grouped.select(name.alias("dimension"), key.alias("key"), "rows", *sums)


def share_of(df: DataFrame, part: str, basis: list[str]) -> DataFrame:
    """``basis, share``: the share of rows that ``part`` marks, by the first column of ``basis`` whose total is above 0."""
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"t{i}") for i, c in enumerate(basis)], *[F.coalesce(F.sum(F.when(F.col(part), F.col(c))), F.lit(0)).alias(f"p{i}") for i, c in enumerate(basis)])
    name, share = F.lit("none"), F.lit(0.0)
    for i, c in reversed(list(enumerate(basis))):
        name, share = F.when(F.col(f"t{i}") > 0, c).otherwise(name), F.when(F.col(f"t{i}") > 0, 100.0 * F.col(f"p{i}") / F.col(f"t{i}")).otherwise(share)
    return sums.select(name.alias("basis"), F.round(share, 6).alias("share"))
