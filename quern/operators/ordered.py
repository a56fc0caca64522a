"""Operators over ordered rows: runs, cursors, inversions and collapsed calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fill_forward(df: DataFrame, by: list[str], order: list[Column], column: str, out: str) -> DataFrame:
    """Adds ``out``: the last value of ``column`` that isn't null, up to and with the row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))


def runs(df: DataFrame, by: list[str], order: list[Column], column: str) -> DataFrame:
    """Runs of neighbouring rows with an equal value: ``by, run, column, rows``; nulls equal each other."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.row_number().over(w) == 1, 1).when(~F.col(column).eqNullSafe(F.lag(column).over(w)), 1).otherwise(0)
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(*by, "run", column).agg(F.count("*").alias("rows"))


def inversions(df: DataFrame, by: list[str], order: list[Column], column: str) -> DataFrame:
    """Rows whose value is less than that of the row before that has one: ``*, before``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.last(column, ignorenulls=True).over(w)).where(F.col(column) < F.col("before"))


def sibling_inversions(df: DataFrame, by: list[str], order: list[Column], section: str) -> DataFrame:
    """``by, first_id, second_id``: of each group, the first dotted number that is less than the one before it of the same parent.

    Numbers are compared part by part; what isn't a dotted number is passed over.
    """
    numbered = df.where(F.col(section).rlike(r"^\d+(\.\d+)*$"))
    parent = F.regexp_replace(section, r"\.[^.]*$", "")
    own = F.transform(F.split(section, r"\."), lambda x: x.cast("decimal(38,0)"))
    top = F.when(F.instr(section, ".") > 0, parent).otherwise(F.lit(""))
    w = Window.partitionBy(*by, "_parent").orderBy(*order)
    marked = numbered.withColumns({"_parent": top, "_own": own}).withColumns({"_before": F.lag("_own").over(w), "_first": F.lag(section).over(w)})
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return marked.where(F.col("_own") < F.col("_before")).withColumn("_nth", nth).where("_nth = 1").select(*by, F.col("_first").alias("first_id"), F.col(section).alias("second_id"))


def stable_by_page(df: DataFrame, by: list[str], order: list[Column], page: str, out: str) -> DataFrame:
    """Adds ``out``: the place from 1 of each row by page, rows without one staying with the row before, and those before any first."""
    filled = fill_forward(df, by, order, page, "_page")
    return filled.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.coalesce("_page", F.lit(0)), *order))).drop("_page")


def part_of_page(items: DataFrame, parts: DataFrame, by: list[str], order: str, page: str, part: str) -> DataFrame:
    """Adds ``part``: the last part that begins on or before an item's page, never one before its predecessor's.

    Items without a page take the one before, and those before the first part are its.
    ``parts`` has ``by``, ``page`` and ``part``; parts of a group are in order of their page.
    """
    filled = fill_forward(items, by, [F.col(order)], page, "_page")
    so_far = F.max("_page").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    reached = filled.withColumn("_reached", so_far)
    points = parts.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(page, part)))
    first = points.where("_at = 1").select(*by, F.col(part).alias("_first"))
    met = as_of(reached, points.select(*by, F.col(page).alias("_reached"), "_at", F.col(part).alias("_part")), by, "_reached", "_at", "_part", "_own")
    return met.join(first, by, "left").withColumn(part, F.coalesce("_own", "_first")).drop("_own", "_first", "_page", "_reached")


def sticky(df: DataFrame, by: list[str], order: list[Column], mention: Column, reset: Column, initial: str, out: str) -> DataFrame:
    """Adds ``out``: the last mention up to and with the row; a reset goes back to ``initial``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(reset, F.lit(initial)).otherwise(mention)
    return df.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(initial)))


def as_of(left: DataFrame, points: DataFrame, by: list[str], time: str, place: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: the value of the last point, by ``place``, whose time is no later than the row's.

    Not the latest point in time: a point that stands later in its file wins, even if
    its time is earlier. Both sides are merged in order of time, with points before
    rows of the same time, and the greatest place so far is carried along: one
    shuffle, no pairs of rows and points.
    """
    names = [c for c in left.columns if c not in by and c != time]
    rows = left.select(*by, time, F.lit(1).alias("_side"), F.lit(None).cast(points.schema[place].dataType).alias("_place"), F.lit(None).cast(points.schema[value].dataType).alias("_value"), F.struct(*names).alias("_rest"))
    marks = points.select(*by, time, F.lit(0).alias("_side"), F.col(place).alias("_place"), F.col(value).alias("_value"), F.lit(None).cast(rows.schema["_rest"].dataType).alias("_rest"))
    w = Window.partitionBy(*by).orderBy(time, "_side").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.when(F.col("_side") == 0, F.struct("_place", "_value"))).over(w)
    merged = rows.unionByName(marks).withColumn("_best", best).where("_side = 1")
    return merged.select(*by, time, "_rest.*", F.col("_best._value").alias(out))


def collapse_calls(df: DataFrame, call: list[str], order: str, size: str, identity: list[str], usage: list[str]) -> DataFrame:
    """One row a call: identity columns of its first row, usage columns of the row with the greatest size, the first of equals."""
    first = F.min(F.struct(order, *identity)).alias("_first")
    largest = F.max(F.struct(F.coalesce(F.col(size), F.lit(0)).alias("_size"), (-F.col(order)).alias("_near"), *usage)).alias("_most")
    rows = df.groupBy(*call).agg(first, largest, F.count("*").alias("rows"))
    return rows.select(*call, *[F.col(f"_first.{c}").alias(c) for c in identity], *[F.col(f"_most.{c}").alias(c) for c in usage], "rows")


def open_failures(df: DataFrame, by: list[str], order: list[str], fails: Column, closes: Column) -> DataFrame:
    """Failures that are still open: ``by``, the order columns of the row that opened it, ``duplicates``.

    A failure opens a window if none is open, else it is a duplicate of the open one;
    a closing row ends the window.
    """
    whole = Window.partitionBy(*by)
    closed = F.when(closes, 1).otherwise(0)
    marked = df.withColumn("_closed", F.sum(closed).over(whole.orderBy(*order))).withColumn("_all", F.sum(closed).over(whole))
    last = marked.where(fails & (F.col("_closed") == F.col("_all")))
    rows = last.groupBy(*by).agg(F.min(F.struct(*order)).alias("_first"), (F.count("*") - 1).alias("duplicates"))
    return rows.select(*by, *[F.col(f"_first.{c}").alias(c) for c in order], "duplicates")


def numbered_again(df: DataFrame, by: list[str], order: list[Column], name: str, out: str) -> DataFrame:
    """Adds ``out``: which occurrence of its name a row is, from 0."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by, name).orderBy(*order)) - 1)


def unique_names(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """``by, order, name, unique``: repeated names get ``-2``, ``-3``, …, passing over names that are taken.

    Only names that occur again go through Python, one group at a time.
    """
    import pandas as pd

    whole = Window.partitionBy(*by)
    base = df.select(*by, order, name)

    def rename(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        taken, seen, out = set(group[name]), set(), []
        for n in group[name]:
            if n not in seen:
                seen.add(n)
                out.append(n)
                continue
            k = 2
            while f"{n}-{k}" in taken:
                k += 1
            taken.add(f"{n}-{k}")
            out.append(f"{n}-{k}")
        return group.assign(unique=out)

    counted = base.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, name))).withColumn("_most", F.max("_n").over(whole))
    plain = counted.where("_most = 1").select(*by, order, name, F.col(name).alias("unique"))
    schema = ", ".join([*(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in [*by, order, name]), "unique string"])
    return plain.unionByName(counted.where("_most > 1").select(*by, order, name).groupBy(*by).applyInPandas(rename, schema))
