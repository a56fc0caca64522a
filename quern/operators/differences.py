"""What differs between two versions of the store, and whether citations still hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.snapshots import clean_digest, clean_text, latest_rows

KEYS = ["repo_id", "doc_id", "section_id"]


def sections_at(sections: DataFrame, number: Column) -> DataFrame:
    """The sections of one snapshot, the latest row of each key, digest and revision normalised."""
    rows = latest_rows(sections.where(F.col("snapshot_no") == number), KEYS, "delivered_at", ["id", "title", "file", "content_hash", "doc_revision"])
    return rows.withColumns({"content_hash": clean_digest(F.col("content_hash")), "doc_revision": clean_text(F.col("doc_revision")), "title": F.coalesce("title", F.lit("")), "file": F.coalesce("file", F.lit(""))})


def last_two(sections: DataFrame) -> tuple[Column, Column]:
    """The last snapshot number and the one before, as scalar subqueries."""
    last = sections.select(F.max("snapshot_no").alias("n"))
    before = sections.where(F.col("snapshot_no") < last.scalar()).select(F.max("snapshot_no"))
    return before.scalar(), last.scalar()


def difference_flags(old: DataFrame, new: DataFrame, keys: list[str], flags: dict[str, str]) -> DataFrame:
    """Rows of two versions that differ: ``keys, change`` and a flag for each ``flag -> column``.

    Flags of added and removed rows are false.
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    both = F.col(f"a.{keys[0]}").isNotNull() & F.col(f"b.{keys[0]}").isNotNull()
    differs = {flag: both & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for flag, c in flags.items()}
    change = F.when(F.col(f"a.{keys[0]}").isNull(), "added").when(F.col(f"b.{keys[0]}").isNull(), "removed").otherwise("changed")
    out = joined.select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], change.alias("change"), *[d.alias(f) for f, d in differs.items()])
    anything = F.col("change") != "changed"
    for flag in flags:
        anything = anything | F.col(flag)
    return out.where(anything)


def manifest_difference(local: DataFrame, remote: DataFrame, path: str, digest: str) -> DataFrame:
    """``path, action``: ``copy`` what is new or differs locally, ``delete`` what only the other side has."""
    a, b = local.alias("a"), remote.alias("b")
    joined = a.join(b, F.col(f"a.{path}") == F.col(f"b.{path}"), "full_outer")
    action = F.when(F.col(f"a.{path}").isNull(), "delete").when(~F.col(f"a.{digest}").eqNullSafe(F.col(f"b.{digest}")), "copy")
    return joined.select(F.coalesce(f"a.{path}", f"b.{path}").alias(path), action.alias("action")).where("action IS NOT NULL")


def set_difference(old: DataFrame, new: DataFrame, keys: list[str], item: str) -> DataFrame:
    """``keys, item, change``: items that a key gained (``added``) or lost (``removed``), by anti joins, not by lists."""
    columns = [*keys, item]
    a, b = old.select(*columns).distinct(), new.select(*columns).distinct()
    gained = b.join(a, columns, "left_anti").withColumn("change", F.lit("added"))
    return gained.unionByName(a.join(b, columns, "left_anti").withColumn("change", F.lit("removed")))


def bag_difference(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """``columns, missing, extra``: how many times fewer or more a row stands in ``new`` than in ``old``."""
    counted = old.select(*columns, F.lit(1).alias("_n")).unionByName(new.select(*columns, F.lit(-1).alias("_n"))).groupBy(*columns).agg(F.sum("_n").alias("_n"))
    return counted.where("_n <> 0").select(*columns, F.greatest("_n", F.lit(0)).alias("missing"), F.greatest(-F.col("_n"), F.lit(0)).alias("extra"))


def resolve_citations(refs: DataFrame, pinned: DataFrame, current: DataFrame) -> DataFrame:
    """Each reference with ``status`` and ``reason``: ``ok``, ``stale`` (its text changed since) or ``broken``.

    ``pinned`` holds the versions that references name, by ``version`` and key, and
    ``current`` today's. A reference whose version or section is unknown is broken.
    """
    on = [*KEYS, "version"]
    then = pinned.select(*on, F.col("content_hash").alias("_then"))
    now = current.select(*KEYS, F.col("content_hash").alias("_now"))
    versions = pinned.select("version").distinct().withColumn("_there", F.lit(True))
    joined = refs.join(versions, "version", "left").join(then, on, "left").join(now, KEYS, "left")
    reason = (
        F.when(F.col("_there").isNull(), "unknown version").when(F.col("_then").isNull(), "not in that version").when(F.col("_now").isNull(), "gone").when(F.col("_then") != F.col("_now"), "changed").otherwise("")
    )
    status = F.when(reason == "", "ok").when(reason == "changed", "stale").otherwise("broken")
    return joined.select(*refs.columns, status.alias("status"), reason.alias("reason"))
