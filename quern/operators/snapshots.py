"""What changed between consecutive full snapshots of a table.

``EXCEPT ALL`` both ways between each snapshot and the one before leaves only the
rows that differ; a full join of these residues by key labels every key as added,
removed or changed. Rows are compared as 128-bit digests of their keys and values, and
keys fetched for the residues only. All snapshots are compared in one plan: a row of snapshot
``t`` counts as *after* under ``t`` and as *before* under the next number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.session import materialise

#: White space that may surround a digest or a revision.
_OUTER = r"^[\s\x{a0}]+|[\s\x{a0}]+$"


def clean_text(value: Column) -> Column:
    """Without outer blanks; null becomes ''."""
    return F.coalesce(F.regexp_replace(value, _OUTER, ""), F.lit(""))


def clean_digest(value: Column) -> Column:
    """A digest in lower case, without outer blanks and without ``sha256:``; null becomes ''.

    Comes as bytes, hex digits packed two to a byte, which halves what is shuffled;
    a leading byte tells packed digests from other text, so none are mixed up.
    """
    text = clean_text(F.regexp_replace(F.lower(clean_text(value)), "^sha256:", ""))
    packed = F.concat(F.unhex(F.lit("01")), F.unhex(text))
    return F.when(text.rlike("^([0-9a-f]{2})+$"), packed).otherwise(F.concat(F.unhex(F.lit("00")), F.encode(text, "UTF-8")))


def latest_rows(df: DataFrame, keys: Sequence[str], arrived: str, payload: Sequence[str]) -> DataFrame:
    """The row of each key with the latest ``arrived``; ties go to the greatest payload.

    One aggregation with map-side combine instead of a window, so a hot key costs
    one row a task. Null ``arrived`` ranks lowest; null keys form one key.
    """
    best = F.max(F.struct(F.col(arrived).alias("_at"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(payload)])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best._{i}").alias(c) for i, c in enumerate(payload)])


def _pairs_of_numbers(states: DataFrame, number: str) -> DataFrame:
    """Each snapshot number with the next one that exists (one row a snapshot, so one task is enough)."""
    return states.select(number).distinct().withColumn("_next", F.lead(number).over(Window.orderBy(number))).where(F.col("_next").isNotNull())


def _digest_of(columns: Sequence[str], df: DataFrame) -> Column:
    """128 bits that stand for the values of some columns; lengths keep one from running into the next, and null is no text."""
    parts = []
    for c in columns:
        own = F.col(c) if isinstance(df.schema[c].dataType, T.BinaryType) else F.encode(F.col(c).cast("string"), "UTF-8")
        size = F.concat(F.coalesce(F.octet_length(own), F.lit(-1)).cast("string"), F.lit(":"))
        parts += [F.encode(size, "UTF-8"), F.coalesce(own, F.unhex(F.lit("")))]
    return F.unhex(F.md5(F.concat(*parts)))


def snapshot_changes(
    snapshots: DataFrame,
    number: str,
    keys: Sequence[str],
    values: dict[str, Column],
    arrived: str,
) -> DataFrame:
    """Keys added, removed or changed between consecutive snapshots.

    ``values`` names the compared columns and how each is normalised. Returns
    ``number, *keys, change``. Null key parts count as '' (text) and join as equal;
    rows without a number belong to no snapshot and are left out; the first
    snapshot has no changes; an empty table gives no rows; other columns, whatever
    their names, don't matter.
    """
    text = {f.name for f in snapshots.schema if isinstance(f.dataType, T.StringType)}
    base = snapshots.where(F.col(number).isNotNull()).select(
        F.col(number).alias("_n"),
        *[(F.coalesce(F.col(k), F.lit("")) if k in text else F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[v.alias(f"_v{i}") for i, v in enumerate(values.values())],
        F.col(arrived).alias("_arrived"),
    )
    ks, vs = [f"_k{i}" for i in range(len(keys))], [f"_v{i}" for i in range(len(values))]
    state = latest_rows(base, ["_n", *ks], "_arrived", vs)
    # one row a snapshot number
    steps = F.broadcast(_pairs_of_numbers(base.withColumnRenamed("_n", "_number"), "_number"))
    marked = materialise(state.select("_n", *ks, _digest_of([*ks, *vs], state).alias("_d")), "states")
    before = marked.join(steps, F.col("_n") == F.col("_number")).select(F.col("_next").alias("_n"), "_d")
    after = marked.join(steps.select("_next"), F.col("_n") == F.col("_next")).select("_n", "_d")
    left = before.exceptAll(after).join(steps, F.col("_n") == F.col("_next")).select(F.col("_number").alias("_n"), "_d", "_next")
    gone = marked.join(left, ["_n", "_d"]).select(F.col("_next").alias("_n"), *ks).alias("gone")
    new = marked.join(after.exceptAll(before), ["_n", "_d"]).select("_n", *ks).alias("new")
    same_key = [F.col(f"gone.{c}").eqNullSafe(F.col(f"new.{c}")) for c in ks]
    joined = gone.join(new, [F.col("gone._n") == F.col("new._n"), *same_key], "full_outer")
    change = F.when(F.col("gone._n").isNull(), "added").when(F.col("new._n").isNull(), "removed").otherwise("changed")
    return joined.select(
        F.coalesce("new._n", "gone._n").alias(number),
        *[F.coalesce(f"new.{c}", f"gone.{c}").alias(k) for c, k in zip(ks, keys)],
        change.alias("change"),
    )


def section_changes(sections: DataFrame) -> DataFrame:
    """Sections added, removed or changed, by content_hash and doc_revision."""
    return snapshot_changes(
        sections,
        "snapshot_no",
        ["repo_id", "doc_id", "section_id"],
        {"content_hash": clean_digest(F.col("content_hash")), "doc_revision": clean_text(F.col("doc_revision"))},
        "delivered_at",
    )


def repo_changes(repos: DataFrame) -> DataFrame:
    """Repositories added, removed or changed, by fingerprint."""
    return snapshot_changes(repos, "snapshot_no", ["repo_id"], {"fingerprint": clean_digest(F.col("fingerprint"))}, "delivered_at")


def store_changes(sections: DataFrame, repos: DataFrame) -> DataFrame:
    """Both as ``entity, snapshot_no, repo_id, doc_id, section_id, change``; doc_id and section_id are '' for repos."""
    cols = ["entity", "snapshot_no", "repo_id", "doc_id", "section_id", "change"]
    return (
        section_changes(sections)
        .withColumn("entity", F.lit("sections"))
        .select(*cols)
        .unionByName(repo_changes(repos).withColumns({"entity": F.lit("repos"), "doc_id": F.lit(""), "section_id": F.lit("")}).select(*cols))
    )


def current_sections(sections: DataFrame) -> DataFrame:
    """``repo_id, doc_id, section_id, id`` of the last snapshot, one row a key (latest delivery; ties: greatest id)."""
    last = sections.select(F.max("snapshot_no")).scalar()
    rows = sections.where(F.col("snapshot_no") == last)
    return latest_rows(rows, ["repo_id", "doc_id", "section_id"], "delivered_at", ["id"])
