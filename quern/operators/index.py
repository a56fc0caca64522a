"""A keyword index that is kept in files and brought up to date row by row.

Below its folder lie, by version ``v``: ``rows/v=N`` with every row's digest and the
segment that holds it, ``dead/v=N`` with what older segments hold in vain, and
``meta/v=N``, one row, written last: a version is there once it is. Postings lie in
``postings/seg=N/bucket=B``, by a hash of the token and in its order, so that a query
reads only the parts its tokens are in. A segment is written once and never changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import content_digest
from quern.operators.search import Index, bucket_of, counted, postings_of
from quern.session import drop, materialise
from quern.sources.sinks import versions

#: Segments, and dead rows for each live one, from which on the index is written anew.
SEGMENTS, DEAD = 8, 0.5
#: Postings of one file. A token that most rows have is in several.
EACH = 2_000_000


def _meta(spark: SparkSession, path: str):
    done = versions(spark, f"{path}/meta")
    return (done[-1], spark.read.parquet(f"{path}/meta/v={done[-1]}").first()) if done else (0, None)


def load(spark: SparkSession, path: str) -> Index:
    """The newest complete version of an index."""
    version, meta = _meta(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no index at {path}")
    found = None
    for segment in meta["segments"]:
        part = spark.read.parquet(f"{path}/postings/seg={segment}").withColumn("seg", F.lit(segment))
        found = part if found is None else found.unionByName(part)
    key = meta["key"]
    if meta["dead"]:
        found = found.join(spark.read.parquet(f"{path}/dead/v={version}"), [key, "seg"], "left_anti")
    return Index(found.select(key, "token", "f", "dl", "bucket"), key, meta["n"], meta["total"] / max(meta["n"], 1))


def sync(rows: DataFrame, path: str, key: str, columns: dict[str, float], prepared=lambda df: df, stamp: str = "") -> Index:
    """Bring the index at ``path`` up to date with ``rows`` and return it.

    Only rows whose texts differ from those indexed, by digest, are counted again, in a
    new segment; rows that are gone die. ``prepared`` makes searchable texts of them.
    With a ``stamp`` equal to the last one nothing is read at all. Rows without a key
    aren't indexed; of different rows under one key, one is. A run that failed is
    simply run again.
    """
    spark = rows.sparkSession
    version, meta = _meta(spark, path)
    if meta is not None and stamp and meta["stamp"] == stamp and meta["columns"] == str(columns):
        return load(spark, path)
    own = rows.where(F.col(key).isNotNull()).withColumn("digest", content_digest(*[F.col(c) for c in columns]))
    seen = materialise(own.groupBy(key).agg(F.max("digest").alias("digest"), F.min("digest").alias("least")), "digests")
    now = seen.select(key, "digest")
    fresh = meta is None or meta["columns"] != str(columns) or len(meta["segments"]) >= SEGMENTS or meta["dead"] > DEAD * meta["n"]
    new, segments = version + 1, [version + 1]
    if fresh:
        kept = dead = None
        changed = own if seen.where("least <> digest").isEmpty() else own.join(now, [key, "digest"], "left_semi")
    else:
        old = spark.read.parquet(f"{path}/rows/v={version}")
        kept = old.join(now, [key, "digest"], "left_semi")
        dead = old.join(now, [key, "digest"], "left_anti").select(key, "seg")
        if meta["dead"]:
            dead = dead.unionByName(spark.read.parquet(f"{path}/dead/v={version}"))
        changed = own.join(now.join(old, [key, "digest"], "left_anti"), [key, "digest"], "left_semi")
        segments = [*meta["segments"], new]
    texts = prepared(changed.select(key, "digest", *columns))
    each = materialise(counted(texts, key, columns).dropDuplicates([key]), "counted")
    n = each.select(F.sum(F.size("token"))).first()[0] or 0
    files = max(1, -(-n // EACH))
    out = postings_of(each, key).withColumn("bucket", bucket_of(F.col("token")))
    out = out.repartition(files * 8, "bucket", F.pmod(F.xxhash64(key), F.lit(-(-files // 8)))).sortWithinPartitions("bucket", "token", key)
    out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/seg={new}")
    if not n:
        segments.remove(new)
    added = each.select(key, "dl").join(now, key).withColumn("seg", F.lit(new))
    whole = added if kept is None else kept.unionByName(added.select(*kept.columns))
    whole.select(key, "digest", "dl", "seg").write.mode("overwrite").parquet(f"{path}/rows/v={new}")
    buried = 0
    if dead is not None:
        dead.write.mode("overwrite").parquet(f"{path}/dead/v={new}")
        buried = spark.read.parquet(f"{path}/dead/v={new}").count()
    count, total = spark.read.parquet(f"{path}/rows/v={new}").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    facts = [(key, str(columns), stamp, count, total, buried, segments)]
    spark.createDataFrame(facts, "key string, columns string, stamp string, n long, total long, dead long, segments array<int>").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta/v={new}")
    drop(seen, each)
    if not segments:
        return Index(postings_of(each.sparkSession.createDataFrame([], each.schema), key).withColumn("bucket", F.lit(0)), key, count, 0.0)
    return load(spark, path)
