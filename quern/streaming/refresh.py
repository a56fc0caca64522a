"""Keeping a table fresh from a stream of rows, part by part.

Below the table's folder every version ``N`` writes the parts it changes to
``data/v=N/part=P`` and then ``meta/v=N``: which version holds each part, and which
batch of which stream made it. A version is there once its ``meta`` is complete, so
readers never see half of one, and a batch that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.snapshots import latest_rows
from quern.sources.sinks import versions

#: Parts of a table, by a hash of its keys.
PARTS = 32


def without_repeats(stream: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark, whichever batch it comes in."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def _meta(spark: SparkSession, path: str):
    done = versions(spark, f"{path}/meta")
    return (done[-1], spark.read.parquet(f"{path}/meta/v={done[-1]}").first()) if done else (0, None)


def _parts(spark: SparkSession, path: str, holders: dict[int, int]) -> DataFrame | None:
    """The rows of parts, each in the version that holds it."""
    if not holders:
        return None
    return spark.read.parquet(*[f"{path}/data/v={n}/part={p}" for p, n in sorted(holders.items())])


def upsert(batch: DataFrame, path: str, number: int, keys: list[str], order: str, stream: str = "") -> None:
    """Put a batch's rows over the table: of each key the row with the greatest ``order`` stays.

    Only the parts that the batch has keys of are read and written. ``number`` and
    ``stream`` name the batch: if the stream's last one or a later one is in the table
    already, nothing is done. A stream that begins anew under another name goes on with the table as it is.
    """
    spark = batch.sparkSession
    version, meta = _meta(spark, path)
    applied = dict(meta["applied"]) if meta else {}
    if applied.get(stream, -1) >= number:
        return
    columns = [c for c in batch.columns if c not in keys and c != order]
    part = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
    rows = batch.persist()
    try:
        touched = {r[0] for r in rows.select(part).distinct().collect()}
        holders = dict(meta["holders"]) if meta else {}
        old = _parts(spark, path, {p: n for p, n in holders.items() if p in touched})
        whole = rows if old is None else old.select(*rows.columns).unionByName(rows)
        best = latest_rows(whole.withColumn("_at", F.col(order)), keys, "_at", [order, *columns])
        if touched:
            best.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/v={version + 1}")
        facts = [(holders | dict.fromkeys(touched, version + 1), applied | {stream: number})]
        spark.createDataFrame(facts, "holders map<int,int>, applied map<string,bigint>").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta/v={version + 1}")
    finally:
        rows.unpersist()


def refresh(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, interval: str | None = None) -> StreamingQuery:
    """Start keeping the table at ``path`` up to date; without an interval, what is there is done once."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: upsert(batch, path, n, keys, order, checkpoint))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version."""
    _, meta = _meta(spark, path)
    found = _parts(spark, path, dict(meta["holders"])) if meta else None
    if found is None:
        raise FileNotFoundError(f"no version at {path}")
    return found


def sweep(spark: SparkSession, path: str) -> None:
    """Delete the parts that the newest version doesn't hold; for when nobody reads older ones."""
    version, meta = _meta(spark, path)
    held = {f"v={n}/part={p}" for p, n in dict(meta["holders"]).items()} if meta else set()
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.listStatus(root) if files.exists(root) else []:
        name = folder.getPath().getName()
        if int(name[2:]) <= version:
            for part in files.listStatus(folder.getPath()):
                own = part.getPath().getName()
                if own.startswith("part=") and f"{name}/{own}" not in held:
                    files.delete(part.getPath(), True)
