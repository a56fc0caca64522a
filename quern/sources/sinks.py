"""Writers: partitions overwritten by repository, appends without repeats, and small reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import materialise


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something was written at a path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what is at a path, if anything."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def store_assets(spark: SparkSession, files: DataFrame, path: str) -> DataFrame:
    """Keep ``name, content`` under the content's digest: ``name, digest, size, added``; what is there already isn't written again.

    Contents lie in ``<path>/objects``, parted by the digest's first byte.
    """
    own = files.select("name", F.sha2("content", 256).alias("digest"), F.length("content").alias("size"), "content")
    objects = f"{path}/objects"
    there = spark.read.parquet(objects).select("digest").distinct() if exists(spark, objects) else own.select("digest").limit(0)
    fresh = own.dropDuplicates(["digest"]).join(there, "digest", "left_anti").withColumn("byte", F.substring("digest", 1, 2))
    out = materialise(own.select("name", "digest", "size").join(fresh.select("digest", F.lit(True).alias("_new")), "digest", "left").select("name", "digest", "size", F.col("_new").isNotNull().alias("added")), "assets")
    fresh.select("digest", "content", "byte").write.mode("append").partitionBy("byte").parquet(objects)
    return out


def load_assets(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """``digest, content, sound`` of stored contents; one whose bytes have another digest isn't sound."""
    held = spark.read.parquet(f"{path}/objects").join(digests.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    return held.select("digest", "content", (F.sha2("content", 256) == F.col("digest")).alias("sound"))


def mirror_files(local: DataFrame, remote: DataFrame, path: str) -> DataFrame:
    """Carry out a mirror: what differs is written over the old, what is gone deleted; ``path, action`` of all that was done.

    ``local`` has ``path, content``, ``remote`` ``path, digest``. A path that leads out of
    the folder is an error before anything is written. Files are written by the workers.
    """
    own = local.select("path", "content", F.sha2("content", 256).alias("digest"))
    odd = own.select("path").unionByName(remote.select("path")).where(F.col("path").rlike(r"(^/|(^|/)[.][.](/|$))"))
    if not odd.isEmpty():
        raise ValueError("a path leads out of the folder")
    plan = materialise(own.select("path", F.col("digest").alias("_a")).join(remote.select("path", F.col("digest").alias("_b")), "path", "full_outer").where("NOT _a <=> _b").select("path", F.when(F.col("_a").isNull(), "delete").otherwise("copy").alias("action")), "plan")
    rows = plan.join(own.select("path", "content"), "path", "left").select("path", "action", "content")

    def run(batches):
        for batch in batches:
            for name, action, content in zip(*(c.to_pylist() for c in batch.columns)):
                target = os.path.join(path, name)
                if action == "copy":
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(f"{target}.part", "wb") as out:
                        out.write(content)
                    os.replace(f"{target}.part", target)
                elif os.path.exists(target):
                    os.remove(target)
                    folder = os.path.dirname(target)
                    while folder != path.rstrip("/") and os.path.isdir(folder) and not os.listdir(folder):
                        os.rmdir(folder)
                        folder = os.path.dirname(folder)
            yield batch.select(["path", "action"])

    return materialise(rows.mapInArrow(run, "path string, action string"), "mirrored")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the complete versions ``v=N`` below a path, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    there = [p.getPath() for p in files.listStatus(root) if p.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in there if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def stamp(spark: SparkSession, path: str) -> str:
    """What tells a written table from a later one: its place, size, number of files and time."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    held = files.getContentSummary(target)
    return f"{path} {held.getLength()} {held.getFileCount()} {files.getFileStatus(target).getModificationTime()}"


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace just the partitions that ``df`` has rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], by: str | None = None) -> None:
    """Append the rows whose key isn't there yet, one a key; running it again adds nothing."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    writer = fresh.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def sync_actions(old: DataFrame, new: DataFrame, keys: list[str], digest: str, metadata: list[str]) -> DataFrame:
    """``keys, action``: ``insert``, ``delete``, ``rewrite`` what has another digest, ``touch`` what has other metadata only."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    other = F.lit(False)
    for c in metadata:
        other = other | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    action = (
        F.when(F.col(f"a.{keys[0]}").isNull(), "insert").when(F.col(f"b.{keys[0]}").isNull(), "delete").when(~F.col(f"a.{digest}").eqNullSafe(F.col(f"b.{digest}")), "rewrite").when(other, "touch")
    )
    return joined.select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], action.alias("action")).where("action IS NOT NULL")


def markdown_report(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cells = [[str(v).replace("|", r"\|") if v is not None else "" for v in r] for r in rows]
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(c) + " |" for c in cells)]
    return "\n".join(lines) + "\n"
