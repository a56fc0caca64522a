"""A federation of repositories in files: finding the entries, loading them, and writing the index over all."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.catalog import KINDS, inferred_kinds
from quern.sources import yaml_files
from quern.sources.yaml_files import parse_yaml

#: The files of an entry, and the folder that marks an old layout.
META, INDEX, MANIFEST, OLD = "_meta.yaml", "index.yaml", "_manifest.yaml", "manifests"

_META_SCHEMA = "repo_id string, kind string, source_url string, source_commit string, published_at string"
_INDEX_SCHEMA = "docs array<struct<id: string, title: string, revision: string, tags: array<string>, summary: string>>"
_MANIFEST_SCHEMA = "revision string, sections array<struct<id: string, title: string, file: string, summary: string, status: string>>"


def folders(spark: SparkSession, root: str) -> DataFrame:
    """``repo_id, state, place`` of every folder that is an entry or nearly one, however deep, by its path below ``root``.

    ``entry`` has both files; ``half`` has one, ``old`` another layout: neither is an
    entry or looked into. A folder without either is a level above entries and is looked
    into; links are not followed. Goes down level by level, so the driver holds the
    folders above entries and their names, no files.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found, level = [], [("", hadoop.Path(root))] if store.exists(hadoop.Path(root)) else []
    while level:
        below = []
        for name, path in level:
            for status in store.listStatus(path):
                own = status.getPath()
                local = re.sub(r"^file:/*", "/", own.toString())
                if not status.isDirectory() or status.isSymlink() or (own.toString().startswith("file:") and os.path.islink(local)):
                    continue
                child = f"{name}/{own.getName()}".lstrip("/")
                has = [store.exists(hadoop.Path(own, f)) for f in (META, INDEX)]
                if store.exists(hadoop.Path(own, OLD)):
                    found.append((child, "old", own.toString()))
                elif any(has):
                    found.append((child, "entry" if all(has) else "half", own.toString()))
                else:
                    below.append((child, own))
        level = below
    return spark.createDataFrame(sorted(found), "repo_id string, state string, place string")


def read_texts(df: DataFrame, place: str, text: str) -> DataFrame:
    """Adds ``text``: the file at each row's place, read by the workers; null if there is none or it isn't UTF-8.

    Spark's own readers pass over names that begin with ``_``.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for where in batch.column(place).to_pylist():
                try:
                    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", where) if ":" in where else f"file://{where}")
                    with store.open_input_stream(path) as stream:
                        found.append(stream.read().decode())
                except (OSError, UnicodeDecodeError):
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(repos, docs)`` of a federation.

    ``repos``: ``repo_id, kind, source_url, source_commit, published_at``; the id is the
    path, whatever the file says. A kind that isn't recorded, or unknown, is inferred
    from the documents. ``docs``: ``repo_id, doc_id, ord, title, revision, tags,
    summary``; a document without a revision has its manifest's. An entry with a broken
    file is left out and the others stay; so is one below another level whose kind isn't ``kb``.
    """
    entries = folders(spark, root).where("state = 'entry'").repartition("repo_id")
    meta = parse_yaml(read_texts(entries.withColumn("file", F.concat("place", F.lit(f"/{META}"))), "file", "text"), "text", _META_SCHEMA)
    index = parse_yaml(read_texts(entries.withColumn("file", F.concat("place", F.lit(f"/{INDEX}"))), "file", "text"), "text", _INDEX_SCHEMA)
    sound = meta.where("error IS NULL").select("repo_id", "place", F.col("doc").alias("meta"))
    both = sound.join(index.where("error IS NULL").select("repo_id", F.col("doc.docs").alias("docs")), "repo_id")
    each = both.select("repo_id", "place", F.posexplode("docs").alias("ord", "d"))
    docs = each.select("repo_id", "place", F.col("d.id").alias("doc_id"), "ord", "d.title", F.coalesce("d.revision", F.lit("")).alias("revision"), "d.tags", "d.summary")
    kinds = inferred_kinds(docs)
    recorded = F.lower(F.trim("meta.kind"))
    kind = F.coalesce(F.when(recorded.isin(*KINDS), recorded), "inferred", F.lit("kb"))
    repos = both.join(kinds, "repo_id", "left").select("repo_id", kind.alias("kind"), "meta.source_url", "meta.source_commit", "meta.published_at")
    repos = repos.where(~F.col("repo_id").contains("/") | (F.col("kind") == "kb"))
    bare = docs.where("revision = ''").select("repo_id", "doc_id", F.concat_ws("/", "place", "doc_id", F.lit(MANIFEST)).alias("file"))
    manifests = parse_yaml(read_texts(bare, "file", "text").where("text IS NOT NULL"), "text", _MANIFEST_SCHEMA)
    filled = docs.join(manifests.select("repo_id", "doc_id", F.col("doc.revision").alias("_own")), ["repo_id", "doc_id"], "left")
    filled = filled.withColumn("revision", F.coalesce(F.when(F.col("revision") != "", F.col("revision")), "_own", F.lit(""))).drop("_own", "place")
    return repos, filled.join(repos.select("repo_id"), "repo_id", "left_semi")


def federation_index(repos: DataFrame, docs: DataFrame, digests: DataFrame, recorded: DataFrame, changed: DataFrame) -> DataFrame:
    """``repo_id, doc_id, title, revision, kind, digest`` over all documents; a repository that isn't ``changed`` keeps the digest recorded before."""
    fresh = digests.select("repo_id", F.col("digest").alias("_new"))
    old = recorded.select("repo_id", F.col("digest").alias("_old")).join(changed.select("repo_id"), "repo_id", "left_anti")
    own = docs.join(repos.select("repo_id", "kind"), "repo_id").join(old, "repo_id", "left").join(fresh, "repo_id", "left")
    return own.select("repo_id", "doc_id", "title", "revision", "kind", F.coalesce("_old", "_new").alias("digest"))


def write_yaml(df: DataFrame, path: str, key: str) -> None:
    """Each row as a YAML file ``<path>/<key>.yaml``, written by the workers: keys in order of the columns, nulls left out, LF line ends.

    ``path`` must be reachable as files from the workers. A key that leads out of the folder is an error.
    """
    if yaml_files.yaml is None:
        raise RuntimeError("no YAML writer is installed")
    rows = df.select(F.col(key).cast("string").alias("_key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("_json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            for name, row in zip(batch.column("_key").to_pylist(), batch.column("_json").to_pylist()):
                target = os.path.normpath(os.path.join(path, f"{name}.yaml"))
                if not target.startswith(os.path.normpath(path) + os.sep):
                    raise ValueError(f"{name!r} leads out of the folder")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.part", "w", encoding="utf-8", newline="\n") as out:
                    yaml.safe_dump(json.loads(row), out, allow_unicode=True, sort_keys=False)
                os.replace(f"{target}.part", target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
