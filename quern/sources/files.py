"""Files as tables: federations of Markdown, manifests, and JSON-lines ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.operators.catalog import tree_digest
from quern.operators.markdown import units
from quern.sources.federation import folders


def _relative(path: Column, root: str) -> Column:
    bare = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")
    return F.substring(bare, F.lit(len(root.rstrip("/")) + 2), F.length(bare))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, modified`` of all files below ``root`` whose names don't start with ``_`` or a dot; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(_relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def entries(spark: SparkSession, root: str) -> DataFrame:
    """``repo_id`` of every folder, however deep, that holds both of an entry's files; the id is its path."""
    return folders(spark, root).where("state = 'entry'").select("repo_id")


def owned(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Files with the entry they belong to, the innermost folder that is one: every folder above a file is joined by equality."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = files.withColumn("repo_id", F.explode(above)).join(repos, "repo_id")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc(F.length("repo_id"))))
    return each.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def stat_fingerprints(files: DataFrame) -> DataFrame:
    """``repo_id, entries, digest`` from paths, sizes and times only, to tell which repositories have to be read again."""
    return tree_digest(files, "repo_id", F.col("path"), F.concat_ws(",", "size", F.unix_micros("modified")))


def changed_repos(now: DataFrame, before: DataFrame) -> DataFrame:
    """``repo_id, action`` by fingerprint: ``read`` what is new or differs, ``drop`` what is gone."""
    a, b = now.alias("a"), before.alias("b")
    joined = a.join(b, F.col("a.repo_id") == F.col("b.repo_id"), "full_outer")
    action = F.when(F.col("a.repo_id").isNull(), "drop").when(~F.col("a.digest").eqNullSafe(F.col("b.digest")), "read")
    return joined.select(F.coalesce("a.repo_id", "b.repo_id").alias("repo_id"), action.alias("action")).where("action IS NOT NULL")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``path, digest``: SHA-256 of every file's bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(_relative(F.col("path"), root).alias("path"), F.sha2("content", 256).alias("digest"))


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of all Markdown files, a row a file."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(_relative(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("text"))


def sections_of(files: DataFrame) -> DataFrame:
    """``stem, section_id, occurrence, title, body_l2, body_l3``: condensed units of ``x.md`` joined to full ones of ``x.raw.md``.

    A condensed unit without a full one has '' for it.
    """
    stem = F.regexp_replace("path", r"(\.raw)?\.md$", "")
    level = F.when(F.col("path").endswith(".raw.md"), "l3").otherwise("l2")
    found = units(files, "path", "text").withColumns({"stem": stem, "level": level})
    keys = ["stem", "section_id", "occurrence"]
    full = found.where("level = 'l3'").select(*keys, F.col("body").alias("body_l3"))
    return found.where("level = 'l2'").select(*keys, "title", F.col("body").alias("body_l2")).join(full, keys, "left").withColumn("body_l3", F.coalesce("body_l3", F.lit("")))


def ledger(spark: SparkSession, path: str | list[str], schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Rows of JSON-lines files with the file they come from.

    Strictly, a line that isn't valid stops the job; otherwise such lines, and
    values of the wrong kind, are passed over.
    """
    own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.schema(own if strict else T.StructType([*own, T.StructField("_corrupt", T.StringType())]))
    if strict:
        return reader.option("mode", "FAILFAST").json(path).withColumn("_file", F.input_file_name())
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt IS NULL").drop("_corrupt").withColumn("_file", F.input_file_name())


def transcript(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, at, row``: every line of JSON-lines files that is an object, as text in its order; all others are passed over.

    A file is read as one text, so that its lines have a place; transcripts are small, and many are read side by side.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "row"))
    return files.where(F.trim("row").startswith("{") & F.try_parse_json(F.col("row")).isNotNull())


def first_of_each(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """All sources together, each key from the first source that has it."""
    whole = None
    for n, df in enumerate(sources):
        part = df.withColumn("_source", F.lit(n))
        whole = part if whole is None else whole.unionByName(part)
    columns = [c for c in whole.columns if c not in keys and c != "_source"]
    best = whole.groupBy(*keys).agg(F.min(F.struct("_source", *columns)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])
