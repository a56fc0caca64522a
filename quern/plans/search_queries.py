"""Hybrid search over the section index."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import index, vectors
from quern.operators import search as s
from quern.operators.snapshots import current_sections
from quern.plans.search_oracle import ORACLE  # noqa: F401
from quern.session import shared_folder, spread
from quern.sources import table
from quern.sources.sinks import stamp

#: Weights of the index's columns.
WEIGHTS = {"title": 4.0, "summary": 2.0, "body_l2": 1.5, "body_l3": 1.0}
#: Queries are the rows whose id is divisible by this: a section's title and summary, and a row's vector.
EVERY = 100
BUDGET = 2000
TAGS = [" Lang-VI", "dom-hr"]


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "fts").where(F.col("id") % EVERY == 0).dropDuplicates(["id"])
    return rows.select(F.col("id").alias("query_id"), tx.nfc(F.concat_ws(" ", "title", "summary")).alias("text"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _index(spark: SparkSession, sf_dir: str) -> s.Index:
    """The kept index of the sections' texts, brought up to date if its table was written since."""
    fts = table(spark, sf_dir, "fts")
    source = f"{sf_dir.rstrip('/')}/fts.parquet"
    path = f"{shared_folder(spark)}/quern-index/{hashlib.sha256(source.encode()).hexdigest()[:16]}"
    return index.sync(fts, path, "id", WEIGHTS, s.search_rows, stamp(spark, source))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id`` of the sections whose document has one of the tags."""
    return s.tagged(current_sections(table(spark, sf_dir, "sections")), ["repo_id", "doc_id"], table(spark, sf_dir, "doc_tags"), TAGS).select("id")


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.keyword_leg(_index(spark, sf_dir), _asked(spark, sf_dir))


def _semantic(spark: SparkSession, sf_dir: str, floor: float | None = s.FLOOR, k: int = s.LEG) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return s.neighbours(rows, "id", "embedding", _vectors(spark, sf_dir), k, floor)


def _results(spark: SparkSession, sf_dir: str, keyword: DataFrame) -> DataFrame:
    """What a search gives: both legs fused, the sections they name that have a condensed text, and the token budget."""
    fused = s.fuse({"keyword": keyword, "semantic": _semantic(spark, sf_dir)}, "id")
    texts = table(spark, sf_dir, "fts").where("body_l2 <> ''").dropDuplicates(["id"]).select("id", "title", F.col("body_l2").alias("content"), F.coalesce("body_l3", F.lit("")).alias("full"))
    terms = _asked(spark, sf_dir).select("query_id", tx.tokens(F.col("text")).alias("terms"))
    named = fused.join(current_sections(table(spark, sf_dir, "sections")), "id").join(texts, "id").join(terms, "query_id", "left")
    looked = (F.col("mode") != "semantic") & ~tx.let(F.lower("content"), lambda low: F.exists("terms", lambda t: F.contains(low, t)))
    shown = named.withColumn("snippet", F.when(looked, tx.snippet(F.col("full"), F.col("terms"))))
    size = tx.token_estimate(F.col("content")) + tx.token_estimate(F.col("snippet"))
    return s.within_budget(shown, size, BUDGET)


def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token occurs in each column of each section."""
    return s.postings(s.search_rows(table(spark, sf_dir, "fts")), "id", WEIGHTS)


def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kept index of sections without full texts, and of others that are gone by now, brought up to date: its postings."""
    fts = table(spark, sf_dir, "fts")
    path = f"{shared_folder(spark)}/quern-index/refreshed-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    before = fts.withColumn("body_l3", F.lit("")).unionByName(fts.withColumn("id", -1 - F.col("id")))
    index.sync(before, path, "id", WEIGHTS, s.search_rows)
    return index.sync(fts, path, "id", WEIGHTS, s.search_rows).postings.select("id", "token", "f", "dl")


def bm25_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword leg."""
    return _keyword(spark, sf_dir).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def folded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for words without their accents: those with one accent are found, those with two are not."""
    asked = spark.createDataFrame([(1, "phep"), (2, "ech"), (3, "Securite"), (4, "prufung")], "query_id long, text string")
    return s.keyword_leg(_index(spark, sf_dir), asked).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def tag_filtered_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword leg over sections whose document has a tag, filtered before the cut."""
    leg = s.keyword_leg(_index(spark, sf_dir), _asked(spark, sf_dir), only=_tagged(spark, sf_dir))
    return leg.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def knn_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector leg without a floor."""
    return _semantic(spark, sf_dir, None).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def knn_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector leg with the least similarity."""
    return _semantic(spark, sf_dir).select("query_id", "id", F.round(1 / (1 + F.col("distance")), 6).alias("similarity"), "rank")


def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector leg with a filter behind it: four times as many rows are fetched, those of one label kept and cut to 50."""
    label = table(spark, sf_dir, "embeddings").where("label = 1").select(F.col("vec_id").alias("id"))
    leg = _semantic(spark, sf_dir, None, s.OVERFETCH * s.LEG)
    return s.after_cut(leg, "id", label).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def knn_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector leg by lists around centroids: nearly the nearest, of a part of the rows."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    lists = vectors.lists(rows, "id", "embedding")
    return vectors.search_lists(lists, _vectors(spark, sf_dir)).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs fused by rank."""
    fused = s.fuse({"keyword": _keyword(spark, sf_dir), "semantic": _semantic(spark, sf_dir)}, "id")
    return fused.select("query_id", "id", F.round("score", 9).alias("score"), "mode", "rank")


def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: both legs, fusion, the sections they name, what surrounds a hit, and the token budget."""
    cited = tx.citation(F.col("repo_id"), F.col("doc_id"), F.col("section_id"), F.lit(""))
    kept = _results(spark, sf_dir, _keyword(spark, sf_dir))
    return kept.select("query_id", "rank", "id", F.round("score", 9).alias("score"), "mode", "title", cited.alias("citation"), F.coalesce("snippet", F.lit("")).alias("snippet"), "tokens")


def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest prefix of every document's sections that fits a budget of 500 tokens."""
    texts = table(spark, sf_dir, "fts").dropDuplicates(["id"]).select("id", tx.token_estimate(F.col("body_l2")).alias("size"))
    rows = current_sections(table(spark, sf_dir, "sections")).join(texts, "id").select(F.concat_ws("/", "repo_id", "doc_id").alias("query_id"), "id", "section_id", "size", F.col("id").alias("rank"))
    return s.within_budget(rows, F.col("size"), 500).select("query_id", "id", "tokens")


def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What surrounds a query's term in the full text, where the condensed text has none."""
    terms = F.array(*map(F.lit, ["reconciliation", "mirror", "báo"]))
    rows = s.search_rows(table(spark, sf_dir, "fts").dropDuplicates(["id"]))
    none = ~F.exists(terms, lambda t: F.instr(F.lower("body_l2"), t) > 0)
    return rows.where(none).select("id", tx.snippet(F.col("body_l3"), terms).alias("snippet")).where("snippet IS NOT NULL")


def truncation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a leg was cut at its limit."""
    return s.truncated({"keyword": _keyword(spark, sf_dir), "semantic": _semantic(spark, sf_dir)})


def ambiguity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose two best results can't be told apart."""
    keyword = _keyword(spark, sf_dir)
    return s.ambiguous_top(_results(spark, sf_dir, keyword), keyword, "id", ["doc_id", "section_id"])


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that have no vector yet, with the text to embed."""
    rows = table(spark, sf_dir, "fts").dropDuplicates(["id"])
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return rows.join(vectors, "id", "left_anti").select("id", tx.embedding_text(F.col("title"), F.col("summary"), F.col("body_l2")).alias("text"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each token occurs in the corpus, and in how many documents."""
    each = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(tx.tokens(tx.nfc("text"))).alias("token"))
    by_doc = each.groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return by_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


_FUNCTIONS = [v for v in list(globals().values()) if callable(v) and getattr(v, "__module__", None) == __name__ and not v.__name__.startswith("_")]
QUERIES = {f.__name__: f for f in _FUNCTIONS}
