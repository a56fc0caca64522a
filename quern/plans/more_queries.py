"""Queries over matching, plug-ins, sinks and stateful operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import plugins
from quern.functions import text as tx
from quern.functions.vectors import hash_embedder
from quern.operators import differences, matching
from quern.operators.snapshots import current_sections
from quern.sources import table
from quern.session import shared_folder
from quern.sources.sinks import append_new, sync_actions
from quern.streaming import limits

KEYS = ["repo_id", "doc_id", "section_id"]


def _fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fts").where("id IS NOT NULL").dropDuplicates(["id"])


def theta_term_match(spark, sf_dir):
    """Section titles in the condensed texts."""
    titles = table(spark, sf_dir, "fts").where("trim(title) <> ''").select(F.col("title").alias("term")).distinct()
    return matching.term_matches(titles, "term", _fts(spark, sf_dir), "id", "body_l2")


def tag_suggestions(spark, sf_dir):
    """The tags most like each tag."""
    tags = table(spark, sf_dir, "doc_tags").select(F.lower(F.trim("tag")).alias("tag")).distinct()
    return matching.suggestions(tags, "tag", tags.withColumnRenamed("tag", "entry"), "entry")


def word_alignment(spark, sf_dir):
    """How the condensed text differs from title and summary, by words."""
    return matching.alignments(_fts(spark, sf_dir).withColumn("head", F.concat_ws(" ", "title", "summary")), "id", "head", "body_l2")


def section_facts(spark, sf_dir):
    """Facts that the extractors find in the full texts."""
    return plugins.pattern_facts(_fts(spark, sf_dir), "id", "body_l3")


def embed_hash(spark, sf_dir):
    """A deterministic vector for what is embedded of every section, as its dimension and length."""
    text = tx.embedding_text(F.col("title"), F.col("summary"), F.col("body_l2"))
    rows = _fts(spark, sf_dir).select("id", hash_embedder(64)(text).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("id", F.size("v").alias("dim"), F.round(F.sqrt(norm), 4).alias("length"))


def index_sync(spark, sf_dir):
    """What an index of the snapshot before needs to hold the last one."""
    s = table(spark, sf_dir, "sections")
    old, new = (differences.sections_at(s, n) for n in differences.last_two(s))
    return sync_actions(old, new, KEYS, "content_hash", ["title", "file", "doc_revision"])


def sliding_limiter(spark, sf_dir):
    """Events let in at no more than three a user in six hours."""
    return limits.limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 6 * 3600)


def expired_leases(spark, sf_dir):
    """Users not seen for a day at a fixed time, unless they purchased last."""
    newest = F.max_by("event_type", F.struct("ts", "event_id"))
    seen = table(spark, sf_dir, "events").where("ts < timestamp'2024-01-10'").groupBy("user_id").agg(F.max("ts").alias("seen"), newest.alias("last"))
    return limits.expired(seen, "seen", F.lit("2024-01-10").cast("timestamp"), 86_400, F.col("last") == "purchase").select("user_id", "last")


def open_twice(spark, sf_dir):
    """Users with more than one error on a day."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return limits.open_twice(e, ["user_id", "day"], F.col("event_type") == "error")


def dedupe_append(spark, sf_dir):
    """A ledger to which the purchases were appended, and then all events twice: each is in it once."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    path = f"{shared_folder(spark)}/quern/ledger-{uuid.uuid4().hex}"
    for part in (e.where("event_type = 'purchase'"), e.unionByName(e)):
        append_new(part, path, ["event_id"], "event_type")
    return spark.read.parquet(path).select(*e.columns)


def section_listing(spark, sf_dir):
    """Current sections with their text's size, an inner join by id."""
    return current_sections(table(spark, sf_dir, "sections")).join(_fts(spark, sf_dir).select("id", F.char_length("body_l3").alias("chars")), "id")


_FUNCTIONS = [v for v in list(globals().values()) if callable(v) and getattr(v, "__module__", None) == __name__ and not v.__name__.startswith("_")]
QUERIES = {f.__name__: f for f in _FUNCTIONS}

from quern.plans.store_oracle import _FTS, _NOW, _OLD  # noqa: E402

ORACLE = {
    "section_facts": rf"""WITH f AS (SELECT id, coalesce(body_l3, '') AS t FROM {_FTS}), x AS (SELECT id, 'form' AS kind, unnest(regexp_extract_all(t, '\bFN-\d+\b')) AS value FROM f
        UNION ALL SELECT id, 'reference', unnest(regexp_extract_all(t, '(?:\bNo\.|\bNr\.|\bN°|\bSố)\s?(\d+)', 1)) FROM f UNION ALL SELECT id, 'url', unnest(regexp_extract_all(t, 'https?://[^\s)>\]]+')) FROM f)
        SELECT id, kind, value, CAST(count(*) AS INTEGER) AS times FROM x GROUP BY ALL""",
    "index_sync": f"""SELECT repo_id, doc_id, section_id, CASE WHEN a.title IS NULL THEN 'insert' WHEN b.title IS NULL THEN 'delete' WHEN a.content_hash <> b.content_hash THEN 'rewrite' ELSE 'touch' END AS action
        FROM {_OLD} a FULL JOIN {_NOW} b USING (repo_id, doc_id, section_id)
        WHERE a.title IS NULL OR b.title IS NULL OR a.content_hash <> b.content_hash OR a.title <> b.title OR a.file <> b.file OR a.doc_revision <> b.doc_revision""",
    "expired_leases": """SELECT user_id, last FROM (SELECT user_id, max(ts) AS seen, arg_max(event_type, row(ts, event_id)) AS last FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY user_id)
        WHERE last <> 'purchase' AND seen <= TIMESTAMP '2024-01-09'""",
    "open_twice": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) > 1",
    "dedupe_append": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "section_listing": f"SELECT n.repo_id, n.doc_id, n.section_id, id, length(body_l3) AS chars FROM {_NOW} n JOIN {_FTS} f USING (id)",
}
