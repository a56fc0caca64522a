"""Queries over headings, references and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import differences, documents
from quern.operators.snapshots import current_sections
from quern.plans.store_oracle import _NOW, _OLD, _OUTSIDE, _outside
from quern.sources import table

KEYS = ["repo_id", "doc_id", "section_id"]


def _fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fts").where("id IS NOT NULL").dropDuplicates(["id"])


def heading_ids(spark, sf_dir):
    """Unit headings of the full texts outside fences."""
    return documents.heading_ids(_fts(spark, sf_dir), "id", "body_l3")


def orphan_headings(spark, sf_dir):
    """Headings of the full texts whose id isn't their section's."""
    found = documents.heading_ids(_fts(spark, sf_dir), "id", "body_l3")
    return documents.orphan_headings(found, current_sections(table(spark, sf_dir, "sections")), ["id"], False)


def heading_tree(spark, sf_dir):
    """The documents' headings as trees, small ones folded into those above."""
    return documents.folded(documents.heading_tree(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def citation_round_trip(spark, sf_dir):
    """Citations of all sections, read back."""
    cited = current_sections(table(spark, sf_dir, "sections")).select("id", tx.citation(F.col("repo_id"), F.col("doc_id"), F.col("section_id"), F.lit("")).alias("ref"))
    return documents.parsed_references(cited, "ref")


def split_paragraphs(spark, sf_dir):
    """Paragraphs that break off where their page runs on."""
    spans = table(spark, sf_dir, "unit_spans").where("page IS NOT NULL").select(*KEYS, F.explode(F.sequence("page", F.greatest(F.coalesce("end_page", "page"), "page"))).alias("page")).distinct()
    pages = spans.join(table(spark, sf_dir, "pdf_pages").distinct(), ["repo_id", "doc_id", "page"]).select(*KEYS, "page_text")
    rows = current_sections(table(spark, sf_dir, "sections")).join(_fts(spark, sf_dir).select("id", "body_l3"), "id")
    return documents.split_paragraphs(rows, pages, KEYS, "body_l3")


def stale_days(spark, sf_dir):
    """How old every repository's publication is at a fixed day."""
    return table(spark, sf_dir, "repos").select("repo_id", "snapshot_no", documents.stale_days(F.lit("2026-06-01").cast("date"), F.col("published_at")).alias("days"))


def hash_distance(spark, sf_dir):
    """In how many bits each vector's signs differ from those of its label's first one, as hashes of pictures do from a legend's."""
    bit = lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    signs = F.aggregate(F.transform(F.slice("embedding", 1, 64), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    hashes = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "label", signs.alias("hash"))
    legend = hashes.groupBy("label").agg(F.min_by("hash", "vec_id").alias("known"))
    return hashes.join(legend, "label").select("vec_id", documents.bits_apart(F.col("hash"), F.col("known")).cast("int").alias("bits"))


def event_counts(spark, sf_dir):
    """Numbers out of usage blocks: made of the events' values, with the parts of a cache for some and its total for others."""
    e = table(spark, sf_dir, "events")
    k, cents = F.get_json_object("props", "$.k"), F.round(F.col("value") * 100).cast("long").cast("string")
    cache = F.when(F.col("event_type") == "purchase", F.concat(F.lit('"cache_creation": {"ephemeral_5m_input_tokens": '), k, F.lit(', "ephemeral_1h_input_tokens": '), cents, F.lit("}")))
    cache = cache.otherwise(F.concat(F.lit('"cache_creation_input_tokens": '), F.col("user_id").cast("string")))
    rest = F.when(F.col("event_type") == "error", F.lit(', "output_tokens": "x"')).otherwise(F.concat(F.lit(', "output_tokens": '), cents, F.lit(', "cache_read_input_tokens": '), k, F.lit(', "server_tool_use": {"web_search_requests": '), k, F.lit("}")))
    block = F.concat(F.lit('{"input_tokens": '), k, F.lit(", "), cache, rest, F.lit("}"))
    return e.select("event_id", *[c.alias(n) for n, c in documents.usage_counts(block).items()])


def merged_checks(spark, sf_dir):
    """Sections of the last two snapshots as two runs of a check: confirmations last while the text does."""
    s = table(spark, sf_dir, "sections")
    old, new = (differences.sections_at(s, n).withColumn("content_hash", F.lower(F.hex("content_hash"))) for n in differences.last_two(s))
    keys = ["repo_id", "doc_id", "section_id"]
    return documents.merged_checks(old.select(*keys, "content_hash", F.lit(True).alias("confirmed")), new.select(*keys, "content_hash", F.lit(False).alias("confirmed")), keys, ["content_hash"], ["confirmed"])


_FUNCTIONS = [v for v in list(globals().values()) if callable(v) and getattr(v, "__module__", None) == __name__ and not v.__name__.startswith("_")]
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_HEAD = r"'^## (\S+)(?:[ \t]+(.*?))?[ \t]*$'"
ORACLE = {
    "citation_round_trip": f"SELECT id, repo_id || ':' || doc_id || ' §' || section_id AS ref, repo_id AS ref_repo, doc_id AS ref_doc, section_id AS ref_section FROM {_NOW}",
    "stale_days": "SELECT repo_id, snapshot_no, CAST(coalesce(date_diff('day', TRY_CAST(substr(trim(published_at), 1, 10) AS DATE), DATE '2026-06-01'), 36500) AS INTEGER) AS days FROM repos",
    "hash_distance": """WITH s AS (SELECT vec_id, label, list_transform(embedding[1:64], lambda x: x >= 0) AS h FROM embeddings WHERE embedding IS NOT NULL), l AS (SELECT label, arg_min(h, vec_id) AS k FROM s GROUP BY label)
        SELECT vec_id, CAST(len(list_filter(range(1, len(h) + 1), lambda i: h[i] <> k[i])) AS INTEGER) AS bits FROM s JOIN l USING (label)""",
    "event_counts": """SELECT event_id, k AS tokens_in, CASE WHEN event_type = 'error' THEN 0 ELSE cents END AS tokens_out, CASE WHEN event_type = 'error' THEN 0 ELSE k END AS cache_read,
        CASE WHEN event_type = 'purchase' THEN k ELSE user_id END AS cache_short, CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END AS cache_long, CASE WHEN event_type = 'error' THEN 0 ELSE k END AS searches
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents FROM events)""",
    "heading_ids": rf"""WITH RECURSIVE {_OUTSIDE} SELECT id, pos AS at, regexp_extract(line, {_HEAD}, 1) AS section_id, trim(regexp_extract(line, {_HEAD}, 2)) AS title FROM o WHERE regexp_matches(line, {_HEAD})""",
    "orphan_headings": rf"""WITH RECURSIVE {_OUTSIDE}, h AS (SELECT id, pos, regexp_extract(line, {_HEAD}, 1) AS section_id, trim(regexp_extract(line, {_HEAD}, 2)) AS title FROM o WHERE regexp_matches(line, {_HEAD}))
        SELECT h.id, h.pos AS at, h.section_id, h.title FROM h WHERE NOT EXISTS (SELECT 1 FROM {_NOW} n WHERE n.id = h.id AND n.section_id = h.section_id)""",
    "heading_tree": rf"""WITH RECURSIVE {_outside('doc_id', 'text', 'documents')}, g AS (SELECT doc_id, pos, length(regexp_extract(line, '^(#{{1,6}})[ \t]+(.*?)[ \t]*$', 1)) AS level, regexp_extract(line, '^(#{{1,6}})[ \t]+(.*?)[ \t]*$', 2) AS title FROM o WHERE regexp_matches(line, '^(#{{1,6}})[ \t]+(.*?)[ \t]*$')),
        own AS (SELECT m.doc_id, m.line, m.pos AS line_pos, max(g.pos) OVER (PARTITION BY m.doc_id ORDER BY m.pos) AS pos FROM m LEFT JOIN g ON g.doc_id = m.doc_id AND g.pos = m.pos),
        sizes AS (SELECT doc_id, pos, CAST(sum(CASE WHEN line_pos = pos THEN 0 ELSE length(line) END) AS INTEGER) AS chars FROM own WHERE pos IS NOT NULL GROUP BY ALL),
        t AS (SELECT g.doc_id, g.pos, g.level, g.title, max(p.pos) AS parent_at FROM g LEFT JOIN g p ON p.doc_id = g.doc_id AND p.pos < g.pos AND p.level < g.level GROUP BY ALL),
        x AS (SELECT t.*, chars, EXISTS (SELECT 1 FROM t c WHERE c.doc_id = t.doc_id AND c.parent_at = t.pos) AS inner_ FROM t JOIN sizes USING (doc_id, pos)),
        y AS (SELECT *, level <= 3 AND NOT inner_ AND chars < 800 AND parent_at IS NOT NULL AS small FROM x), s AS (SELECT doc_id, parent_at, sum(chars) AS total FROM y WHERE small GROUP BY ALL)
        SELECT y.doc_id, y.pos AS at, y.level, y.title, y.parent_at, y.chars, y.level > 3 OR (y.small AND coalesce(s.total + p.chars <= 20000, false)) AS folded
        FROM y LEFT JOIN s ON s.doc_id = y.doc_id AND s.parent_at = y.parent_at LEFT JOIN x p ON p.doc_id = y.doc_id AND p.pos = y.parent_at""",
    "merged_checks": f"""SELECT repo_id, doc_id, section_id, '01' || coalesce(n.content_hash, o.content_hash) AS content_hash, coalesce(n.content_hash IS NULL OR n.content_hash = o.content_hash, false) AS confirmed
        FROM {_OLD} o FULL JOIN {_NOW} n USING (repo_id, doc_id, section_id)""",
}
