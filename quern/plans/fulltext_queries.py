"""Queries over full texts, the pages they come from, headings, and kept state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as tx
from quern.functions.vectors import hash_embedder
from quern.operators import catalog, differences, fulltext, markdown, ordered, records, sectioning, vectors
from quern.plans.store_oracle import _FTS, _NOW, _NUM, _ROW, _SEP, _outside
from quern.session import shared_folder
from quern.sources import table
from quern.streaming import claims

KEYS = ["repo_id", "doc_id", "section_id"]


def _fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fts").where("id IS NOT NULL").dropDuplicates(["id"])


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot's sections of documents that have pages, with their span, place and full text."""
    s = table(spark, sf_dir, "sections")
    now = differences.sections_at(s, differences.last_two(s)[1]).select(*KEYS, "id", "title")
    scanned = table(spark, sf_dir, "pdf_pages").select("repo_id", "doc_id").distinct()
    spans = table(spark, sf_dir, "unit_spans").groupBy(*KEYS).agg(F.min("page").alias("page"), F.max("end_page").alias("end_page"))
    texts = _fts(spark, sf_dir).select("id", F.coalesce("body_l3", F.lit("")).alias("l3"))
    place = F.row_number().over(Window.partitionBy("repo_id", "doc_id").orderBy(*catalog.reading_order()))
    return now.join(scanned, ["repo_id", "doc_id"], "left_semi").join(spans, KEYS, "left").join(texts, "id").withColumn("ord", place)


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.page_streams(table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "page_furniture"))


def page_words(spark, sf_dir):
    """How many words each page has without its running lines, and how many stand before it in its document."""
    return _streams(spark, sf_dir).select("repo_id", "doc_id", "page", F.size("words").alias("words"), "start")


def unverifiable_sections(spark, sf_dir):
    """Sections on whose pages there is no text."""
    return fulltext.unverifiable(_sections(spark, sf_dir), _streams(spark, sf_dir))


def content_findings(spark, sf_dir):
    """Passages that only a section's pages or only its full text has."""
    return fulltext.content_findings(_sections(spark, sf_dir), _streams(spark, sf_dir))


def break_findings(spark, sf_dir):
    """Paragraphs that break off where the pages run on."""
    return fulltext.break_findings(_sections(spark, sf_dir), table(spark, sf_dir, "pdf_pages"))


def order_findings(spark, sf_dir):
    """Sections that begin before the one they follow."""
    return fulltext.order_findings(_sections(spark, sf_dir), _streams(spark, sf_dir))


def fallback_findings(spark, sf_dir):
    """Sections of all documents with a made-up id though their heading begins with a number."""
    s = table(spark, sf_dir, "sections")
    return fulltext.fallback_findings(differences.sections_at(s, differences.last_two(s)[1]).withColumn("page", F.lit(0)))


def document_checks(spark, sf_dir):
    """All findings of the full-text check."""
    return fulltext.check_documents(_sections(spark, sf_dir), table(spark, sf_dir, "pdf_pages"), table(spark, sf_dir, "page_furniture"))


def outline_gaps(spark, sf_dir):
    """Ids that the headings on a document's pages have and its sections lack, and the reverse."""
    lines = table(spark, sf_dir, "pdf_pages").select("repo_id", "doc_id", F.explode(markdown.lines_of(F.col("page_text"))).alias("line"))
    outline = lines.select("repo_id", "doc_id", F.regexp_extract("line", r"^(\d+(?:\.\d+)*) \p{Lu}", 1).alias("section_id")).where("section_id <> ''").distinct()
    return fulltext.outline_gaps(_sections(spark, sf_dir), outline)


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pdf_pages").where("page IS NOT NULL").distinct()
    return pages.select("repo_id", "doc_id", "page", F.posexplode(markdown.lines_of(F.col("page_text"))).alias("at", "line"))


def parsed_headings(spark, sf_dir):
    """Ids and titles in the lines of all pages."""
    found = _page_lines(spark, sf_dir).withColumn("h", sectioning.section_ids(F.col("line"))).where("h IS NOT NULL")
    return found.select("repo_id", "doc_id", "page", "at", "h.section_id", "h.title")


def noise_headings(spark, sf_dir):
    """Lines of pages that no section begins with, though they stand like headings: repeated, captions or labels."""
    items = _page_lines(spark, sf_dir).withColumn("kind", F.when((F.trim("line") != "") & ~F.rtrim("line").rlike(r"[.,;?!]$"), "heading").otherwise("text"))
    order = items.withColumn("o", F.col("page") * 100_000 + F.col("at"))
    counted = sectioning.repeated_headings(order, ["repo_id", "doc_id"], "o", "page", "line")
    return counted.withColumn("reason", sectioning.noise_reason(F.col("heading"), F.col("pages"))).where("reason IS NOT NULL")


def uncarried_lines(spark, sf_dir):
    """Lines of pages that no section of the document carries."""
    items = _page_lines(spark, sf_dir).where("trim(line) <> ''").withColumn("item", F.concat_ws(":", "page", "at"))
    return sectioning.uncarried(items, _sections(spark, sf_dir), ["repo_id", "doc_id"], "item", "line", "l3")


def table_differences(spark, sf_dir):
    """How the tables of condensed texts differ from those of the full ones."""
    fts = _fts(spark, sf_dir)
    return records.table_differences(fts, markdown.tables(fts, "id", "body_l2"), markdown.tables(fts, "id", "body_l3"))


def written_sections(spark, sf_dir):
    """Sections that people write."""
    s = table(spark, sf_dir, "sections")
    return catalog.without_machine_sections(differences.sections_at(s, differences.last_two(s)[1]).select(*KEYS), table(spark, sf_dir, "docs"))


def safe_documents(spark, sf_dir):
    """Documents whose id is one."""
    return records.safe_doc_ids(table(spark, sf_dir, "docs").select("repo_id", "doc_id").distinct(), "doc_id")


def page_parts(spark, sf_dir):
    """The chapter that each section's page lies in, chapters beginning with their first page."""
    spans = table(spark, sf_dir, "unit_spans").groupBy(*KEYS).agg(F.max("page").alias("page"), F.max("file").alias("file"))
    items = spans.withColumn("at", F.row_number().over(Window.partitionBy("repo_id", "doc_id").orderBy(*catalog.reading_order())))
    parts = spans.where("page IS NOT NULL").groupBy("repo_id", "doc_id", F.col("file").alias("part")).agg(F.min("page").alias("page"))
    return ordered.part_of_page(items.select(*KEYS, "at", "page"), parts, ["repo_id", "doc_id"], "at", "page", "part").select(*KEYS, "part")


def stable_pages(spark, sf_dir):
    """Sections in order of their pages, those without one staying with the one before."""
    spans = table(spark, sf_dir, "unit_spans").groupBy(*KEYS).agg(F.max("page").alias("page"))
    return ordered.stable_by_page(spans, ["repo_id", "doc_id"], catalog.reading_order(), "page", "place").select(*KEYS, "place")


def user_events(spark, sf_dir):
    """For every user the different kinds of events that cost nothing, and what the others count as."""
    e = table(spark, sf_dir, "events").withColumn("as", F.when(F.col("event_type") == "purchase", "sale").when(F.col("event_type") == "signup", "lead"))
    found = records.set_aggregates(e, ["user_id"], "event_type", "as", F.col("as").isNotNull())
    pairs = F.transform(F.array_sort(F.map_entries("known_as")), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return found.select("user_id", F.array_join("unknown", ",").alias("unknown"), F.array_join(pairs, ",").alias("known_as"))


def lease_outcomes(spark, sf_dir):
    """Events as requests for a lease of their kind that lapses after an hour."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    asked = e.select(F.col("event_type").alias("name"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "release").otherwise("take").alias("action"), user.alias("holder"), user.alias("token"), F.lit("").alias("phase"), F.lit("").alias("pr"))
    return claims.outcomes(asked, ["name"], 3600)


def vector_backfill(spark, sf_dir):
    """A vector for every section, written in two runs: those of odd ids first, then what is missing."""
    path = f"{shared_folder(spark)}/quern/vectors-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "fts").select("id", tx.embedding_text(F.col("title"), F.col("summary"), F.col("body_l2")).alias("text"))
    for part in (rows.where("id % 2 = 1"), rows):
        vectors.backfill(part, path, "hash", "id", "text", hash_embedder(64))
    return spark.read.parquet(f"{path}/hash/data").select("id", F.size("vector").alias("dim"))


_FUNCTIONS = [v for v in list(globals().values()) if callable(v) and getattr(v, "__module__", None) == __name__ and not v.__name__.startswith("_")]
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_SPANS = "(SELECT repo_id, doc_id, section_id, min(page) AS page, max(end_page) AS end_page FROM unit_spans GROUP BY ALL)"
_READ = f"PARTITION BY repo_id, doc_id ORDER BY {_NUM}, section_id"
_LINE = r"(SELECT repo_id, doc_id, page, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT repo_id, doc_id, page, string_split_regex(page_text, '\r\n|\n|\r') AS x FROM (SELECT DISTINCT * FROM pdf_pages) WHERE page IS NOT NULL AND page_text IS NOT NULL))"
_ONE = r"trim(regexp_replace(line, '\s+', ' ', 'g'))"
_NUMBERED = r"'^(\d+(?:\.\d+)*)(?:[.\s]+(.*?))?\s*$'"
_PART = r"'(?i)^{}(?:\s*[.:–—-]\s*|\s+([0-9A-Za-z]+(?:\.[0-9A-Za-z]+)*)\s*[.:–—-]?\s*)(.*)$'".format
_CHAPTER = r"'(?i)^chapter\s+(\d+)\s*[.:–—-]?\s*(.*)$'"
_PARSED = f"""SELECT *, CASE WHEN regexp_matches(one, {_CHAPTER}) THEN regexp_extract(one, {_CHAPTER}, 1)
        WHEN regexp_matches(one, {_PART('attachment')}) THEN 'attachment' || CASE WHEN regexp_extract(one, {_PART('attachment')}, 1) <> '' THEN '-' || lower(regexp_extract(one, {_PART('attachment')}, 1)) ELSE '' END
        WHEN regexp_matches(one, {_PART('appendix')}) THEN 'appendix' || CASE WHEN regexp_extract(one, {_PART('appendix')}, 1) <> '' THEN '-' || lower(regexp_extract(one, {_PART('appendix')}, 1)) ELSE '' END
        WHEN regexp_matches(one, {_NUMBERED}) AND (trim(regexp_extract(one, {_NUMBERED}, 2)) <> '' OR contains(regexp_extract(one, {_NUMBERED}, 1), '.')) THEN regexp_replace(regexp_extract(one, {_NUMBERED}, 1), '^(\\d+)\\.0$', '\\1') END AS sid,
    trim(CASE WHEN regexp_matches(one, {_CHAPTER}) THEN coalesce(nullif(regexp_extract(one, {_CHAPTER}, 2), ''), one) WHEN regexp_matches(one, {_PART('attachment')}) THEN coalesce(nullif(regexp_extract(one, {_PART('attachment')}, 2), ''), one)
        WHEN regexp_matches(one, {_PART('appendix')}) THEN coalesce(nullif(regexp_extract(one, {_PART('appendix')}, 2), ''), one) ELSE regexp_extract(one, {_NUMBERED}, 2) END) AS title FROM (SELECT *, {_ONE} AS one FROM {_LINE})"""


def _tables(column: str) -> str:
    """The tables of a column, one text each, as CTE parts named after the column."""
    parts = _outside("id", column, _FTS)
    for name in ("m", "k", "w", "o"):
        parts = parts.replace(f"{name} AS MATERIALIZED", f"{name}_{column} AS MATERIALIZED").replace(f" {name} AS (", f" {name}_{column} AS (").replace(f"FROM {name} ", f"FROM {name}_{column} {name} ").replace(f"JOIN {name} ", f"JOIN {name}_{column} {name} ")
    return rf"""{parts}, t_{column} AS (SELECT id, min(pos) AS pos, array_to_string(list_transform(list_filter(list(line ORDER BY pos), lambda r: NOT regexp_matches(r, {_SEP})), lambda r: {_ROW}), chr(10)) AS t
        FROM (SELECT id, pos, trim(line) AS line, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run FROM o_{column} WHERE starts_with(ltrim(line), '|')) GROUP BY id, run)"""


ORACLE = {
    "unverifiable_sections": f"""WITH scanned AS (SELECT DISTINCT repo_id, doc_id FROM pdf_pages), s AS (SELECT n.repo_id, n.doc_id, n.section_id, p.page, greatest(coalesce(p.end_page, p.page), p.page) AS last FROM {_NOW} n JOIN scanned USING (repo_id, doc_id) JOIN {_SPANS} p USING (repo_id, doc_id, section_id) JOIN {_FTS} f ON f.id = n.id WHERE p.page IS NOT NULL)
        SELECT s.repo_id, s.doc_id, s.section_id, s.page FROM s JOIN pdf_pages g ON g.repo_id = s.repo_id AND g.doc_id = s.doc_id AND g.page BETWEEN s.page AND s.last GROUP BY ALL HAVING NOT bool_or(trim(regexp_replace(coalesce(page_text, ''), '\\s+', ' ', 'g')) <> '')""",
    "fallback_findings": rf"""WITH s AS (SELECT repo_id, doc_id, section_id, title, regexp_replace(substr(regexp_replace(regexp_replace(lower(nfc_normalize(title)), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', '') AS slug, regexp_replace(section_id, '-\d+$', '') AS bare FROM {_NOW})
        SELECT repo_id, doc_id, section_id, 0 AS page, title AS heading FROM s WHERE regexp_matches(regexp_extract(trim(title), '^(\S+)', 1), '\p{{N}}') AND ((regexp_matches(section_id, '^(.+-)?x\d+(-\d+)?$') AND NOT regexp_matches(section_id, '^(appendix|attachment)-x\d+(-\d+)?$'))
            OR (regexp_matches(replace(slug, '-', ''), '\P{{N}}') AND (section_id = slug OR ends_with(section_id, '-' || slug) OR bare = slug OR ends_with(bare, '-' || slug))))""",
    "outline_gaps": rf"""WITH o AS (SELECT DISTINCT repo_id, doc_id, regexp_extract(line, '^(\d+(?:\.\d+)*) \p{{Lu}}', 1) AS section_id FROM {_LINE}), w AS (SELECT * FROM o WHERE section_id <> ''), s AS (SELECT DISTINCT n.repo_id, n.doc_id, n.section_id FROM {_NOW} n JOIN (SELECT DISTINCT repo_id, doc_id FROM pdf_pages) USING (repo_id, doc_id) JOIN {_FTS} f ON f.id = n.id)
        SELECT repo_id, doc_id, section_id, 'missing' AS gap FROM (SELECT * FROM w WHERE len(string_split(section_id, '.')) <= 2 EXCEPT SELECT * FROM s)
        UNION ALL SELECT *, 'extra' FROM (SELECT * FROM s WHERE len(string_split(section_id, '.')) <= 2 AND regexp_matches(section_id, '^\d') AND (repo_id, doc_id) IN (SELECT (repo_id, doc_id) FROM w) EXCEPT SELECT * FROM w)""",
    "parsed_headings": f"SELECT repo_id, doc_id, page, pos AS at, sid AS section_id, title FROM ({_PARSED}) WHERE sid IS NOT NULL",
    "noise_headings": rf"""SELECT *, CASE WHEN regexp_matches(heading, '(?i)^(table|figure|fig\.?|diagram|chart|exhibit)\s+[a-z]?\d') THEN 'caption' WHEN len(regexp_extract_all(heading, '[\p{{L}}\p{{M}}\p{{N}}_/]+:\s')) >= 2 THEN 'label line' ELSE 'repeated' END AS reason FROM (
        SELECT repo_id, doc_id, one AS heading, count(DISTINCT page) AS pages FROM ({_PARSED}) WHERE trim(line) <> '' AND NOT regexp_matches(rtrim(line), '[.,;?!]$') AND NOT ends_with(one, ':') AND sid IS NULL GROUP BY ALL)
        WHERE pages >= 3 OR regexp_matches(heading, '(?i)^(table|figure|fig\.?|diagram|chart|exhibit)\s+[a-z]?\d') OR len(regexp_extract_all(heading, '[\p{{L}}\p{{M}}\p{{N}}_/]+:\s')) >= 2""",
    "uncarried_lines": rf"""WITH l AS (SELECT repo_id, doc_id, page || ':' || pos AS item, regexp_replace(line, '\s+', '', 'g') AS flat FROM {_LINE} WHERE trim(line) <> ''), s AS (SELECT n.repo_id, n.doc_id, string_agg(regexp_replace(coalesce(body_l3, ''), '\s+', '', 'g'), chr(10)) AS body FROM {_NOW} n JOIN {_FTS} f ON f.id = n.id GROUP BY ALL)
        SELECT l.repo_id, l.doc_id, item FROM l LEFT JOIN s USING (repo_id, doc_id) WHERE flat <> '' AND NOT contains(coalesce(body, ''), flat)""",
    "table_differences": f"""WITH RECURSIVE {_tables('body_l2')}, {_tables('body_l3')},
        b AS (SELECT id, t, sum(n) AS n FROM (SELECT id, t, 1 AS n FROM t_body_l2 UNION ALL SELECT id, t, -1 FROM t_body_l3) WHERE id IN (SELECT id FROM t_body_l3) GROUP BY ALL HAVING sum(n) <> 0),
        r AS (SELECT id FROM (SELECT id, list(t ORDER BY pos) AS o FROM t_body_l2 GROUP BY id) x JOIN (SELECT id, list(t ORDER BY pos) AS o FROM t_body_l3 GROUP BY id) y USING (id) WHERE x.o <> y.o AND id NOT IN (SELECT id FROM b))
        SELECT id, CASE WHEN n > 0 THEN 'extra' ELSE 'missing' END AS code, sum(abs(n)) AS n FROM b GROUP BY ALL UNION ALL SELECT id, 'reordered', 1 FROM r""",
    "written_sections": f"""SELECT repo_id, doc_id, section_id FROM {_NOW} n WHERE NOT starts_with(section_id, 'hist.') AND NOT EXISTS (SELECT 1 FROM docs d WHERE d.repo_id = n.repo_id AND d.doc_id = n.doc_id AND list_contains(d.tags, 'generated'))""",
    "safe_documents": "SELECT DISTINCT repo_id, doc_id FROM docs WHERE regexp_full_match(doc_id, '[A-Za-z0-9][A-Za-z0-9._-]*')",
    "page_parts": f"""WITH s AS (SELECT repo_id, doc_id, section_id, max(page) AS page, max(file) AS file FROM unit_spans GROUP BY ALL), i AS (SELECT *, row_number() OVER ({_READ}) AS o FROM s), f AS (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY repo_id, doc_id ORDER BY o) AS p FROM i),
        r AS (SELECT *, max(p) OVER (PARTITION BY repo_id, doc_id ORDER BY o) AS reached FROM f), parts AS (SELECT repo_id, doc_id, file AS part, min(page) AS first FROM s WHERE page IS NOT NULL GROUP BY ALL)
        SELECT r.repo_id, r.doc_id, r.section_id, coalesce((SELECT arg_max(part, row(first, part)) FROM parts x WHERE x.repo_id = r.repo_id AND x.doc_id = r.doc_id AND x.first <= r.reached), (SELECT arg_min(part, row(first, part)) FROM parts x WHERE x.repo_id = r.repo_id AND x.doc_id = r.doc_id)) AS part FROM r""",
    "stable_pages": f"""WITH s AS (SELECT repo_id, doc_id, section_id, max(page) AS page FROM unit_spans GROUP BY ALL), f AS (SELECT *, row_number() OVER ({_READ}) AS o, coalesce(last_value(page IGNORE NULLS) OVER ({_READ} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS p FROM s)
        SELECT repo_id, doc_id, section_id, row_number() OVER (PARTITION BY repo_id, doc_id ORDER BY p, o) AS place FROM f""",
    "user_events": """SELECT user_id, coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type NOT IN ('purchase', 'signup'))), ','), '') AS unknown,
        coalesce(array_to_string(list_sort(list(DISTINCT event_type || '=' || CASE event_type WHEN 'purchase' THEN 'sale' ELSE 'lead' END) FILTER (event_type IN ('purchase', 'signup'))), ','), '') AS known_as FROM events GROUP BY user_id""",
    "vector_backfill": "SELECT DISTINCT id, 64 AS dim FROM fts WHERE id IS NOT NULL",
}
