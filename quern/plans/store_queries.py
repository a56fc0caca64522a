"""Queries over the catalogue, differences between versions, ordered rows, quality rules, usage and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as tx
from quern.operators import catalog, differences, graphs, markdown, ordered, quality, usage
from quern.operators.snapshots import clean_digest, current_sections, latest_rows
from quern.plans.store_oracle import ORACLE  # noqa: F401
from quern.sources import table

KEYS = ["repo_id", "doc_id", "section_id"]


def _fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fts").where("id IS NOT NULL").dropDuplicates(["id"])


def _repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.current_repos(table(spark, sf_dir, "repos"), table(spark, sf_dir, "docs"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sections")
    return differences.sections_at(s, differences.last_two(s)[1])


# Catalogue


def repo_kinds(spark, sf_dir):
    """Repositories of the last snapshot with their kind, recorded or inferred."""
    return _repos(spark, sf_dir)


def kind_filtered_sections(spark, sf_dir):
    """Sections of repositories of some kinds."""
    return catalog.of_kinds(current_sections(table(spark, sf_dir, "sections")), _repos(spark, sf_dir), ["KB", "dev "])


def section_projection(spark, sf_dir):
    """Sections with what the catalogue knows of their repository."""
    rows = _sections(spark, sf_dir).select(*KEYS, "id", "title", "file", "doc_revision")
    return rows.join(_repos(spark, sf_dir).select("repo_id", "kind"), "repo_id", "left").withColumn("kind", F.coalesce("kind", F.lit("")))


def tag_vocab(spark, sf_dir):
    """Every tag with its first spelling."""
    return catalog.tag_vocabulary(table(spark, sf_dir, "docs").distinct())


def doc_stats(spark, sf_dir):
    """Estimated tokens of each document's layers."""
    return catalog.doc_stats(current_sections(table(spark, sf_dir, "sections")), table(spark, sf_dir, "fts"))


def store_stats(spark, sf_dir):
    """Counts over the whole store."""
    return catalog.store_stats(catalog.current_docs(table(spark, sf_dir, "docs")), current_sections(table(spark, sf_dir, "sections")), _repos(spark, sf_dir))


def catalog_counts(spark, sf_dir):
    """Orders by status for every customer, with the share of finished ones."""
    return catalog.counts_by(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["O", "P", "F"], ["F"])


def token_stats(spark, sf_dir):
    """Least, median, mean and greatest size of sections by layer."""
    texts = {"l1": F.concat_ws("\n", "title", "summary"), "l2": F.col("body_l2"), "l3": F.col("body_l3")}
    layers = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), tx.token_estimate(t).alias("size")) for n, t in texts.items()]))
    each = _fts(spark, sf_dir).select(layers.alias("x")).select("x.*")
    return each.groupBy("layer").agg(F.min("size").alias("least"), F.median("size").alias("middle"), F.round(F.avg("size"), 6).alias("mean"), F.max("size").alias("most"), F.count("*").alias("n"))


def last_publish(spark, sf_dir):
    """When anything was published last, and how many repositories there are."""
    return _repos(spark, sf_dir).agg(F.max(F.nullif(F.trim("published_at"), F.lit(""))).alias("published_at"), F.count("*").alias("repos"))


def ambiguous_ids(spark, sf_dir):
    """Documents' names that more than one repository has, as ids that tell none of them."""
    docs = table(spark, sf_dir, "docs")
    return catalog.held_twice(docs.select(F.lower(F.trim("title")).alias("doc_id"), "repo_id").unionByName(docs.select("doc_id", "repo_id")))


def longest_prefix(spark, sf_dir):
    """The section that encloses each section, by its number."""
    s = current_sections(table(spark, sf_dir, "sections")).select(*KEYS)
    return catalog.parent_of(s, s, ["repo_id", "doc_id"], "section_id", "section_id")


def prev_next(spark, sf_dir):
    """Neighbours of every section."""
    return catalog.neighbours_in_doc(current_sections(table(spark, sf_dir, "sections")))


def chapter_starts(spark, sf_dir):
    """Sections that begin a chapter's file."""
    return catalog.chapter_starts(_sections(spark, sf_dir))


def review_queue(spark, sf_dir):
    """The eight orders to look at first: open ones before those in progress, then by key."""
    first = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return table(spark, sf_dir, "orders").orderBy(first, "o_orderkey").limit(8).select("o_orderkey", "o_orderstatus")


def content_digest(spark, sf_dir):
    """Digest of every section's text."""
    return _fts(spark, sf_dir).select("id", tx.content_digest(*[F.col(c) for c in ("title", "summary", "body_l2", "body_l3")]).alias("digest"))


def tree_digest(spark, sf_dir):
    """Digest of every repository's sections."""
    rows = _sections(spark, sf_dir)
    return catalog.tree_digest(rows, "repo_id", F.concat_ws("/", "doc_id", "file", "section_id"), F.lower(F.hex("content_hash")))


def occurrences(spark, sf_dir):
    """Which occurrence of its title a section is in its document."""
    return ordered.numbered_again(_sections(spark, sf_dir).select(*KEYS, "title"), ["repo_id", "doc_id"], [F.col("section_id")], "title", "occurrence")


# Differences


def manifest_diff(spark, sf_dir):
    """What a mirror of the snapshot before would have to copy and delete."""
    s = table(spark, sf_dir, "sections")
    path = F.concat_ws("/", *KEYS).alias("path")
    old, new = (differences.sections_at(s, n).select(path, "content_hash") for n in differences.last_two(s))
    return differences.manifest_difference(new, old, "path", "content_hash")


def section_diff_flags(spark, sf_dir):
    """How sections of the last snapshot differ from the one before."""
    s = table(spark, sf_dir, "sections")
    old, new = (differences.sections_at(s, n) for n in differences.last_two(s))
    return differences.difference_flags(old, new, KEYS, {"content": "content_hash", "title": "title", "moved": "file", "revised": "doc_revision"})


def fact_diff(spark, sf_dir):
    """Tags that the tag table has and the documents don't, and the reverse."""
    docs = table(spark, sf_dir, "docs").select("repo_id", "doc_id", F.explode("tags").alias("tag")).withColumn("tag", F.lower(F.trim("tag")))
    tags = table(spark, sf_dir, "doc_tags").withColumn("tag", F.lower(F.trim("tag")))
    return differences.set_difference(docs, tags, ["repo_id", "doc_id"], "tag")


def multiset_compare(spark, sf_dir):
    """Lines of order priorities and statuses by year, as bags: each year's against those of the year before."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderstatus")
    first, last = (o.select(f("year")).scalar() for f in (F.min, F.max))
    before = o.where(F.col("year") < last).withColumn("year", F.col("year") + 1)
    return differences.bag_difference(before, o.where(F.col("year") > first), o.columns)


def symmetric_difference(spark, sf_dir):
    """Rows of the snapshots' keys that only one of the last two has, kept as often as they occur."""
    s = table(spark, sf_dir, "sections")
    before, last = differences.last_two(s)
    a, b = (s.where(F.col("snapshot_no") == n).select(*KEYS, "title") for n in (before, last))
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


def citation_status(spark, sf_dir):
    """Whether citations of every section of every version hold today."""
    s = table(spark, sf_dir, "sections")
    values = {"content_hash": clean_digest(F.col("content_hash"))}
    pinned = latest_rows(s.withColumns(values).withColumnRenamed("snapshot_no", "version"), ["version", *KEYS], "delivered_at", ["content_hash"])
    return differences.resolve_citations(pinned.select("version", *KEYS), pinned, _sections(spark, sf_dir))


# Ordered rows


def ffill_page(spark, sf_dir):
    """The last known page of every section in reading order."""
    spans = table(spark, sf_dir, "unit_spans").distinct()
    rows = current_sections(table(spark, sf_dir, "sections")).select(*KEYS).join(spans.select(*KEYS, "page").groupBy(*KEYS).agg(F.max("page").alias("page")), KEYS, "left")
    return ordered.fill_forward(rows, ["repo_id", "doc_id"], catalog.reading_order(), "page", "known_page").select(*KEYS, "page", "known_page")


def page_islands(spark, sf_dir):
    """Runs of a supplier's line items with the same flag, by date and key."""
    rows = table(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    return ordered.runs(rows, ["l_suppkey"], order, "l_returnflag")


def order_inversions(spark, sf_dir):
    """On each scanned page, the first numbered heading that stands after a later one of the same chapter."""
    lines = table(spark, sf_dir, "pdf_pages").distinct().select("repo_id", "doc_id", "page", F.posexplode(markdown.lines_of(F.col("page_text"))).alias("at", "line"))
    heads = lines.withColumn("section_id", F.regexp_extract("line", r"^(\d+(?:\.\d+)*) \S", 1)).where("section_id <> ''")
    return ordered.sibling_inversions(heads, ["repo_id", "doc_id", "page"], [F.col("at")], "section_id")


def page_inversions(spark, sf_dir):
    """Sections whose page is before that of the section before them."""
    spans = table(spark, sf_dir, "unit_spans").groupBy(*KEYS).agg(F.max("page").alias("page"))
    return ordered.inversions(spans, ["repo_id", "doc_id"], catalog.reading_order(), "page").select(*KEYS, "page", "before")


def sticky_phase(spark, sf_dir):
    """A user's phase: the last purchase or signup, forgotten at an error."""
    events = table(spark, sf_dir, "events")
    mention = F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type"))
    return ordered.sticky(events, ["user_id"], [F.col("ts"), F.col("event_id")], mention, F.col("event_type") == "error", "unknown", "phase").select("event_id", "user_id", "phase")


def asof_cursor(spark, sf_dir):
    """The value of a user's last signup, by file order, up to each click."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    points = events.where("event_type = 'signup'").select("user_id", "ts", F.pmod(F.col("event_id") * 7919, F.lit(100003)).alias("at"), "value")
    return ordered.as_of(events.where("event_type = 'click'").select("user_id", "ts", "event_id"), points, ["user_id"], "ts", "at", "value", "signed").select("event_id", "user_id", "signed")


def call_collapse(spark, sf_dir):
    """Events of a user and kind within an hour as one call."""
    events = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return ordered.collapse_calls(events, ["user_id", "hour"], "event_id", "value", ["event_type", "ts"], ["value", "props"])


def known_failures(spark, sf_dir):
    """Users' errors since their last purchase."""
    return ordered.open_failures(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")


def latest_closing(spark, sf_dir):
    """Every user's newest event, and whether any was a purchase, which is final."""
    newest = F.max_by("event_type", F.struct("ts", "event_id"))
    done = F.bool_or(F.col("event_type") == "purchase")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(done, "purchase").otherwise(newest).alias("state"), done.alias("closed"))


def unique_titles(spark, sf_dir):
    """Sections' titles made unique within their document."""
    return ordered.unique_names(_sections(spark, sf_dir).select("repo_id", "doc_id", "section_id", "title"), ["repo_id", "doc_id"], "section_id", "title")


def ordered_distinct(spark, sf_dir):
    """Every user's kinds of events in the order of their first occurrence."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))


# Text and quality


def line_split(spark, sf_dir):
    """Lines of every document."""
    return markdown.lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def section_units(spark, sf_dir):
    """The documents' ``##`` units."""
    return markdown.units(table(spark, sf_dir, "documents"), "doc_id", "text")


def unfenced_lines(spark, sf_dir):
    """Lines of the full texts outside fenced code."""
    return markdown.unfenced_lines(_fts(spark, sf_dir), "id", "body_l3")


def table_cells(spark, sf_dir):
    """Cells of the full texts' tables."""
    return markdown.table_cells(_fts(spark, sf_dir), "id", "body_l3")


def prose_projection(spark, sf_dir):
    """The prose of every condensed text."""
    return _fts(spark, sf_dir).select("id", markdown.prose(F.col("body_l2")).alias("prose"))


def subsections(spark, sf_dir):
    """The documents' ``###`` units."""
    return markdown.units(table(spark, sf_dir, "documents"), "doc_id", "text", 3)


def section_slices(spark, sf_dir):
    """The first and second unit of each heading's id, and sub-units where no unit has it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    heads = markdown.lines(docs, "doc_id", "text").withColumn("section_id", F.regexp_extract("line", r"^##+ (\S+)", 1)).where("section_id <> ''")
    asked = heads.select("doc_id", "section_id").distinct().select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("occurrence"))
    return markdown.slices(docs, "doc_id", "text", asked).where("body IS NOT NULL")


def table_blocks(spark, sf_dir):
    """The full texts' tables, each as a whole."""
    return markdown.tables(_fts(spark, sf_dir), "id", "body_l3").withColumn("rows", F.array_join("rows", "\n"))


def slugs(spark, sf_dir):
    """Section ids made from titles, in ASCII and in any script."""
    return _fts(spark, sf_dir).select("id", tx.slug(F.col("title")).alias("slug"), tx.slug_id(F.col("title")).alias("slug_id"))


def redacted_urls(spark, sf_dir):
    """Repositories' addresses without credentials."""
    return table(spark, sf_dir, "repos").select("repo_id", "snapshot_no", tx.redact_url(F.regexp_replace("source_url", "://", "://user:secret@")).alias("url"))


def quality_length(spark, sf_dir):
    """Condensed texts of the wrong length."""
    return quality.length_rule(_fts(spark, sf_dir))


def invented_codes(spark, sf_dir):
    """Codes that only the condensed text has."""
    return quality.invented_codes(_fts(spark, sf_dir))


def overlap_share(spark, sf_dir):
    """Words the condensed text shares with the full one."""
    return quality.overlap_share(_fts(spark, sf_dir)).select("id", F.round("share", 6).alias("share"))


def transcribed_tables(spark, sf_dir):
    """Sentences that quote two or more different cells of their section's tables."""
    return quality.transcribed_tables(_fts(spark, sf_dir), 2)


def shingle_coverage(spark, sf_dir):
    """Four-word runs of the condensed text that the full one lacks."""
    return quality.uncovered_shingles(_fts(spark, sf_dir))


def shingle_runs(spark, sf_dir):
    """Where five or more words of the condensed text aren't covered by the full one."""
    return quality.uncovered_runs(_fts(spark, sf_dir))


def digest_drift(spark, sf_dir):
    """Sections whose text, read with line feeds only, isn't the recorded one."""
    recorded = table(spark, sf_dir, "sections").select("id", "content_hash")
    read = table(spark, sf_dir, "fts").withColumn("body_l3", F.replace("body_l3", F.lit("\r\n"), F.lit("\n")))
    return quality.digest_drift(recorded, read)


def build_gate(spark, sf_dir):
    """All quality rules."""
    return quality.build_gate(_fts(spark, sf_dir))


def shared_pages(spark, sf_dir):
    """Sections that share pages with others."""
    return quality.shared_pages(table(spark, sf_dir, "unit_spans"), table(spark, sf_dir, "pdf_pages"))


def missing_spans(spark, sf_dir):
    """Sections whose place in the source isn't known."""
    return current_sections(table(spark, sf_dir, "sections")).select(*KEYS).join(table(spark, sf_dir, "unit_spans").select(*KEYS), KEYS, "left_anti")


# Usage and graphs


def usage_grouping_sets(spark, sf_dir):
    """Events by kind, by user and by what their properties say, in one pass."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("decade", F.when(F.col("k") >= 10, F.floor(F.col("k") / 10).cast("int")))
    return usage.by_dimensions(e.withColumn("cents", F.round(F.col("value") * 100).cast("long")), ["event_type", "user_id", "decade"], {"cents": "cents"})


def share_fallback(spark, sf_dir):
    """The share of errors in value."""
    e = table(spark, sf_dir, "events").withColumns({"err": F.col("event_type") == "error", "cents": F.round(F.col("value") * 100).cast("long"), "one": F.lit(1)})
    return usage.share_of(e, "err", ["cents", "one"])


def bucket_rank(spark, sf_dir):
    """Suppliers by revenue, then quantity, then key."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return sums.orderBy(F.desc("revenue"), F.desc("quantity"), "l_suppkey").limit(20)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return parts, parts.where("node > 0").select("node", F.floor(F.col("node") / 2).cast("long").alias("needs"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ten = F.floor(F.col("node") / 10)
    w = Window.partitionBy("ten").orderBy("node")
    parts, halves = _halves(spark, sf_dir)
    rings = parts.withColumn("ten", ten).where("ten % 2 = 0").select("node", F.coalesce(F.lead("node").over(w), F.min("node").over(Window.partitionBy("ten"))).alias("needs"))
    return halves.unionByName(rings)


def dependency_waves(spark, sf_dir):
    """Parts in waves, each after the one of half its number."""
    return graphs.waves(*_halves(spark, sf_dir))


def dependency_closure(spark, sf_dir):
    """All parts that a part depends on."""
    return graphs.closure(_halves(spark, sf_dir)[1])


def dependency_cycles(spark, sf_dir):
    """Parts that depend on themselves, where each needs that of half its number, and every other ten need one another in a ring."""
    return graphs.in_cycles(_rings(spark, sf_dir))


def dependency_cycle_groups(spark, sf_dir):
    """The same with the cycle each is in, by its greatest part."""
    return graphs.cycle_groups(_rings(spark, sf_dir))


def dependency_conflicts(spark, sf_dir):
    """Parts that have a brand in common with others they neither need nor are needed by."""
    paths = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("node"))
    return graphs.conflict_counts(paths, _halves(spark, sf_dir)[1])


_FUNCTIONS = [v for v in list(globals().values()) if callable(v) and getattr(v, "__module__", None) == __name__ and not v.__name__.startswith("_")]
QUERIES = {f.__name__: f for f in _FUNCTIONS}
