"""Documents as trees of headings, their layout on pages, references to them, and what a page has that the text lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.markdown import HEADING, lines_of, outside_fences, unfenced_lines

#: A heading of any level.
ANY_HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t]*$"
#: Fixed value: how a reference to a section is written.
REFERENCE = r"^(?:([A-Za-z0-9][A-Za-z0-9._-]*(?:/[A-Za-z0-9][A-Za-z0-9._-]*)*):)?([A-Za-z0-9][A-Za-z0-9._-]*) §?(\S+)$"
#: Fixed value: marks that end a sentence.
TERMINAL = r"[.!?:;)\"»”]$"


def heading_ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, at, section_id, title`` of the ``## id title`` lines outside fenced code."""
    found = unfenced_lines(df, key, text).where(F.col("line").rlike(HEADING))
    return found.select(key, "at", F.regexp_extract("line", HEADING, 1).alias("section_id"), F.trim(F.coalesce(F.regexp_extract("line", HEADING, 2), F.lit(""))).alias("title"))


def orphan_headings(headings: DataFrame, known: DataFrame, keys: list[str], bare_allowed: bool) -> DataFrame:
    """Headings whose id isn't known; where ``bare_allowed``, one without a title is a writer's own and no orphan."""
    odd = headings.join(known.select(*keys, "section_id").distinct(), [*keys, "section_id"], "left_anti")
    return odd.where("title <> ''") if bare_allowed else odd


def body_under(text: Column, heading: str) -> Column:
    """What stands under an exact heading line, up to the next of first or second level; null if it isn't there."""
    all_lines = lines_of(text)
    at = F.array_position(F.transform(all_lines, lambda x: F.rtrim(x)), F.lit(heading))
    after = F.slice(all_lines, at.cast("int") + 1, F.size(all_lines))
    ends = F.filter(F.transform(after, lambda x, i: F.when(x.rlike("^##? "), i)), lambda i: i.isNotNull())
    until = F.when(F.size(ends) > 0, F.get(ends, F.lit(0))).otherwise(F.size(after))
    return F.when(at > 0, F.regexp_replace(F.array_join(F.slice(after, F.lit(1), until), "\n"), r"^\s+|\s+$", ""))


def heading_tree(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, at, level, title, parent_at, chars``: every heading outside fences with the heading it is under.

    ``at`` is its line; ``parent_at``, the last heading before it of a level above, is
    null at the top; ``chars`` counts what stands below it and before the next heading.
    The last heading of each level is carried along the headings of a text.
    """
    found = F.filter(outside_fences(F.col(text)), lambda x: x["line"].rlike(ANY_HEADING))
    heads = F.transform(found, lambda x: F.struct(x["at"].alias("at"), F.length(F.regexp_extract(x["line"], ANY_HEADING, 1)).alias("level"), F.regexp_extract(x["line"], ANY_HEADING, 2).alias("title")))
    rows = df.where(F.col(text).isNotNull()).select(key, F.transform(lines_of(F.col(text)), lambda x: F.char_length(x)).alias("_sizes"), heads.alias("_h")).where(F.size("_h") > 0)
    begun = F.struct(F.array_repeat(F.lit(None).cast("int"), 6).alias("last"), F.array().cast("array<int>").alias("above"))

    def step(state: Column, head: Column) -> Column:
        above = F.array_max(F.slice(state["last"], F.lit(1), head["level"] - 1))
        last = F.transform(state["last"], lambda x, i: F.when(i == head["level"] - 1, head["at"]).when(i >= head["level"], F.lit(None).cast("int")).otherwise(x))
        return F.struct(last.alias("last"), F.concat(state["above"], F.array(above)).alias("above"))

    each = rows.withColumn("_above", F.aggregate("_h", begun, step)["above"]).select(key, "_sizes", "_h", "_above", F.posexplode("_h").alias("_n", "_own"))
    until = F.coalesce(F.get("_h", F.col("_n") + 1)["at"], F.size("_sizes"))
    below = F.slice("_sizes", F.col("_own.at") + 2, until - F.col("_own.at") - 1)
    return each.select(key, "_own.at", "_own.level", "_own.title", F.get("_above", F.col("_n")).alias("parent_at"), F.aggregate(below, F.lit(0), lambda s, x: s + x).alias("chars"))


def folded(tree: DataFrame, key: str, depth: int = 3, least: int = 800, most: int = 20_000) -> DataFrame:
    """A heading tree with ``folded``: whether a heading's text goes to the one above it.

    So do headings deeper than ``depth``, and leaves shorter than ``least``, unless all
    such leaves together would make their parent longer than ``most``; then none of them do.
    """
    parents = tree.select(key, F.col("parent_at").alias("at")).where("at IS NOT NULL").distinct().withColumn("_inner", F.lit(True))
    marked = tree.join(parents, [key, "at"], "left")
    small = (F.col("level") <= depth) & F.col("_inner").isNull() & (F.col("chars") < least) & F.col("parent_at").isNotNull()
    marked = marked.withColumn("_small", small)
    sums = marked.where("_small").groupBy(key, "parent_at").agg(F.sum("chars").alias("_sum"))
    above = tree.select(key, F.col("at").alias("parent_at"), F.col("chars").alias("_own"))
    sized = marked.join(sums, [key, "parent_at"], "left").join(above, [key, "parent_at"], "left")
    fits = F.coalesce(F.col("_sum") + F.col("_own") <= most, F.lit(False))
    return sized.select(*tree.columns, ((F.col("level") > depth) | (F.col("_small") & fits)).alias("folded"))


def layout_order(items: DataFrame, page: list[str], spanning: float = 0.6) -> DataFrame:
    """Items of pages with ``place`` in reading order, by their boxes ``x0, y0, x1, y1`` and their ``item`` number.

    An item that spans so much of the page's width begins a band; within a band the
    left column comes before the right, from top to bottom.
    """
    whole = Window.partitionBy(*page)
    left, right = F.min("x0").over(whole), F.max("x1").over(whole)
    wide = items.withColumns({"_left": left, "_right": right}).withColumn("_wide", (F.col("_right") > F.col("_left")) & (F.col("x1") - F.col("x0") >= spanning * (F.col("_right") - F.col("_left"))))
    band = F.count_if(F.col("_wide")).over(whole.orderBy("y0").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    column = F.when(F.col("_wide"), -1).when((F.col("x0") + F.col("x1")) / 2 < (F.col("_left") + F.col("_right")) / 2, 0).otherwise(1)
    placed = wide.withColumns({"_band": band, "_column": column})
    place = F.row_number().over(whole.orderBy("_band", "_column", "y0", "item"))
    return placed.withColumn("place", place).drop("_left", "_right", "_wide", "_band", "_column")


def parsed_references(df: DataFrame, text: str) -> DataFrame:
    """The rows with ``ref_repo``, ``ref_doc`` and ``ref_section``; all null where the text is no reference, and the repository where it names none."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    is_one = one.rlike(REFERENCE)
    part = lambda n: F.when(is_one, F.nullif(F.regexp_extract(one, REFERENCE, n), F.lit("")))
    return df.withColumns({"ref_repo": part(1), "ref_doc": part(2), "ref_section": part(3)})


def split_paragraphs(rows: DataFrame, pages: DataFrame, keys: list[str], text: str, words: int = 3) -> DataFrame:
    """``keys, at, tail, head``: paragraphs of ``text`` that break off in mid-sentence while a page's text runs on.

    ``pages`` has ``keys`` and ``page_text``. The last words of a paragraph and the
    first of the next must stand side by side on a page of the section.
    """
    blocks = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"\n[ \t]*(?:\n[ \t]*)+"), lambda x: F.trim(x)), lambda x: x != "")
    prose = lambda x: ~x.rlike(r"(?m)^[ \t]*(\||#|[-*+] |\d+[.)] |```|~~~|!\[|FN-)")
    each = rows.select(*keys, blocks.alias("b")).where(F.size("b") > 1).select(*keys, "b", F.posexplode(F.slice("b", F.lit(2), F.size("b") - 1)).alias("at", "second"))
    pairs = each.select(*keys, "at", F.get("b", F.col("at")).alias("first"), "second").where(prose(F.col("first")) & prose(F.col("second")) & ~F.col("first").rlike(TERMINAL))
    own = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    a, b = own(F.col("first")), own(F.col("second"))
    joins = pairs.select(*keys, "at", F.array_join(F.slice(a, F.greatest(F.size(a) - words + 1, F.lit(1)), F.lit(words)), " ").alias("tail"), F.array_join(F.slice(b, F.lit(1), F.lit(words)), " ").alias("head"))
    joins = joins.where(F.col("tail").contains(" ") & F.col("head").contains(" "))
    there = pages.select(*keys, F.concat(F.lit(" "), F.array_join(own(F.coalesce("page_text", F.lit(""))), " "), F.lit(" ")).alias("_page"))
    met = joins.join(there, keys).where(F.col("_page").contains(F.concat(F.lit(" "), "tail", F.lit(" "), "head", F.lit(" "))))
    return met.select(*keys, "at", "tail", "head").distinct()


def usage_counts(json: Column) -> dict[str, Column]:
    """The numbers of a usage block in JSON: parts of a cache that was written, or else its total as the short-lived part; missing ones are 0."""
    number = lambda path: F.coalesce(F.try_to_number(F.get_json_object(json, path), F.lit("999999999999999999")).cast("long"), F.lit(0).cast("long"))
    parts = F.get_json_object(json, "$.cache_creation").isNotNull()
    return {
        "tokens_in": number("$.input_tokens"),
        "tokens_out": number("$.output_tokens"),
        "cache_read": number("$.cache_read_input_tokens"),
        "cache_short": F.when(parts, number("$.cache_creation.ephemeral_5m_input_tokens")).otherwise(number("$.cache_creation_input_tokens")),
        "cache_long": F.when(parts, number("$.cache_creation.ephemeral_1h_input_tokens")).otherwise(F.lit(0).cast("long")),
        "searches": number("$.server_tool_use.web_search_requests"),
    }


def stale_days(today: Column, written: Column, never: int = 36_500) -> Column:
    """Days since a date that is written as text; very many where it can't be read."""
    return F.coalesce(F.datediff(today, F.try_to_date(F.substring(F.trim(written), 1, 10))), F.lit(never))


def bits_apart(a: Column, b: Column) -> Column:
    """In how many bits two hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def merged_checks(old: DataFrame, fresh: DataFrame, keys: list[str], same: list[str], kept: list[str]) -> DataFrame:
    """Results of a check, old ones kept where there is no fresh one; fresh ones keep the old columns ``kept`` if they agree in ``same``."""
    a, b = old.alias("a"), fresh.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    renewed = F.col(f"b.{keys[0]}").isNotNull()
    agrees = F.lit(True)
    for c in same:
        agrees = agrees & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    inherit = F.col(f"a.{keys[0]}").isNotNull() & (~renewed | agrees)
    return joined.select(
        *[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys],
        *[F.when(renewed, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in same],
        *[F.when(inherit, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in kept],
    )
