"""Rules a condensed text has to keep, as rows of violations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quern.functions.text import content_digest
from quern.operators.markdown import prose, table_rows
from quern.operators.snapshots import clean_digest

#: Fixed values of the rules.
FLOOR, RATIO, BRIEF = 120, 0.35, 200
SUMMARY_WORDS = 25
OVERLAP_WORDS, OVERLAP_SHARE = 20, 0.45
CELLS = 4


def budget(chars: Column) -> Column:
    """How long a condensed text may be."""
    return F.greatest(F.lit(FLOOR), (F.lit(RATIO) * chars).cast("int"))


def words(text: Column) -> Column:
    """Words with numbers and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def length_rule(rows: DataFrame) -> DataFrame:
    """``id, code, n, allowed``: condensed prose that is missing, too long, or not the very text of a brief section."""
    sized = rows.select("id", prose(F.col("body_l2")).alias("l2"), prose(F.col("body_l3")).alias("l3")).withColumns({"n2": F.char_length("l2"), "n3": F.char_length("l3")})
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    code = (
        F.when((F.col("n3") > BRIEF) & (F.col("n2") == 0), "empty")
        .when((F.col("n3") > BRIEF) & (F.col("n2") > budget(F.col("n3"))), "ratio")
        .when((F.col("n3") > 0) & (F.col("n3") <= BRIEF) & (one("l2") != one("l3")), "verbatim")
    )
    return sized.select("id", code.alias("code"), F.col("n2").alias("n"), budget(F.col("n3")).alias("allowed")).where("code IS NOT NULL")


def summary_words(rows: DataFrame, most: int = SUMMARY_WORDS) -> DataFrame:
    """``id, n`` of summaries with more words than allowed."""
    n = F.size(F.filter(F.split(F.coalesce("summary", F.lit("")), r"\s+"), lambda w: w != ""))
    return rows.select("id", n.alias("n")).where(F.col("n") > most)


def invented_codes(rows: DataFrame) -> DataFrame:
    """``id, code``: codes in capitals of the condensed prose that the full text doesn't have as words of their own."""
    codes = F.array_distinct(F.regexp_extract_all(prose(F.col("body_l2")), F.lit(r"(?U)\b([A-Z][A-Z0-9/]{1,7})\b"), F.lit(1)))
    found = rows.select("id", F.coalesce("body_l3", F.lit("")).alias("l3"), F.explode(codes).alias("code"))
    return found.where(~F.expr(r"regexp_like(l3, concat('(?<![\\p{L}\\p{N}_])', code, '(?![\\p{L}\\p{N}_])'))")).select("id", "code")


def overlap_share(rows: DataFrame) -> DataFrame:
    """``id, share``: which share of the different words of the condensed prose the full text has."""
    own = words(prose(F.col("body_l2")))
    sized = rows.select("id", own.alias("w"), F.array_distinct(own).alias("a"), F.array_distinct(words(F.coalesce("body_l3", F.lit("")))).alias("b")).where(F.size("w") >= OVERLAP_WORDS)
    return sized.select("id", (F.size(F.array_intersect("a", "b")) / F.size("a")).alias("share"))


def low_overlap(rows: DataFrame, least: float = OVERLAP_SHARE) -> DataFrame:
    """Condensed texts that share too few words with the full one."""
    return overlap_share(rows).where(F.col("share") < least)


def transcribed_tables(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """``id, at, n``: sentences of the condensed prose that quote so many different cells of the section's tables as words of their own."""
    parts = F.flatten(F.transform(table_rows(F.coalesce("body_l3", F.lit(""))), lambda r: F.split(r, r"\|")))
    kept = F.array_distinct(F.filter(parts, lambda c: (F.char_length(c) >= 2) & ~F.regexp_replace(c, "[,.%/-]", "").rlike(r"^\p{N}+$")))
    with_cells = rows.select("id", prose(F.col("body_l2")).alias("l2"), kept.alias("cells")).where(F.size("cells") >= cells)
    sentences = with_cells.select("id", "cells", F.posexplode(F.split("l2", r"(?<=[.!?])\s+|\n+")).alias("at", "sentence"))

    def quoted(c: Column) -> Column:
        literal = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
        return F.contains(F.col("sentence"), c) & F.call_function("regexp_like", F.col("sentence"), literal)

    n = F.size(F.filter("cells", quoted))
    return sentences.select("id", "at", n.alias("n")).where(F.col("n") >= cells)


def digest_drift(sections: DataFrame, fts: DataFrame) -> DataFrame:
    """``id`` of sections whose recorded digest is not that of their text."""
    texts = fts.dropDuplicates(["id"]).select("id", clean_digest(content_digest(*[F.col(c) for c in ("title", "summary", "body_l2", "body_l3")])).alias("own"))
    return sections.select("id", clean_digest(F.col("content_hash")).alias("recorded")).join(texts, "id").where("own <> recorded").select("id").distinct()


def build_gate(rows: DataFrame) -> DataFrame:
    """All rules over all rows: ``rule, id``."""
    found = {"length": length_rule(rows), "summary": summary_words(rows), "codes": invented_codes(rows), "overlap": low_overlap(rows), "tables": transcribed_tables(rows)}
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), "id").distinct() for rule, df in found.items()])


def shared_pages(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """``repo_id, doc_id, section_id, others``: with how many other sections of its document a section shares a page that is there.

    Spans are spread over their pages and counted by page and section; a page's
    sections are never paired.
    """
    doc = ["repo_id", "doc_id"]
    there = pages.select(*doc, "page").distinct()
    end = F.greatest(F.coalesce("end_page", "page"), "page")
    own = spans.where("page IS NOT NULL").select(*doc, "section_id", F.explode(F.sequence("page", end)).alias("page")).distinct().join(there, [*doc, "page"], "left_semi")
    extent = own.groupBy(*doc, "section_id").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    starts = extent.groupBy(*doc, F.col("a").alias("at")).agg(F.count("*").alias("s")).withColumn("e", F.lit(0).cast("long"))
    ends = extent.groupBy(*doc, F.col("b").alias("at")).agg(F.count("*").alias("e")).withColumn("s", F.lit(0).cast("long"))
    steps = starts.unionByName(ends).groupBy(*doc, "at").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    w = Window.partitionBy(*doc).orderBy("at")
    sums = steps.select(*doc, "at", F.sum("s").over(w).alias("started"), (F.sum("e").over(w) - F.col("e")).alias("ended"))
    at_end = extent.join(sums.select(*doc, F.col("at").alias("b"), "started"), [*doc, "b"])
    both = at_end.join(sums.select(*doc, F.col("at").alias("a"), "ended"), [*doc, "a"])
    return both.select(*doc, "section_id", (F.col("started") - F.col("ended") - 1).alias("others"))


def uncovered_shingles(rows: DataFrame, size: int = 4) -> DataFrame:
    """``id, n, uncovered``: how many different runs of ``size`` words the condensed text has, and how many of them the full text lacks."""

    def runs(w: Column) -> Column:
        last = F.size(w) - size + 1
        return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")))).otherwise(F.array().cast("array<string>"))

    own = rows.select("id", words(F.coalesce("body_l2", F.lit(""))).alias("a"), words(F.coalesce("body_l3", F.lit(""))).alias("b"))
    made = own.select("id", runs(F.col("a")).alias("a"), runs(F.col("b")).alias("b")).where(F.size("a") > 0)
    return made.select("id", F.size("a").alias("n"), F.size(F.array_except("a", "b")).alias("uncovered"))


def uncovered(own: list[str], others: list[list[str]], size: int, least: int) -> Iterator[tuple[int, int]]:
    """Start and length of the longest runs of at least ``least`` words that no run of ``size`` words of the others covers.

    Where one side is shorter than that, single words cover.
    """
    n = size if len(own) >= size and sum(map(len, others)) >= size else 1
    known = {tuple(b[i : i + n]) for b in others for i in range(len(b) - n + 1)}
    end = 0
    for i in [*(i for i in range(len(own) - n + 1) if tuple(own[i : i + n]) in known), len(own)]:
        if i - end >= least:
            yield end, i - end
        end = max(end, i + n)


def uncovered_runs(rows: DataFrame, size: int = 4, least: int = 5) -> DataFrame:
    """``id, start, words, passage``: the longest runs of the condensed text's words, from position 0, that the full text doesn't cover.

    A word is covered if it stands in a run of ``size`` words that the full text has,
    or, where either text is shorter than that, if the full text has it. Runs of
    fewer than ``least`` words don't come out; with 1 all uncovered positions do.
    Every row is looked at where it lies: joined by runs, the words of all texts would be shuffled many times over.
    """
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("start int, words int, passage string")])
    id_type = to_arrow_type(schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, a, b in zip(*(batch.column(c).to_pylist() for c in ("id", "a", "b"))):
                out += [(key, start, n, " ".join(a[start : start + n])) for start, n in uncovered(a, [b], size, least)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (id_type, pa.int32(), pa.int32(), pa.string()))], names=schema.names)

    return rows.select("id", words(F.coalesce("body_l2", F.lit(""))).alias("a"), words(F.coalesce("body_l3", F.lit(""))).alias("b")).mapInArrow(run, schema)
