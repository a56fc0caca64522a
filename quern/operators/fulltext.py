"""Whether a section's full text holds what its pages hold: lost and added passages, broken paragraphs, order, and pages without text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.functions.text import nfkc_casefold, slug_id
from quern.operators.markdown import lines_of
from quern.operators.quality import uncovered

#: Fixed values of the checks: words of a shared run, of a reported one, of evidence, and of each side of a break.
SHINGLE, RUN, EVIDENCE, JOIN = 4, 5, 25, 4
#: Fixed value: signs that end a paragraph on purpose.
TERMINAL = ".!?:;…)\"”’]"

_SECTION = ["repo_id", "doc_id", "section_id"]


def normal_words(text: Column) -> Column:
    """Words by compatibility and case, those broken by a hyphen at a line's end whole again; null has none."""
    whole = F.regexp_replace(nfkc_casefold(F.coalesce(text, F.lit(""))), r"([\p{L}\p{N}_])-[^\S\n]*\n\s*([\p{L}\p{N}_])", "$1$2")
    return F.regexp_extract_all(whole, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def without_marks(text: Column) -> Column:
    """Markdown without its signs: fence lines, separator rows, heading marks, addresses of images and links, emphasis and bars."""
    bare = F.coalesce(text, F.lit(""))
    for pattern, kept in (
        (r"(?m)^[ \t]*(?:```|~~~).*$", ""), (r"(?m)^[ \t]*\|?[ \t]*:?-+:?[ \t:|-]*$", ""), (r"(?m)^[ \t]*#{1,6}[ \t]+", ""),
        (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*+|(?<![\p{L}\p{N}_])_+|_+(?![\p{L}\p{N}_])", ""), (r"\|", " "),
    ):
        bare = F.regexp_replace(bare, pattern, kept)
    return bare


def _spaced(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def run_at(words: Column, needle: Column, start: Column | None = None) -> Column:
    """The first place from 0 at which ``needle`` stands in ``words`` as neighbours, not before ``start``; -1 if nowhere."""
    begin = F.lit(0) if start is None else start
    text = _spaced(F.slice(words, begin + 1, F.size(words)))
    found = F.call_function("instr", text, _spaced(needle))
    before = F.substring(text, F.lit(1), found - 1)
    place = begin + F.char_length(before) - F.char_length(F.replace(before, F.lit(" "), F.lit("")))
    return F.when((F.size(needle) > 0) & (found > 0), place).otherwise(-1)


def without_furniture(words: Column, lines: Column) -> Column:
    """A page's words without the first place of each of its running lines, given as lists of words, one after the other."""

    def step(text: Column, line: Column) -> Column:
        at = F.call_function("instr", text, _spaced(line))
        rest = F.substring(text, at + F.char_length(_spaced(line)) - 1, F.char_length(text))
        return F.when((F.size(line) > 0) & (at > 0), F.concat(F.substring(text, F.lit(1), at - 1), rest)).otherwise(text)

    left = F.aggregate(lines, _spaced(words), step)
    return F.filter(F.split(left, " "), lambda w: w != "")


def page_streams(pages: DataFrame, furniture: DataFrame) -> DataFrame:
    """``repo_id, doc_id, page, words, start``: each page's words without its running lines, and how many stand on the pages before."""
    key = ["repo_id", "doc_id", "page"]
    text = pages.where("page IS NOT NULL").groupBy(*key).agg(F.max(F.coalesce("page_text", F.lit(""))).alias("page_text"))
    lines = furniture.where("line_text IS NOT NULL").select(*key, "line_text").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("line_text")).alias("_lines"))
    joined = text.join(lines, key, "left").select(*key, "page_text", normal_words(F.col("page_text")).alias("_words"), F.coalesce("_lines", F.array().cast("array<string>")).alias("_lines"))
    named = joined.select(*key, "page_text", "_words", F.posexplode_outer("_lines").alias("_n", "_line")).withColumn("_line", normal_words(F.col("_line")))
    whole = named.groupBy(*key).agg(F.first("page_text").alias("page_text"), F.first("_words").alias("_words"), F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_lines"))
    words = whole.select(*key, "page_text", without_furniture(F.col("_words"), F.transform("_lines", lambda x: x["_line"])).alias("words"))
    before = F.sum(F.size("words")).over(Window.partitionBy("repo_id", "doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("start", F.coalesce(before, F.lit(0)).cast("int"))


def _on_pages(sections: DataFrame, streams: DataFrame) -> DataFrame:
    """Sections by the pages of their span that are there. A section without an end has one page."""
    end = F.greatest(F.coalesce("end_page", "page"), "page")
    each = sections.where("page IS NOT NULL").select(*_SECTION, F.explode(F.sequence("page", end)).alias("page"))
    return each.join(streams, ["repo_id", "doc_id", "page"])


def unverifiable(sections: DataFrame, streams: DataFrame) -> DataFrame:
    """Sections on whose pages there is no text at all: ``repo_id, doc_id, section_id, page``."""
    seen = _on_pages(sections, streams).groupBy(*_SECTION).agg(F.max(F.trim(F.regexp_replace("page_text", r"\s+", " ")) != "").alias("_text"))
    return seen.where("NOT _text").join(sections.select(*_SECTION, "page"), _SECTION).select(*_SECTION, "page")


def title_places(sections: DataFrame, streams: DataFrame) -> DataFrame:
    """``repo_id, doc_id, section_id, place``: where each title of two words or more stands among its document's words, on the pages of its section."""
    held = F.array_sort(F.collect_list(F.struct("page", "start", "words")))
    spans = _on_pages(sections, streams).groupBy(*_SECTION).agg(held.alias("p"))
    named = sections.select(*_SECTION, normal_words(F.col("title")).alias("_title")).where(F.size("_title") > 1)
    at = run_at(F.flatten(F.transform("p", lambda x: x["words"])), F.col("_title"))
    return spans.join(named, _SECTION).select(*_SECTION, (F.get("p", F.lit(0))["start"] + at).alias("place"), at.alias("_at")).where("_at >= 0").drop("_at")


def content_findings(sections: DataFrame, streams: DataFrame) -> DataFrame:
    """``repo_id, doc_id, section_id, side, page, evidence``: passages of five words or more that only the pages or only the text has.

    ``sections`` has a span, ``ord``, ``title`` and ``l3``. A passage of the pages counts
    as there if any section that shares one of these pages has it. What several sections
    miss belongs to the last of them whose title stands before it, else to the first.
    Pages are words in a row, so no passage is cut at a page's end.
    """
    met = _on_pages(sections, streams)
    words = sections.select(*_SECTION, normal_words(without_marks(F.col("l3"))).alias("own"))
    key = ["repo_id", "doc_id", "page"]
    other = met.select(*key, F.col("section_id").alias("_other"))
    near = met.select(*_SECTION, "page").join(other, key).where("section_id <> _other").select(*_SECTION, "_other").distinct()
    beside = near.join(words.select("repo_id", "doc_id", F.col("section_id").alias("_other"), F.col("own").alias("_words")), ["repo_id", "doc_id", "_other"])
    # other sections' words stand apart, so that no run goes from one into the next
    beside = beside.groupBy(*_SECTION).agg(F.collect_list("_words").alias("beside"))
    held = met.groupBy(*_SECTION).agg(F.array_sort(F.collect_list(F.struct("page", "start", "words"))).alias("pages"))
    rows = held.join(words, _SECTION).join(beside, _SECTION, "left").join(sections.select(*_SECTION, F.col("page").alias("first_page")), _SECTION)
    schema = T.StructType([*(sections.schema[c] for c in _SECTION), *T.StructType.fromDDL("side string, page int, evidence string, place int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_SECTION, "pages", "own", "beside", "first_page"]
        for batch in batches:
            out = []
            for repo, doc, section, pages, own, others, first in zip(*(batch.column(c).to_pylist() for c in names)):
                stream = [(w, p["page"], p["start"] + i) for p in pages for i, w in enumerate(p["words"])]
                there = [w for w, _, _ in stream]
                for at, n in uncovered(there, [own, *(others or [])], SHINGLE, RUN):
                    out.append((repo, doc, section, "pdf", stream[at][1], " ".join(there[at : at + min(n, EVIDENCE)]), stream[at][2]))
                for at, n in uncovered(own, [there], SHINGLE, RUN):
                    out.append((repo, doc, section, "l3", first, " ".join(own[at : at + min(n, EVIDENCE)]), None))
            columns = list(zip(*out)) or [()] * 7
            kinds = [batch.column(c).type for c in _SECTION] + [pa.string(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=schema.names)

    found = rows.mapInArrow(run, schema).join(title_places(sections, streams).withColumnRenamed("place", "_title"), _SECTION, "left").join(sections.select(*_SECTION, "ord"), _SECTION)
    gap = Window.partitionBy("repo_id", "doc_id", "side", "page", "evidence")
    first_place = F.min_by("place", F.when(F.col("place").isNotNull(), F.col("ord"))).over(gap)
    before = F.when(F.col("_title") <= first_place, F.struct("_title", "ord"))
    owner = F.coalesce(F.max(before).over(gap)["ord"], F.min("ord").over(gap))
    return found.withColumn("_owner", owner).where("ord = _owner").select(*_SECTION, "side", "page", "evidence").distinct()


def prose_blocks(text: Column) -> Column:
    """Paragraphs of nothing but prose, in order, with null where anything else stands between them."""
    lines = lines_of(F.coalesce(text, F.lit("")))
    fence = r"^[ \t]*(```|~~~)"
    begun = F.struct(F.lit(False).alias("fenced"), F.lit("").alias("open"), F.array().cast("array<string>").alias("blocks"))

    def step(state: Column, line: Column) -> Column:
        mark = line.rlike(fence)
        other = state["fenced"] | mark | line.rlike(r"^[ \t]*(#|\||!\[|[-*+][ \t]|\d+[.)][ \t])")
        blank = F.trim(line) == ""
        closed = F.when(state["open"] != "", F.concat(state["blocks"], F.array(state["open"]))).otherwise(state["blocks"])
        blocks = F.when(other, F.concat(closed, F.array(F.lit(None).cast("string")))).when(blank, closed).otherwise(state["blocks"])
        grown = F.when(other | blank, F.lit("")).when(state["open"] == "", F.trim(line)).otherwise(F.concat(state["open"], F.lit("\n"), F.trim(line)))
        return F.struct((state["fenced"] != mark).alias("fenced"), grown.alias("open"), blocks.alias("blocks"))

    return F.aggregate(lines, begun, step, lambda s: F.when(s["open"] != "", F.concat(s["blocks"], F.array(s["open"]))).otherwise(s["blocks"]))


def break_findings(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """``repo_id, doc_id, section_id, at, page, tail, head``: paragraphs that break off in mid-sentence where the pages run on.

    The last words of one paragraph of prose and the first of the next must stand side
    by side on the section's pages; ``page`` is that of the last word before the break.
    """
    text = pages.where("page IS NOT NULL").groupBy("repo_id", "doc_id", "page").agg(F.max(F.coalesce("page_text", F.lit(""))).alias("page_text"))
    met = _on_pages(sections, text.withColumn("words", normal_words(F.col("page_text"))))
    held = met.groupBy(*_SECTION).agg(F.array_sort(F.collect_list(F.struct("page", "words"))).alias("p"))
    blocks = sections.select(*_SECTION, prose_blocks(F.col("l3")).alias("b")).where(F.size("b") > 1)
    each = blocks.select(*_SECTION, "b", F.posexplode(F.slice("b", F.lit(2), F.size("b") - 1)).alias("at", "second")).withColumn("first", F.get("b", F.col("at"))).where("first IS NOT NULL AND second IS NOT NULL")
    ends = F.right(F.rtrim(without_marks(F.col("first"))), F.lit(1))
    open_ = each.where((ends != "") & (F.instr(F.lit(TERMINAL), ends) == 0))
    a, b = normal_words(without_marks(F.col("first"))), normal_words(without_marks(F.col("second")))
    sides = open_.select(*_SECTION, "at", F.slice(a, F.greatest(F.size(a) - JOIN + 1, F.lit(1)), F.lit(JOIN)).alias("tail"), F.slice(b, F.lit(1), F.lit(JOIN)).alias("head")).where((F.size("tail") > 1) & (F.size("head") > 1))
    placed = sides.join(held, _SECTION).withColumn("_run", run_at(F.flatten(F.transform("p", lambda x: x["words"])), F.concat("tail", "head"))).where("_run >= 0")
    of_words = F.flatten(F.transform("p", lambda x: F.array_repeat(x["page"], F.size(x["words"]))))
    page = F.get(of_words, F.col("_run") + F.size("tail") - 1)
    return placed.select(*_SECTION, "at", page.alias("page"), F.array_join("tail", " ").alias("tail"), F.array_join("head", " ").alias("head"))


def order_findings(sections: DataFrame, streams: DataFrame) -> DataFrame:
    """``repo_id, doc_id, section_id, page, other``: sections that begin before the one they follow, by page or by the place of their titles."""
    w = Window.partitionBy("repo_id", "doc_id").orderBy("ord")
    paged = sections.where("page IS NOT NULL").withColumns({"_page": F.lag("page").over(w), "other": F.lag("section_id").over(w)})
    by_page = paged.where("page < _page").select(*_SECTION, "page", "other")
    placed = title_places(sections, streams).join(sections.select(*_SECTION, "ord", "page"), _SECTION).withColumns({"_place": F.lag("place").over(w), "other": F.lag("section_id").over(w)})
    return by_page.unionByName(placed.where("place < _place").select(*_SECTION, "page", "other")).distinct()


def made_up_id(section_id: Column, title: Column) -> Column:
    """Whether an id was made up for a heading without a number: its title's slug, or ``x`` and a number, under a parent or repeated.

    Appendices and attachments may have such numbers themselves.
    """
    slug = slug_id(title)
    numbered = section_id.rlike(r"^(.+-)?x\d+(-\d+)?$") & ~section_id.rlike(r"^(appendix|attachment)-x\d+(-\d+)?$")
    bare = F.regexp_replace(section_id, r"-\d+$", "")
    under = lambda sid: (sid == slug) | F.endswith(sid, F.concat(F.lit("-"), slug))
    return numbered | ((F.replace(slug, F.lit("-"), F.lit("")).rlike(r"\P{N}")) & (under(section_id) | under(bare)))


def fallback_findings(sections: DataFrame) -> DataFrame:
    """``repo_id, doc_id, section_id, page, heading``: sections with a made-up id though their heading's first word has a digit."""
    odd = made_up_id(F.col("section_id"), F.col("title")) & F.regexp_extract(F.trim("title"), r"^(\S+)", 1).rlike(r"\p{N}")
    return sections.where(odd).select(*_SECTION, "page", F.col("title").alias("heading"))


def check_documents(sections: DataFrame, pages: DataFrame, furniture: DataFrame) -> DataFrame:
    """All findings: ``repo_id, doc_id, section_id, kind, page, evidence``. A section whose pages have no text has no content or break findings."""
    streams = page_streams(pages, furniture)
    blank = unverifiable(sections, streams)
    readable = sections.join(blank.select(*_SECTION), _SECTION, "left_anti")
    parts = [
        (blank, "unverifiable", F.lit("")),
        (content_findings(readable, streams), "content", F.concat_ws(": ", "side", "evidence")),
        (break_findings(readable, pages), "break", F.concat_ws(" / ", "tail", "head")),
        (order_findings(sections, streams), "order", F.col("other")),
        (fallback_findings(sections), "fallback", F.col("heading")),
    ]
    out = None
    for found, kind, evidence in parts:
        part = found.select(*_SECTION, F.lit(kind).alias("kind"), "page", evidence.alias("evidence"))
        out = part if out is None else out.unionByName(part)
    return out


def outline_gaps(sections: DataFrame, outline: DataFrame, depth: int = 2) -> DataFrame:
    """``repo_id, doc_id, section_id, gap``: ids of the outline that no section has (``missing``), and numbered sections it lacks (``extra``), down to a depth."""
    shallow = F.size(F.split("section_id", r"\.")) <= depth
    own, wanted = sections.where(shallow & F.col("section_id").rlike(r"^\d")).select(*_SECTION).distinct(), outline.where(shallow).select(*_SECTION).distinct()
    scoped = own.join(outline.select("repo_id", "doc_id").distinct(), ["repo_id", "doc_id"], "left_semi")
    missing = wanted.join(sections.select(*_SECTION), _SECTION, "left_anti").withColumn("gap", F.lit("missing"))
    return missing.unionByName(scoped.join(wanted, _SECTION, "left_anti").withColumn("gap", F.lit("extra")))
