"""Markdown as rows: lines, units, tables, headings and prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fenced code: from a line of three or more of a marker to one of as many, or to the end.
FENCED = r"(?s)(?:^|(?<=[\r\n]))[ \t]*((`|~)\2{2,}).*?(?:(?<=[\r\n])[ \t]*\1\2*[^\r\n]*|\z)"
#: Fixed value: how a unit's heading is written.
HEADING = r"^## (\S+)(?:[ \t]+(.*?))?[ \t]*$"
#: Fixed value: a row that only separates a table's header from its body.
SEPARATOR = r"^\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?$"


def lines_of(text: Column) -> Column:
    """The lines of a text without their ends."""
    return F.split(text, r"\r\n|\n|\r")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, at, line``: every line with its place from 0."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(lines_of(F.col(text))).alias("at", "line"))


def units(df: DataFrame, key: str, text: str, level: int = 2) -> DataFrame:
    """``key, at, section_id, title, occurrence, body``: units from one ``## id title`` line to the next of its level or above.

    Fences don't matter. Units whose heading has no id, and what stands before the
    first, are left out; ``occurrence`` counts units of the same id from 0. Splits
    inside each text, without a sort. With level 3 units are those of ``### id title`` lines.
    """
    mark = "#" * level
    all_lines = lines_of(F.col(text))
    bounds = F.filter(F.transform(F.col("_l"), lambda x, i: F.when(x.rlike(f"^#{{2,{level}}} "), i)), lambda i: i.isNotNull())
    cut = df.where(F.col(text).isNotNull()).select(key, all_lines.alias("_l")).select(key, "_l", bounds.alias("_s")).where(F.size("_s") > 0)
    each = cut.select(key, "_l", "_s", F.posexplode("_s").alias("_n", "_from"))
    until = F.when(F.col("_n") + 1 < F.size("_s"), F.get("_s", F.col("_n") + 1)).otherwise(F.size("_l"))
    head = F.get("_l", F.col("_from"))
    pattern = HEADING.replace("## ", f"{mark} ", 1)
    found = each.where(head.startswith(f"{mark} ")).select(
        key,
        F.col("_n").alias("at"),
        F.regexp_extract(head, pattern, 1).alias("section_id"),
        F.trim(F.coalesce(F.regexp_extract(head, pattern, 2), F.lit(""))).alias("title"),
        F.regexp_replace(F.array_join(F.slice("_l", F.col("_from") + 1, until - F.col("_from")), "\n"), r"^\s+|\s+$", "").alias("body"),
    ).where("section_id <> ''")
    again = F.row_number().over(Window.partitionBy(key, "section_id").orderBy("at")) - 1
    return found.select(key, "at", "section_id", "title", again.alias("occurrence"), "body")


def slices(df: DataFrame, key: str, text: str, asked: DataFrame) -> DataFrame:
    """``asked`` (``key, section_id, occurrence``) with ``body``: that unit of the text, else the first sub-unit of the id, else null."""
    whole = units(df, key, text).select(key, "section_id", "occurrence", F.col("body").alias("_unit"))
    inner = units(df, key, text, 3).where("occurrence = 0").select(key, "section_id", F.lit(0).alias("occurrence"), F.col("body").alias("_inner"))
    on = [key, "section_id", "occurrence"]
    met = asked.join(whole, on, "left").join(inner, on, "left")
    return met.select(*asked.columns, F.coalesce("_unit", "_inner").alias("body"))


def outside_fences(text: Column) -> Column:
    """The lines of a text outside fenced code, with their places: ``array<struct<at, line>>``.

    A fence reaches to a marker of its kind that is no shorter, or to the end of the
    text. The text is cut at its fences; each part's first line stands where the fence
    before it ends.
    """
    parts = F.split(text, FENCED)
    heights = F.transform(F.regexp_extract_all(text, F.lit(FENCED), F.lit(0)), lambda fence: F.size(lines_of(fence)) - 1)
    last = F.size(parts) - 1
    begun = F.struct(F.lit(0).alias("part"), F.lit(0).alias("at"), F.array().cast("array<struct<at:int,line:string>>").alias("found"))

    def step(state: Column, part: Column) -> Column:
        own = lines_of(part)
        first = F.when(state["part"] > 0, 1).otherwise(0)
        many = F.size(own) - first - F.when(state["part"] < last, 1).otherwise(0)
        placed = F.transform(own, lambda x, i: F.struct((state["at"] + i).alias("at"), x.alias("line")))
        kept = F.slice(placed, first + 1, F.greatest(many, F.lit(0)))
        after = state["at"] + F.size(own) - 1 + F.coalesce(F.get(heights, state["part"]), F.lit(0))
        return F.struct((state["part"] + 1).alias("part"), after.alias("at"), F.concat(state["found"], kept).alias("found"))

    return F.aggregate(parts, begun, step)["found"]


def unfenced_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, at, line`` of the lines outside fenced code; an open fence hides all that follows. Null texts have none."""
    return df.where(F.col(text).isNotNull()).select(key, F.explode(outside_fences(F.col(text))).alias("l")).select(key, "l.at", "l.line")


def table_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, at, col, cell``: the cells of table rows outside fences, without separator rows.

    ``\\|`` is part of a cell; white space within a cell is one blank.
    """
    row = F.trim("line")
    rows = unfenced_lines(df, key, text).where(row.startswith("|") & ~row.rlike(SEPARATOR)).select(key, "at", F.regexp_replace(row, r"^\||(?<!\\)\|$", "").alias("row"))
    cells = F.posexplode(F.split("row", r"(?<!\\)\|")).alias("col", "cell")
    return rows.select(key, "at", cells).withColumn("cell", F.regexp_replace(F.regexp_replace(F.trim("cell"), r"\\\|", "|"), r"\s+", " "))


def tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, at, rows``: the tables outside fences, each with its first line's place and its normalised rows.

    A table is a run of lines that begin with ``|``; rows that only separate are left out.
    """
    found = F.filter(outside_fences(F.col(text)), lambda x: F.ltrim(x["line"]).startswith("|"))
    each = df.where(F.col(text).isNotNull()).select(key, F.posexplode(found).alias("_n", "_l"))
    run = each.select(key, (F.col("_l.at") - F.col("_n")).alias("_run"), "_l")
    held = run.groupBy(key, "_run").agg(F.array_sort(F.collect_list("_l")).alias("_l"))
    return held.select(key, F.get("_l", F.lit(0))["at"].alias("at"), _normal_rows(F.transform("_l", lambda x: x["line"])).alias("rows"))


def table_rows(text: Column) -> Column:
    """The rows of all tables of a text outside fences as normalised strings: cells trimmed, joined by ``|``."""
    return _normal_rows(F.filter(F.transform(outside_fences(text), lambda x: x["line"]), lambda x: F.ltrim(x).startswith("|")))


def _normal_rows(rows: Column) -> Column:
    kept = F.filter(F.transform(rows, lambda x: F.trim(x)), lambda x: ~x.rlike(SEPARATOR))
    cells = F.transform(kept, lambda x: F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"))
    return F.transform(cells, lambda c: F.array_join(F.transform(c, lambda x: F.regexp_replace(F.trim(x), r"\s+", " ")), "|"))


#: Fixed value: lines that are no prose: tables, headings, comments, captions of figures, tables left out, and images.
NO_PROSE = r"^(\||#|<!--|Figure: |\[table omitted\]$|!\[[^\]]*\]\([^)]*\)$)"


def prose(text: Column) -> Column:
    """The prose lines of a text: no tables, headings, comments, captions or images; blank runs are one blank line."""
    kept = F.filter(
        F.transform(lines_of(F.coalesce(text, F.lit(""))), lambda x: F.regexp_replace(x, r"\s+$", "")),
        lambda x: ~F.regexp_replace(x, r"^\s+", "").rlike(NO_PROSE),
    )
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def image_texts(text: Column) -> Column:
    """The alternative texts of images outside tables, each once, in order."""
    outside = F.filter(lines_of(text), lambda x: ~F.ltrim(x).startswith("|"))
    found = F.flatten(F.transform(outside, lambda x: F.regexp_extract_all(x, F.lit(r"!\[([^\]]*)\]\([^)]*\)"), F.lit(1))))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))
