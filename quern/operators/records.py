"""Small operators over records: set aggregates, coverage, merged schemas, facts by kind of id, replies, ages and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import route_shape
from quern.operators.markdown import SEPARATOR, lines_of

#: Fixed value: what a document's id looks like.
DOC_ID = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"
#: Fixed value: levels of a section's text.
LEVELS = ("l2", "l3")


def safe_doc_ids(df: DataFrame, column: str) -> DataFrame:
    """Rows whose document id is one and can't lead out of its folder."""
    return df.where(F.col(column).rlike(DOC_ID) & ~F.col(column).isin(".", ".."))


def level(value: str) -> str:
    """A level of text, whatever its letter case; anything else is an error."""
    if (own := value.strip().lower()) not in LEVELS:
        raise ValueError(f"{value!r} is no level of text; there are {', '.join(LEVELS)}")
    return own


def pending(sections: DataFrame, docs: DataFrame, headings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, missing)``: sections whose ``status`` is pending, of documents that aren't generated; those whose heading isn't there are missing.

    ``headings`` has ``repo_id, doc_id, section_id``.
    """
    key = ["repo_id", "doc_id", "section_id"]
    made = docs.where(F.array_contains("tags", "generated")).select("repo_id", "doc_id").distinct()
    own = sections.where(F.lower(F.trim("status")) == "pending").join(made, ["repo_id", "doc_id"], "left_anti")
    there = headings.select(*key).distinct()
    return own.join(there, key, "left_semi"), own.join(there, key, "left_anti")


def of_chapters(sections: DataFrame, chapters: list[str] | None) -> DataFrame:
    """Sections of the chosen chapters' files; of all without a choice."""
    return sections if not chapters else sections.where(F.col("file").isin(sorted(set(chapters))))


def set_aggregates(rows: DataFrame, by: list[str], name: str, alias: str, known: Column) -> DataFrame:
    """``by, unknown, known_as``: the different names that aren't known, sorted, and what each known one counts as."""
    unknown = F.array_sort(F.collect_set(F.when(~known, F.col(name))))
    pairs = F.array_sort(F.collect_set(F.when(known & F.col(alias).isNotNull(), F.struct(name, alias))))
    return rows.groupBy(*by).agg(unknown.alias("unknown"), F.map_from_entries(pairs).alias("known_as"))


def coverage_rows(found: DataFrame) -> DataFrame:
    """``area, scope, framework, status, sites``: how far each was scanned; any site makes it partial.

    ``found`` has ``area, scope, framework, status`` (``complete``, ``partial``, ``not scanned``) and ``site``, null or a place that wasn't understood.
    """
    rank = F.when(F.col("status") == "not scanned", 2).when((F.col("status") == "partial") | F.col("site").isNotNull(), 1).otherwise(0)
    sites = F.array_join(F.array_sort(F.collect_set("site")), ", ").alias("sites")
    rows = found.groupBy("area", "scope", "framework").agg(F.max(rank).alias("_rank"), sites)
    status = F.element_at(F.array(*map(F.lit, ("complete", "partial", "not scanned"))), F.col("_rank") + 1)
    return rows.select("area", "scope", "framework", status.alias("status"), "sites")


def by_first_tag(operations: DataFrame, tags: str = "tags", otherwise: str = "surface") -> DataFrame:
    """``tag, operations``: operations (``method, path``) under their first tag, in order of path and method."""
    own = F.coalesce(F.get(F.col(tags), F.lit(0)), F.lit(otherwise)).alias("tag")
    return operations.groupBy(own).agg(F.array_sort(F.collect_list(F.struct("path", "method"))).alias("operations"))


def merged_records(records: DataFrame, keys: list[str], reader: str, order: list[str], values: list[str]) -> DataFrame:
    """``keys, values, reader, differ``: of several readers' records of a thing that of the first in ``order``; ``differ`` lists the columns in which others disagree."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(reader))
    rank = F.when(place > 0, place).otherwise(len(order) + 1)
    best = F.min(F.struct(rank.alias("_rank"), F.col(reader).alias("_reader"), *values)).alias("_best")
    differ = [F.when(F.count_distinct(F.coalesce(F.col(v).cast("string"), F.lit(""))) > 1, F.lit(v)) for v in values]
    rows = records.groupBy(*keys).agg(best, F.array_compact(F.array(*differ)).alias("differ"))
    return rows.select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values], F.col("_best._reader").alias(reader), "differ")


def merged_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, facts``: all different facts of repeated sections under one key, sorted."""
    return facts.groupBy(*keys).agg(F.array_sort(F.collect_set("fact")).alias("facts"))


def named_columns(text: Column, names: list[str]) -> Column:
    """The data rows of a text's table as arrays of the named columns' cells, found by the header whatever its letter case; none if one is missing."""
    rows = F.filter(F.transform(lines_of(text), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(SEPARATOR))
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit(r"\|"), F.lit("|")))))
    head = F.transform(F.get(cells, F.lit(0)), lambda c: F.lower(c))
    places = [F.array_position(head, F.lit(n.lower())).cast("int") for n in names]
    there = F.lit(True)
    for p in places:
        there = there & (p > 0)
    wanted = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda r: F.array(*[F.coalesce(F.get(r, p - 1), F.lit("")) for p in places]))
    return F.when(there, wanted).otherwise(F.array().cast("array<array<string>>"))


def section_facts(rows: DataFrame, section: str, l2: str, l3: str) -> DataFrame:
    """``*, kind, value`` of code sections, read by the kind their id begins with; other ids have no facts.

    ``db.`` columns, their types and keys; ``api.`` and ``route.`` routes; ``page.``
    paths; ``job.`` names with their schedule; ``int.`` keys; ``cmd.`` the primary
    command; ``dep.`` frameworks; ``svc.`` and ``flow.`` the text itself, as its digest.
    """
    fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    table = lambda *names: named_columns(F.col(l2), list(names))
    columns = F.flatten(F.transform(table("Column", "Type", "PK"), lambda r: F.array(fact("column", r[0]), fact("column_type", F.concat_ws(":", r[0], r[1])), fact("pk", F.when(F.lower(r[2]) == "yes", r[0])))))
    routes = lambda method, path: F.transform(table("Method", "Path"), lambda r: fact("route", F.concat_ws(" ", method(r[0]), path(r[1]))))
    one = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(l3, F.lit("")), r"(?m)^> Generated.*$", ""), r"\s+", " "))
    listed = F.split(F.regexp_extract(l2, r"(?im)^\**frameworks?\**:\**[ \t]*(.+)$", 1), r"\s*,\s*")
    by_prefix = {
        "db.": columns,
        "api.": routes(lambda m: m, lambda p: p),
        "route.": routes(F.upper, route_shape),
        "page.": F.transform(table("Path"), lambda r: fact("page", route_shape(r[0]))),
        "job.": F.transform(table("Name", "Schedule"), lambda r: fact("job", F.concat_ws(" @ ", r[0], r[1]))),
        "int.": F.transform(table("Env key"), lambda r: fact("env_key", r[0])),
        "cmd.": F.array(fact("command", F.regexp_extract(l2, r"(?im)^\**primary\**:\**[ \t]*`?([^`\n]+?)`?[ \t]*$", 1))),
        "dep.": F.transform(listed, lambda x: fact("framework", F.trim(x))),
        "svc.": F.array(fact("text", F.sha2(one, 256))),
        "flow.": F.array(fact("text", F.sha2(one, 256))),
    }
    found = F.array().cast("array<struct<kind:string,value:string>>")
    for prefix, facts in by_prefix.items():
        found = F.when(F.col(section).startswith(prefix), facts).otherwise(found)
    each = rows.withColumn("_facts", F.array_distinct(F.filter(found, lambda f: f["value"].isNotNull() & (f["value"] != ""))))
    return each.select(*rows.columns, F.explode("_facts").alias("_f")).select(*rows.columns, "_f.kind", "_f.value")


def json_reply(text: Column, required: list[str]) -> Column:
    """The first JSON object of a reply that has all the required texts, as a map of them; null if none has.

    Objects may stand in prose or in a fence, one level deep.
    """
    objects = F.regexp_extract_all(text, F.lit(r"(\{(?:[^{}\"]|\"(?:[^\"\\]|\\.)*\")*\})"), F.lit(1))
    read = F.transform(objects, lambda o: F.from_json(o, "map<string,string>"))
    whole = F.filter(read, lambda m: m.isNotNull() & F.forall(F.array(*map(F.lit, required)), lambda k: F.element_at(m, k).isNotNull()))
    return F.map_filter(F.get(whole, F.lit(0)), lambda k, v: k.isin(*required))


def age_label(seconds: Column) -> Column:
    """An age as ``~Ns``, or ``unknown``."""
    return F.when(seconds.isNull(), F.lit("unknown")).otherwise(F.format_string("~%ds", seconds.cast("long")))


def in_cell(marks: DataFrame, rows: DataFrame, columns: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``row`` and ``col``: the table cell that holds the middle of a box; boxes outside any don't come out.

    ``marks`` has ``x0, y0, x1, y1``; ``rows`` bands ``row, top, bottom``; ``columns`` bands ``col, left, right``.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    bands = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("row", "top", "bottom"))).alias("_rows")).join(columns.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("col", "left", "right"))).alias("_cols")), by)
    met = marks.join(bands, by)
    row = F.get(F.filter("_rows", lambda r: (r["top"] <= y) & (y < r["bottom"])), F.lit(0))["row"]
    col = F.get(F.filter("_cols", lambda c: (c["left"] <= x) & (x < c["right"])), F.lit(0))["col"]
    return met.withColumns({"row": row, "col": col}).where("row IS NOT NULL AND col IS NOT NULL").drop("_rows", "_cols")


def digest_issues(recorded: DataFrame, live: DataFrame, docs: DataFrame) -> DataFrame:
    """``code, subject``: repositories whose recorded digest isn't the live one (``digest``), without a live one (``gone``) or a record (``unrecorded``), and document ids of several repositories (``doc-id``)."""
    a, b = recorded.select("repo_id", F.col("digest").alias("_a")), live.select("repo_id", F.col("digest").alias("_b"))
    code = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "unrecorded").when(F.col("_a") != F.col("_b"), "digest")
    odd = a.join(b, "repo_id", "full_outer").select(code.alias("code"), F.col("repo_id").alias("subject")).where("code IS NOT NULL")
    twice = docs.select("doc_id", "repo_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("doc-id").alias("code"), F.col("doc_id").alias("subject"))
    return odd.unionByName(twice)


def finding_order(columns: list[str]) -> list[Column]:
    """Findings in one order at all times: by each column as text, nulls first."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]


def table_differences(rows: DataFrame, condensed: DataFrame, full: DataFrame) -> DataFrame:
    """``id, code, n``: tables that the condensed text has and the full one lacks (``extra``), or the reverse (``missing``), by how many, and ``reordered`` where both have the same in another order.

    ``condensed`` and ``full`` are tables of ``operators.markdown.tables``. A full text without tables is never compared.
    """
    line = F.array_join("rows", "\n")
    a, b = (df.select("id", "at", line.alias("t")) for df in (condensed, full))
    compared = b.select("id").distinct()
    bags = a.select("id", "t", F.lit(1).alias("n")).unionByName(b.select("id", "t", F.lit(-1).alias("n"))).groupBy("id", "t").agg(F.sum("n").alias("n")).where("n <> 0").join(compared, "id", "left_semi")
    code = F.when(F.col("n") > 0, "extra").otherwise("missing")
    differ = bags.groupBy("id", code.alias("code")).agg(F.sum(F.abs("n")).alias("n"))
    in_order = lambda df: df.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]).alias("o"))
    both = in_order(a).alias("a").join(in_order(b).alias("b"), "id").where("a.o <> b.o").select("id").join(differ.select("id"), "id", "left_anti")
    return differ.unionByName(both.select("id", F.lit("reordered").alias("code"), F.lit(1).cast("long").alias("n"))).join(rows.select("id").distinct(), "id", "left_semi")
