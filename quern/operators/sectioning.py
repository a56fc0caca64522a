"""From headings to sections: ids in headings, headings that are none, and headings that swallowed a line of text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.ordered import fill_forward


@dataclass(frozen=True)
class Headings:
    """How a document writes its headings: patterns of an identifier and a title, regardless of letter case."""

    #: The common English conventions.
    chapter: str = r"^chapter\s+(\d+)\s*[.:–—-]?\s*(.*)$"
    attachment: str = r"^attachment(?:\s*[.:–—-]\s*|\s+([0-9A-Za-z]+(?:\.[0-9A-Za-z]+)*)\s*[.:–—-]?\s*)(.*)$"
    appendix: str = r"^appendix(?:\s*[.:–—-]\s*|\s+([0-9A-Za-z]+(?:\.[0-9A-Za-z]+)*)\s*[.:–—-]?\s*)(.*)$"


#: Fixed value: a dotted number, with a title or without.
NUMBERED = r"^(\d+(?:\.\d+)*)(?:[.\s]+(.*?))?\s*$"
#: Captions, and labels of which two make a line one of labels; pages from which a heading is a running line.
CAPTION = r"(?i)^(table|figure|fig\.?|diagram|chart|exhibit)\s+[a-z]?\d"
LABEL = r"(?U)\b[\w/]+:\s"
LABELS, PAGES = 2, 3


def section_ids(text: Column, headings: Headings = Headings()) -> Column:
    """What a heading says: a struct of ``section_id`` and ``title``, or null where it has no id.

    The first kind that fits counts: chapter, attachment, appendix, dotted number. A
    number without a dot and a title is a page's; ``N.0`` is ``N``.
    """
    one = F.trim(F.regexp_replace(text, r"\s+", " "))

    def part(pattern: str, n: int) -> Column:
        return F.regexp_extract(one, f"(?i){pattern}", n)

    def made(section_id: Column, title: Column) -> Column:
        return F.struct(section_id.alias("section_id"), F.trim(title).alias("title"))

    def or_whole(title: Column) -> Column:
        return F.when(title != "", title).otherwise(one)

    clean = lambda c: F.regexp_replace(F.trim(c), r"\s+", "-")
    number, rest = part(NUMBERED, 1), F.trim(part(NUMBERED, 2))
    cases = F.when(one.rlike(f"(?i){headings.chapter}"), made(clean(part(headings.chapter, 1)), or_whole(part(headings.chapter, 2))))
    for kind, pattern in (("attachment", headings.attachment), ("appendix", headings.appendix)):
        own = F.lower(clean(part(pattern, 1)))
        cases = cases.when(one.rlike(f"(?i){pattern}"), made(F.when(own != "", F.concat(F.lit(f"{kind}-"), own)).otherwise(F.lit(kind)), or_whole(part(pattern, 2))))
    return cases.when(one.rlike(NUMBERED) & ((rest != "") | number.contains(".")), made(F.regexp_replace(number, r"^(\d+)\.0$", "$1"), rest))


def repeated_headings(items: DataFrame, by: list[str], order: str, page: str, text: str, headings: Headings = Headings()) -> DataFrame:
    """``by, heading, pages``: on how many pages each heading stands that has no id and doesn't end with a colon; an item without a page is on the one before.

    Counted over whole documents, a row for each heading and page at most.
    """
    paged = fill_forward(items, by, [F.col(order)], page, "_page").where("kind = 'heading'")
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    plain = paged.select(*by, "_page", one.alias("heading")).where(~F.col("heading").endswith(":") & section_ids(F.col("heading"), headings).isNull())
    return plain.distinct().groupBy(*by, "heading").agg(F.count("*").alias("pages"))


def noise_reason(heading: Column, pages: Column) -> Column:
    """Why a heading without an id is text and no section: ``caption``, ``label line`` or ``repeated``; null if it is one."""
    labels = F.size(F.regexp_extract_all(heading, F.lit(LABEL), F.lit(0)))
    return F.when(heading.rlike(CAPTION), "caption").when(labels >= LABELS, "label line").when(pages >= PAGES, "repeated")


def split_headings(rows: DataFrame, key: str, text: str, lines: str, furniture: str, ratio: float = 0.9) -> DataFrame:
    """``key, heading, body`` of the headings that hold lines of text besides their title.

    ``lines`` is an array of structs ``text, size``: the printed lines within the
    heading's box; ``furniture`` an array of the document's running lines. The title
    is what is printed nearly as large as the largest; addresses are never part of it.
    Running lines are left out, but for a first line of title size, which is then the
    title. A heading stays as it is, and doesn't come out, if the box holds other
    characters than it does, or nothing but its title. Each row is looked at where it lies.
    """
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL("heading string, body array<string>")])

    def words(line: str) -> tuple[str, ...]:
        return tuple(regex.findall(r"[\p{L}\p{N}]+", line.casefold()))

    def letters(line: str) -> list[str]:
        return sorted(c for c in line.casefold() if not c.isspace())

    def running(line: str, known: set[tuple[str, ...]]) -> bool:
        own = words(line)
        ends = [True] + [False] * len(own)
        for end in range(1, len(own) + 1):
            ends[end] = any(ends[end - len(f)] for f in known if len(f) <= end and own[end - len(f) : end] == f)
        return bool(own) and ends[-1]

    def split(title: str, printed: list[tuple[str, float]], known: set[tuple[str, ...]]) -> tuple[str, list[str]] | None:
        noise = [running(t, known) for t, _ in printed]
        address = [bool(regex.search(r"https?://|www\.", t)) for t, _ in printed]
        sizes = [s for (_, s), n, a in zip(printed, noise, address) if not n and not a]
        if len(printed) < 2 or not sizes:
            return None
        least = ratio * max(sizes)
        large_noise = [i for i, ((_, s), n) in enumerate(zip(printed, noise)) if n and s >= least]
        if large_noise and large_noise != [0]:
            return None
        if large_noise:
            least, noise[0] = max(least, ratio * printed[0][1]), False
        kept = [i for i, n in enumerate(noise) if not n]
        if letters(title) not in (letters("".join(t for t, _ in printed)), letters("".join(printed[i][0] for i in kept))):
            return None
        head = [i for i in kept if printed[i][1] >= least and not address[i]]
        body = [printed[i][0] for i in kept if i not in head]
        return (" ".join(printed[i][0] for i in head), body) if body or len(kept) < len(printed) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, found = [], []
            for i, (title, printed, known) in enumerate(zip(*(batch.column(c).to_pylist() for c in (text, lines, furniture)))):
                forms = {w for f in known or () if f and (w := words(f)) and not "".join(w).isdigit()}
                if made := split(title or "", [(x["text"], x["size"]) for x in printed or ()], forms):
                    keep.append(i)
                    found.append(made)
            heads, bodies = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(keep, pa.int64())), pa.array(heads, pa.string()), pa.array(bodies, pa.list_(pa.string()))], names=schema.names)

    return rows.select(key, text, lines, furniture).mapInArrow(run, schema)


def uncarried(items: DataFrame, units: DataFrame, by: list[str], item: str, text: str, body: str) -> DataFrame:
    """Items of which no unit of their document has the text, white space aside: ``by, item``.

    Items that are a whole line of a unit are found by equality; only the rest is looked
    for inside the units of the same document.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    own = items.select(*by, item, flat(F.col(text)).alias("_flat")).where("_flat <> ''")
    whole = units.select(*by, F.explode(F.split(body, r"\r\n|\n|\r")).alias("_l")).select(*by, flat(F.col("_l")).alias("_flat")).distinct()
    rest = own.join(whole, [*by, "_flat"], "left_anti")
    met = rest.join(units.select(*by, flat(F.col(body)).alias("_body")), by).where(F.contains("_body", "_flat")).select(*by, item).distinct()
    return rest.join(met, [*by, item], "left_anti").select(*by, item)
