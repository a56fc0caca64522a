"""The problems' queries over the store's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.encoding import count_tokens, encode_texts
from quern.llm.lookalikes import canonical_texts, lookalike_classes, lookalike_pairs
from quern.llm.packing import pack
from quern.llm.reading import reading_bands
from quern.llm.scans import repair_scans, scan_noise
from quern.llm.splitting import split_oversized
from quern.llm.token_budget import token_budget
from quern.operators.snapshots import current_sections
from quern.sources import table

#: Characters of a piece, and of what it repeats of the piece before.
LIMIT, OVERLAP = 2000, 200
#: Tokens of a container.
CAPACITY = 2048


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized sections and how fine they have to be cut."""
    long = table(spark, sf_dir, "fts").select("id", "body_l3").where(F.char_length("body_l3") > LIMIT)
    cut = split_oversized(long, ["id"], "body_l3", LIMIT, OVERLAP).where("piece_no = 1").select("id", "cut")
    return current_sections(table(spark, sf_dir, "sections")).join(cut, "id").select("repo_id", "doc_id", "section_id", "cut").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every section of the last snapshot."""
    texts = table(spark, sf_dir, "fts").select("id", "body_l3").dropDuplicates(["id"])
    keys = ["repo_id", "doc_id", "section_id"]
    return split_oversized(current_sections(table(spark, sf_dir, "sections")).join(texts, "id"), keys, "body_l3", LIMIT, OVERLAP)


_SCAN_TABLES = ("sections", "fts", "pdf_pages", "page_furniture", "unit_spans")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scanning left in the sections' texts."""
    return scan_noise(*(table(spark, sf_dir, t) for t in _SCAN_TABLES))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections' texts, repaired."""
    return repair_scans(*(table(spark, sf_dir, t) for t in _SCAN_TABLES))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts that look the same without being the same."""
    return lookalike_pairs(table(spark, sf_dir, "fts"), "id", ["body_l2", "body_l3"])


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose text has a look-alike, with the class of all that look the same."""
    classes = lookalike_classes(table(spark, sf_dir, "fts"), "id", ["body_l2", "body_l3"])
    return classes.select("field", F.hex("class").alias("class"), F.hex("digest").alias("digest"), "id")


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one consistent form of every text."""
    return canonical_texts(table(spark, sf_dir, "fts"), "id", ["body_l2", "body_l3"])


def p4_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by document, repository, language and domain."""
    return token_budget(*(table(spark, sf_dir, t) for t in ("sections", "fts", "doc_tags")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every piece of one that is larger than a container."""
    sized = count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], {"tokens": "text"})
    return pack(sized, "doc_id", "tokens", CAPACITY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading band of every document with running prose."""
    return reading_bands(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_repaired, p3_found, p3_classes, p3_canonical, p4_budget, p6_ids, p7_containers, p8_found)}

_WHITE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LINE = r"(?:\r\n|\n|\r)"


def _fits(text: str, pattern: str) -> str:
    """Whether every part of a text, outer blanks not counted, is within the limit."""
    return f"list_max(list_transform(string_split_regex({text}, '{pattern}'), lambda x: length(regexp_replace(x, '^{_WHITE}|{_WHITE}$', '', 'g')))) <= {LIMIT}"


#: DuckDB SQL for those that it can express.
ORACLE: dict[str, str] = {
    "p1_found": f"""SELECT DISTINCT repo_id, doc_id, section_id, CASE WHEN {_fits('t', _LINE + '(?:[ \\t]*' + _LINE + ')+')} THEN 'block' WHEN {_fits('t', _LINE)} THEN 'line'
            WHEN {_fits(f"regexp_replace(t, '([.!?]){_WHITE}', '\\1' || chr(1), 'g')", '(?:' + _LINE + '|\\x01)')} THEN 'sentence' WHEN {_fits('t', _WHITE)} THEN 'word' ELSE 'char' END AS cut
        FROM (SELECT repo_id, doc_id, section_id, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, doc_id, section_id ORDER BY delivered_at DESC, id DESC) AS rn
            FROM sections WHERE snapshot_no = (SELECT max(snapshot_no) FROM sections)) WHERE rn = 1) JOIN (SELECT DISTINCT id, body_l3 AS t FROM fts WHERE length(body_l3) > {LIMIT}) USING (id)""",
}
