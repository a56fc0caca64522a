"""One consistent form for texts that look the same but differ in their characters.

Rows are first put into blocks by a hash that all texts of one look share, so that
only blocks with more than one spelling are looked at further, and exact copies are
one row each by then. Within the blocks, look-alikes are mapped and the texts are
grouped under the accent- and case-sensitive Unicode collation in SQL; the least
member of each class, in ordinary characters, is its canonical text, and is joined back.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import materialise, spread

#: Letters of other scripts that look like Latin ones, and the Latin ones.
LETTERS = (
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονμΩ",
    "ABESIJKMHOPCTYXaesijopcyxhdqw" + "ABEZHIKMNOPTYXovµΩ",
)
#: Letters printed as one sign.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: White space that looks like a blank, hyphens that look like the ordinary one, and signs that can't be seen.
BLANKS = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
HYPHENS = [0x2010, 0x2011]
UNSEEN = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]


def _letters() -> dict[int, str]:
    """Code points -> what they look like. Full-width forms lie a fixed step above the ordinary ones."""
    table = {ord(a): unicodedata.normalize("NFC", b) for a, b in zip(*LETTERS)}
    table |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}
    table |= {ord(a): b for a, b in LIGATURES.items()}
    table |= dict.fromkeys(BLANKS, " ") | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(UNSEEN, "")
    return table


_SEEN_AS = str.maketrans(_letters())
#: The same without accents: coarser than any difference that can't be seen.
_COARSE = _SEEN_AS | dict.fromkeys(range(0x300, 0x370), "")


def look(text: str) -> str:
    """The text with every look-alike replaced by the ordinary character, composed, with LF line ends."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_SEEN_AS))


def _block(text: str) -> int:
    """Equal for texts that look the same; few others share it."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFD", text).translate(_COARSE)
        text = unicodedata.normalize("NFD", text) if not text.isascii() else text
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@F.pandas_udf(T.LongType())
def block_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _block(t)).astype("Int64")


@F.pandas_udf(T.StringType())
def look_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else look(t))


def _long(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, field, text``, a row for each field that has text."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return spread(df.select(key, *fields)).select(F.col(key), F.explode(entries).alias("e")).select(F.col(key).alias("_key"), "e.*").where(F.length("text") > 0)


def _digest(text: Column) -> Column:
    """128 bits that stand for the very code points of a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def spellings(df: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(members, classes)`` of the texts that have a look-alike.

    ``members``: ``_key, field, digest`` of the rows in blocks with more than one
    spelling. ``classes``: ``field, digest, class, canonical`` for every spelling
    there; ``class`` is the digest of the class's canonical text.
    """
    rows = _long(df, key, fields)
    marked = materialise(rows.select("_key", "field", _digest(F.col("text")).alias("digest"), block_of("text").alias("block")).distinct(), "blocks")
    blocks = marked.groupBy("field", "block").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("field", "block")
    members = marked.join(blocks, ["field", "block"])
    one_each = members.groupBy("field", "digest").agg(F.min("_key").alias("_key"))
    texts = rows.join(one_each, ["_key", "field"]).where(F.col("digest") == _digest(F.col("text"))).select("field", "digest", "text").dropDuplicates(["field", "digest"])
    mapped = materialise(texts.withColumn("look", look_of("text")), "looks")

    plainness = F.struct(F.octet_length("text").alias("size"), F.col("text"), F.col("digest"))
    shown = F.expr("collate(look, 'UNICODE')")
    least = mapped.groupBy("field", shown.alias("shown")).agg(F.min(plainness).alias("least"), F.count("*").alias("n")).where("n > 1")
    least = least.select("field", "shown", F.col("least.digest").alias("class"), F.col("least.text").alias("canonical"))
    classes = mapped.select("field", "digest", shown.alias("shown")).join(least, ["field", "shown"]).select("field", "digest", "class", "canonical")
    return members.select("_key", "field", "digest"), classes


def lookalike_classes(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``field, class, digest, key``: a row for every row whose text has a look-alike of another spelling.

    ``class`` is the same for all texts that look the same, ``digest`` for those that
    are the same. Null and empty texts look like nothing; repeated rows come out once.
    """
    members, classes = spellings(df, key, fields)
    both = members.join(classes.select("field", "digest", "class"), ["field", "digest"])
    return both.select("field", "class", "digest", F.col("_key").alias(key)).distinct()


def lookalike_pairs(df: DataFrame, key: str, fields: Sequence[str], each: int = 5_000) -> DataFrame:
    """``field, id_a, id_b`` for every two rows whose texts look the same without being the same: the classes, seen as pairs.

    Rows of equal text are no pair, so exact copies are only paired with other
    spellings. A class of very many rows is cut into parts of about ``each``, and
    every two of its parts are paired by a task of their own.
    """
    of = ["field", "class"]
    members = materialise(lookalike_classes(df, key, fields).withColumnRenamed(key, "_key"), "classes")
    sizes = members.groupBy(*of).agg(F.ceil(F.count("*") / each).cast("int").alias("parts"))
    parted = members.join(sizes, of).withColumn("part", F.pmod(F.xxhash64("_key"), F.col("parts")).cast("int"))
    first = parted.select(*of, "part", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("other"), F.col("_key").alias("a"), F.col("digest").alias("da"))
    second = parted.select(*of, F.col("part").alias("other"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("part"), F.col("_key").alias("b"), F.col("digest").alias("db"))
    within = (F.col("part") != F.col("other")) | (F.col("a") < F.col("b"))
    pairs = first.join(second, [*of, "part", "other"]).where((F.col("da") != F.col("db")) & (F.col("a") != F.col("b")) & within)
    return pairs.select("field", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def canonical_texts(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, field, canonical`` of every row and field that has text: equal exactly if the texts look equal.

    The canonical text of a class is its shortest member in bytes, then the least in
    binary order, written in ordinary characters; so is a text without a look-alike,
    so that it stays the same when one comes. Rows of null or empty text have none.
    Repeated rows come out once.
    """
    _, classes = spellings(df, key, fields)
    rows = _long(df, key, fields).withColumn("digest", _digest(F.col("text")))
    joined = rows.join(classes.select("field", "digest", "canonical"), ["field", "digest"], "left")
    return joined.select(F.col("_key").alias(key), "field", look_of(F.coalesce("canonical", "text")).alias("canonical")).distinct()
