"""Text functions as columns; Python only where the JVM has no equivalent (Unicode normal forms)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A token: letters and numbers, nothing else.
TOKEN = r"[\p{L}\p{N}]+"
#: White space at either end of a text.
OUTER = r"(?U)^\s+|\s+$"


def _single_accents() -> tuple[str, str]:
    """Small letters that are one of a to z with a single mark, and those without it."""
    parts = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x1F00)}
    found = {c: d[0] for c, d in parts.items() if len(d) == 2 and "a" <= d[0] <= "z" and unicodedata.combining(d[1])}
    return "".join(found), "".join(found.values())


ACCENTED, BARE = _single_accents()


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; the JVM has no function for it. Null stays null, plain ASCII is passed through."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition. Null stays null, plain ASCII is passed through."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    """Compatibility composition and full case folding."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(T.StringType())
def ascii_fold(texts: pd.Series) -> pd.Series:
    """Letters without accents, and without what ASCII can't express."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def tokens(text: Column) -> Column:
    """Lower-case tokens in order; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def search_tokens(text: Column) -> Column:
    """Tokens as the index holds them: letters with a single accent count as those without, letters with two, and đ, as their own."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, BARE), F.lit(f"({TOKEN})"), F.lit(1))


def token_estimate(text: Column) -> Column:
    """About four characters a token, rounded up; null and '' have none."""
    return F.floor((F.coalesce(F.char_length(text), F.lit(0)) + 3) / 4).cast("long")


def slug(text: Column) -> Column:
    """ASCII words joined by hyphens, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(ascii_fold(text), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def slug_id(text: Column, longest: int = 40) -> Column:
    """Words of any script joined by hyphens, in lower case, cut to ``longest`` characters without a hyphen at the end."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(joined, 1, longest), "-+$", "")


def citation(repo: Column, doc: Column, section: Column, revision: Column) -> Column:
    """``repo:doc §section (revision)``, without the brackets where there is no revision."""
    return F.concat(repo, F.lit(":"), doc, F.lit(" §"), section, F.when(F.coalesce(revision, F.lit("")) != "", F.concat(F.lit(" ("), revision, F.lit(")"))).otherwise(F.lit("")))


def embedding_text(title: Column, summary: Column, body: Column, longest: int = 500) -> Column:
    """What is embedded of a section: title and summary, and the start of a body that isn't empty."""
    start = F.substring(F.coalesce(body, F.lit("")), 1, longest)
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")), F.when(start != "", F.concat(F.lit("\n"), start)).otherwise(F.lit("")))


def content_digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by line feeds; null counts as ''."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def snippet(text: Column, terms: Column, around: int = 150) -> Column:
    """The text around the first occurrence of the first term that occurs, with … where it is cut; null if none does.

    Terms are looked for as parts of words, whatever the letter case; the window has
    no white space at its ends.
    """

    def around_first(found: Column) -> Column:
        start = F.greatest(F.lit(1), found["at"] - around)
        end = F.least(found["size"], found["at"] + F.char_length(found["term"]) - 1 + around)
        cut = F.regexp_replace(F.substring(text, start, end - start + 1), OUTER, "")
        return F.when(found["at"] > 0, F.concat(F.when(start > 1, F.lit("…")).otherwise(F.lit("")), cut, F.when(end < found["size"], F.lit("…")).otherwise(F.lit(""))))

    def placed(low: Column) -> Column:
        first = F.get(F.filter(terms, lambda t: F.contains(low, t)), F.lit(0))
        return let(first, lambda term: let(F.struct(F.call_function("instr", low, term).alias("at"), F.char_length(text).alias("size"), term.alias("term")), around_first))

    return let(F.lower(text), placed)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used; within a lambda an expression is computed at each call."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def redact_url(url: Column) -> Column:
    """A URL without user name and password."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@\s]*@", "$1")


def route_shape(path: Column) -> Column:
    """A route with every parameter (``:id``, ``{id}``, ``<id>``, ``[id]``) written ``{}`` and no slash at the end."""
    return F.regexp_replace(F.regexp_replace(path, r"(?<=/)(?::[^/]+|\{[^/}]*\}|<[^/>]*>|\[[^/\]]*\])", "{}"), r"(?<=.)/+$", "")


def strip_comments(html: Column) -> Column:
    """Without HTML comments."""
    return F.regexp_replace(html, "(?s)<!--.*?-->", "")


def natural_key(section_id: Column) -> Column:
    """Dotted ids as lists of numbers, so that 1.10 sorts after 1.9; other parts count as nothing."""
    return F.transform(F.split(section_id, r"\."), lambda x: x.try_cast("int"))
