"""Plug-ins: fact extractors, as patterns or as table functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: An extractor takes a text and yields facts as (kind, value).
Extractor = Callable[[str], Iterator[tuple[str, str]]]

#: The patterns that come with the engine: forms, numbers of references, addresses. The first group is the value, or else the whole.
PATTERNS = {
    "form": r"\bFN-\d+\b",
    "reference": r"(?:\b(?:No\.|Nr\.|N°)|(?<![\p{L}\p{N}_])Số)\s?(\d+)",
    "url": r"https?://[^\s)>\]]+",
}

#: A group in a pattern.
_GROUP = re.compile(r"(?<!\\)\((?!\?)")


def pattern_facts(df: DataFrame, key: str, text: str, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """``key, kind, value, times``: what patterns find in texts, each fact once a text, without leaving the JVM; null has none."""
    found = [F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(1 if _GROUP.search(p) else 0)).alias("values")) for kind, p in patterns.items()]
    each = df.where(F.col(text).isNotNull()).select(key, F.explode(F.array(*found)).alias("f")).select(key, "f.kind", F.explode("f.values").alias("value"))
    return each.groupBy(key, "kind", "value").agg(F.count("*").cast("int").alias("times"))


def pattern_extractor(kind: str, pattern: str) -> Extractor:
    """Facts of one kind by a pattern, as an extractor for use beside others that no pattern can express."""
    compiled = re.compile(pattern)

    def extract(text: str) -> Iterator[tuple[str, str]]:
        for m in compiled.finditer(text):
            yield kind, m[1] if compiled.groups else m[0]

    return extract


def facts_function(extractors: tuple[Extractor, ...]):
    """A table function ``text -> kind, value, times`` of any extractors; each fact once a text, null has none. Rows go by in Arrow batches."""

    @udtf(returnType="kind string, value string, times int", useArrow=True)
    class Facts:
        def eval(self, text: str):
            found: dict[tuple[str, str], int] = {}
            for extract in extractors:
                for fact in extract(text or ""):
                    found[fact] = found.get(fact, 0) + 1
            for (kind, value), times in found.items():
                yield kind, value, times

    return Facts


def register(spark: SparkSession, name: str, extractors: tuple[Extractor, ...]) -> None:
    """Make the function known to SQL, for lateral joins."""
    spark.udtf.register(name, facts_function(extractors))
