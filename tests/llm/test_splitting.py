"""Splitting of oversized texts."""

import random
import re

import pytest

pytest.importorskip("quern.llm")
from quern.llm.splitting import KINDS, bisect_text, overlap_start, split_oversized  # noqa: E402

RNG = random.Random(11)


def needed(text, limit):
    """The finest cut by its definition: split at all boundaries up to a kind and look at the longest part."""
    patterns = [r"(?:\r\n|\n|\r)[ \t]*(?=\r|\n)", r"\r\n|\n|\r", r"\r\n|\n|\r|(?<=[.!?])\s+", r"\s+"]
    for kind, p in zip(KINDS, patterns):
        if max(len(x.strip()) for x in re.split(p, text)) <= limit:
            return kind
    return "char"


def make():
    words = ["ab", "cde.", "f!", "longer-word", "x" * RNG.choice([3, 30, 70]), "g?"]
    glue = [" ", " ", " ", "\n", "\r\n", "\n\n", "\n \t\n", "  "]
    return "".join(RNG.choice(words) + RNG.choice(glue[: RNG.choice([3, 5, 8])]) for _ in range(RNG.randint(5, 80)))


def test_spans_cover_and_fit():
    for _ in range(400):
        text, limit, overlap = make(), 60, 12
        spans, kind = bisect_text(text, limit, overlap)
        assert "".join(text[a:b] for a, b, _ in spans) == text
        assert all(0 < b - a <= limit - overlap for a, b, _ in spans)
        assert KINDS[kind] == needed(text, limit)
        for n, (a, b, _) in enumerate(spans):
            begin = overlap_start(text, a, overlap) if n else 0
            assert b - begin <= limit and a - begin <= overlap


def test_operator_cases(spark):
    long = "word " * 1000
    rows = [("a", long, 1), ("b", "short", 2), ("c", "", 3), ("d", None, 4), ("e", "é" * 5001, 5), ("b", "short", 2), (None, "y" * 2000, 6)]
    df = spark.createDataFrame(rows, "k string, text string, piece long")
    got = {}
    for r in sorted(split_oversized(df, ["k"], "text").collect(), key=lambda r: (r["k"] or "", r["piece_no"])):
        got.setdefault(r["k"], []).append(r)
    assert set(got) == {"a", "b", "e", None}
    assert len(got["b"]) == 2 and got["b"][0]["piece"] == "short" and got["b"][0]["cut"] == ""
    assert "".join(r["piece"][r["core_start"] - r["start"] :] for r in got["a"]) == long
    assert {r["cut"] for r in got["a"]} == {"word"} and {r["cut"] for r in got["e"]} == {"char"}
    assert all(len(r["piece"]) <= 2000 for rs in got.values() for r in rs)
    assert [r["piece_no"] for r in got["a"]] == list(range(1, len(got["a"]) + 1))
    assert split_oversized(df.limit(0), ["k"], "text").count() == 0


def test_strong_boundaries_are_not_passed_over():
    sentence = "This is one of many sentences. "
    text = "Short one.\n\n" + (sentence * 180).strip() + "\n\nShort two."
    spans, _ = bisect_text(text, 2000, 200)
    assert {a for a, _, _ in spans} >= {text.index("This"), text.index("Short two")}


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], "k string, t string"), ["k"], "t", 10, 10)
