"""Reading bands."""

import math
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quern.llm")
from quern.llm import reading as R  # noqa: E402

RNG = random.Random(4)
EASY = "the cat dog sat ran on mat".split()
HARD = [f"{a}{b}ization" for a in ("inter", "counter", "macro", "para") for b in ("national", "operational", "organ", "institutional")]
OFFICE = ["report", "manager", "schedule", "invoice", "meeting", "server", "budget"]


def text(band):
    words, length = {1: (EASY, 5), 2: (EASY + OFFICE, 9), 3: (OFFICE + HARD, 16), 4: (HARD, 28)}[band]
    return " ".join(" ".join(RNG.choice(words) for _ in range(length + RNG.randint(-1, 1))).capitalize() + "." for _ in range(RNG.randint(9, 15)))


def corpus(n=160):
    bands = [RNG.randint(1, 4) for _ in range(n)]
    docs = [(i, text(b), RNG.choice(["en", "EN", "en-GB", None, "und"]), "x") for i, b in enumerate(bands)]
    labels = [(i, b, "r1") for i, b in enumerate(bands) if i % 2 == 0] + [(0, None, "r2"), (2, 1 + bands[2] % 4, "r2"), (2, bands[2], "r3"), (None, 1, "r")]
    odd = [(1000, None, "en", ""), (1001, "", "en", ""), (1002, "Too short.", "en", ""), (1003, "| a | b |\n" * 60, "en", ""), (1004, "```\n" + "code words here\n" * 30 + "```", "en", ""), (None, text(1), "en", "")]
    return bands, docs + docs[:5] + odd, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, words string"), spark.createDataFrame(labels, "doc_id long, reading_band int, labeller string")


def test_held_out_accuracy_and_cases(spark):
    bands, docs, labels = corpus()
    got = R.reading_bands(*frames(spark, docs, labels)).collect()
    assert len(got) == len({r["doc_id"] for r in got}) == len(bands)
    held_out = [r["reading_band"] == bands[r["doc_id"]] for r in got if r["doc_id"] % 2]
    assert sum(held_out) / len(held_out) >= 0.9


def test_head_changes_nothing(spark):
    _, docs, labels = corpus(80)
    d, l = frames(spark, docs, labels)
    assert sorted(map(tuple, R.reading_bands(d, l, head=2).collect())) == sorted(map(tuple, R.reading_bands(d, l).collect()))


def test_ranks_by_join_equal_those_of_the_head(spark):
    _, docs, labels = corpus(60)
    spoken = R.with_language(R.profiles(frames(spark, docs, labels)[0]))
    assert {tuple(r) for r in R.coverage(spoken, head=1).collect()} == {tuple(r) for r in R.coverage(spoken).collect()}


def test_no_documents_or_labels(spark):
    _, docs, labels = corpus(10)
    d, l = frames(spark, docs, labels)
    assert R.reading_bands(d.limit(0), l).count() == 0
    assert R.reading_bands(d, l.limit(0)).count() == 0


def test_coverage_against_sorting():
    rows = [[(RNG.randint(1, 50), RNG.randint(1, 9)) for _ in range(RNG.randint(1, 20))] for _ in range(50)]
    ranks, counts = (np.array([x[k] for r in rows for x in r]) for k in (0, 1))
    starts = np.cumsum([0] + [len(r) for r in rows[:-1]])
    for share, got in zip((0.5, 0.9), R.coverage_ranks(ranks, counts, starts, (0.5, 0.9))):
        for r, rank in zip(rows, got):
            flat = sorted(x for x, n in r for _ in range(n))
            assert rank == flat[math.ceil(share * len(flat)) - 1]


def test_ranks_share_ties(spark):
    words = [("en", w, n) for w, n in Counter("aaabbccd").items()]
    got = {r["word"]: r["rank"] for r in R.with_ranks(spark.createDataFrame(words, "language string, word string, n long")).collect()}
    assert got == {"a": 1, "b": 3, "c": 3, "d": 4}


def test_prose():
    assert R.prose("# H\nOne two\nthree.\n\n| t |\n- item a\n  more\n1. b\n```\nx\n```\nend") == ["One two three.", "item a more", "b", "end"]
    words, sentences, letters = R.profile_text("Aa bb. Cc!\n\n- d e")
    assert (words, sentences, letters) == (Counter(aa=1, bb=1, cc=1, d=1, e=1), 3, 8)
    assert R.profile_text(None)[0] == Counter()
