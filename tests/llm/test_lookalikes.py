"""Texts that look the same."""

import itertools
import random
import unicodedata

import pytest

pytest.importorskip("quern.llm")
from quern.llm.lookalikes import canonical_texts, look, lookalike_classes, lookalike_pairs  # noqa: E402

RNG = random.Random(2)
BASE = ["Đường file naïve 2² A-b TM", "plan offen µ 12", "the team", "ếch ộp"]


def disguise(text):
    swaps = [
        lambda t: unicodedata.normalize("NFD", t), lambda t: t.replace("e", "е"), lambda t: t.replace(" ", "\xa0"), lambda t: t.replace("a", "a​"), lambda t: t.replace("fi", "ﬁ"),
        lambda t: t.replace("-", "‑"), lambda t: t.replace("t", "ｔ"), lambda t: "﻿" + t, lambda t: t.replace("n", "n\xad"), lambda t: t.replace("\xb5", "μ"), lambda t: t,
    ]
    for f in RNG.sample(swaps, 2):
        text = f(text)
    return text


VISIBLE = [("2²", "22"), ("TM", "™"), ("A", "a"), ("ï", "i"), ("1", "①"), ("team", "tеam "), ("ộ", "ô")]


def make():
    rows = []
    for i in range(120):
        text = RNG.choice(BASE)
        if RNG.random() < 0.3:
            text = text.replace(*RNG.choice(VISIBLE))
        rows.append((i, disguise(text), RNG.choice([None, "", disguise("same"), disguise(BASE[0])])))
    return rows + rows[:10]


def test_pairs_equal_all_pairs_by_look(spark):
    rows = make()
    df = spark.createDataFrame(rows, "id long, a string, b string").withColumnsRenamed({"b": "digest"})
    got = [tuple(r) for r in lookalike_pairs(df, "id", ["a", "digest"]).collect()]
    want = set()
    for n, field in ((1, "a"), (2, "digest")):
        for x, y in itertools.combinations(sorted(set(rows), key=lambda r: r[0]), 2):
            if x[n] and y[n] and x[n] != y[n] and look(x[n]) == look(y[n]) and x[0] < y[0]:
                want.add((field, x[0], y[0]))
    assert len(got) == len(set(got)) and set(got) == want and want
    assert {tuple(r) for r in lookalike_pairs(df, "id", ["a", "digest"], each=3).collect()} == want
    classes = [tuple(r) for r in lookalike_classes(df, "id", ["a", "digest"]).collect()]
    assert len(classes) == len(set(classes))
    assert {(f, k) for f, _, _, k in classes} == {(f, k) for f, a, b in want for k in (a, b)}


def test_canonical_is_equal_exactly_if_looks_are(spark):
    rows = make()
    df = spark.createDataFrame(rows, "id long, a string, b string")
    got = {(r["id"], r["field"]): r["canonical"] for r in canonical_texts(df, "id", ["a", "b"]).collect()}
    texts = {(i, f): t for i, a, b in rows for f, t in (("a", a), ("b", b)) if t}
    assert set(got) == set(texts)
    for (p, x), (q, y) in itertools.combinations(texts.items(), 2):
        if p[1] == q[1]:
            assert (got[p] == got[q]) == (look(x) == look(y))
    assert all(got[p] == look(x) for p, x in texts.items())


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "id long, a string")
    assert lookalike_pairs(empty, "id", ["a"]).count() == 0
    assert canonical_texts(empty, "id", ["a"]).count() == 0
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "id long, a string")
    assert lookalike_pairs(df, "id", ["a"]).count() == 0


def test_line_ends_and_what_can_be_seen():
    assert look("a\r\nb") == look("a\nb")
    for a, b in (("é", "e"), ("A", "a"), ("²", "2"), ("①", "1"), ("™", "TM"), ("α", "a"), ("a  b", "a b")):
        assert look(a) != look(b)
