"""Queries over all of their tables that have no SQL, and operators beyond a block."""

import random
import time
import unicodedata
from pathlib import Path

import pytest

from quern import plans
from quern.operators import matching, quality, search

DATA = Path("/root/testdata/sf0.001")
data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_searches_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 3)
    monkeypatch.setattr(search, "PART", 2)
    monkeypatch.setattr(search, "ROWS", 2)
    df = spark.createDataFrame([(i, f"w{i} w{i % 3}", [float(i)]) for i in range(10)], "id long, t string, v array<double>")
    near = search.neighbours(df, "id", "v", df.selectExpr("id AS query_id", "v AS vector"), 2)
    assert sorted((r["query_id"], r["id"]) for r in near.where("rank = 1").collect()) == [(i, i) for i in range(10)]
    asked = df.selectExpr("id AS query_id", "t AS text")
    held = search.index_of(df, "id", {"t": 1.0})
    every = search.top(search.bm25(held, asked), "id", [search.F.round("score", 9).desc()], 2)
    want, got = (sorted((q, i, n, round(s, 9)) for q, i, s, n in x.collect()) for x in (every, search.keyword_leg(held, asked, 2)))
    assert {r[0] for r in want} == set(range(10))
    assert got == want


def test_suggestions_equal_all_pairs(spark):
    from difflib import get_close_matches

    rng = random.Random(3)
    words = sorted({f"{rng.choice(['hr', 'it'])}-{rng.choice(['plan', 'note'])}-{rng.randint(0, 400):06d}" for _ in range(90)} | {"".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(60)} | {"zq", "", "lang-vi", "Lang-Vi"})
    want = set()
    for w in words:
        if w:
            near = get_close_matches(w, [e for e in words if e != w], n=3)
            want |= {(w, e, round(matching.similarity(e, w), 6), i + 1) for i, e in enumerate(near)}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "t string")
    assert {tuple(r) for r in matching.suggestions(df, "t", df.withColumnRenamed("t", "e"), "e").collect()} == want


def test_suggestions_by_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 25)
    rng = random.Random(4)
    entries = sorted({f"hr-{rng.choice(['plan', 'planet'])}-{rng.randint(0, 400):08d}" for _ in range(60)} | {"".join(rng.choices("abé😀", k=rng.randint(1, 90))) for _ in range(40)} | {"é😀ab" * 60, "é😀ba" * 60})
    words = [*entries[::4], "hr-plan-", "é😀ab" * 61, "q"]
    want = set()
    for w in words:
        near = sorted(((matching.similarity(e, w), e) for e in entries if e != w), reverse=True)[:2]
        want |= {(w, e, round(s, 6), i + 1) for i, (s, e) in enumerate(near) if s >= matching.LEAST}
    asked, held = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((words, "t"), (entries, "e")))
    assert {tuple(r) for r in matching.suggestions(asked, "t", held, "e", 2).collect()} == want
    assert matching.suggestions(asked, "t", held.limit(0), "e").count() == 0


def test_suggestions_among_many_ids(spark):
    rng = random.Random(6)
    tags = sorted({f"{rng.choice(['hr', 'legal', 'security', 'procurement'])}-{rng.choice(['owner', 'digest', 'window', 'register', 'catalogue'])}-{rng.randint(0, 9_000):08d}" for _ in range(6_000)})
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    began = time.monotonic()
    got = {}
    for r in matching.suggestions(df, "t", df.withColumnRenamed("t", "e"), "e").orderBy("rank").collect():
        got.setdefault(r["t"], []).append((r["score"], r["e"]))
    # all pairs of these are 36 million, which take minutes
    assert time.monotonic() - began < 60
    assert len(got) == len(tags)
    for w in tags[::1_500]:
        assert got[w] == [(round(s, 6), e) for s, e in sorted(((matching.similarity(e, w), e) for e in tags if e != w), reverse=True)[:3]]


@data
def test_suggestions_for_every_tag(spark):
    asked = {r["tag"] for r in plans.queries()["tag_suggestions"](spark, str(DATA)).collect()}
    assert any(t[-6:].isdigit() for t in asked) and any(not t[-6:].isdigit() for t in asked)


def _stands(term, text):
    """Whether the term stands in the text with no letter, digit or low line on either side."""
    term, text = term.lower(), (text or "").lower()
    word = lambda c: c == "_" or unicodedata.category(c)[0] == "L" or unicodedata.category(c)[0] == "N"
    at = text.find(term)
    while at >= 0:
        if not (at and word(text[at - 1])) and not (at + len(term) < len(text) and word(text[at + len(term)])):
            return True
        at = text.find(term, at + 1)
    return False


@data
def test_titles_of_any_form_are_looked_up(spark):
    rows = spark.read.parquet(str(DATA / "fts.parquet")).where("id IS NOT NULL").dropDuplicates(["id"]).select("id", "title", "body_l2").collect()
    titles = {r["title"] for r in rows if (r["title"] or "").strip()}
    want = {(t, r["id"]) for t in titles for r in rows if _stands(t, r["body_l2"])}
    got = [tuple(r) for r in plans.queries()["theta_term_match"](spark, str(DATA)).select("term", "id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want
    assert any(not t.isascii() for t, _ in got) and any(" " not in t for t, _ in got)


def test_terms_with_signs(spark):
    terms = ["C++ (new)", "a-b", "Mật khẩu", "one", "x.y*", "two three four"]
    texts = ["the c++ (new) one", "a-b mật khẩu.", "xa-b none oneself", "x.y* two three four", "xzy two three fourth", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {tuple(r) for r in matching.term_matches(spark.createDataFrame([(t,) for t in terms], "term string"), "term", df, "id", "t").collect()}
    assert got == {(t, i) for t in terms for i, x in enumerate(texts) if _stands(t, x)}


def test_uncovered_runs_against_a_mask(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 40))), " ".join(rng.choices("abc", k=rng.choice([0, 2, 3, 4, 12, 40])))) for i in range(80)]
    texts += [(80, None, "a"), (81, "a b c d e f", None), (82, "p q r s t u a b c d v w x y z", "a b c d")]
    for least in (1, 5):
        want = set()
        for i, a, b in texts:
            a, b = (a or "").split(), (b or "").split()
            n = 1 if min(len(a), len(b)) < 4 else 4
            covered = [any(a[p : p + n] == b[q : q + n] for p in range(max(x - n + 1, 0), min(x, len(a) - n) + 1) for q in range(len(b) - n + 1)) for x in range(len(a))] + [True]
            start = 0
            for x, ok in enumerate(covered):
                if ok:
                    if x - start >= least:
                        want.add((i, start, x - start, " ".join(a[start:x])))
                    start = x + 1
        df = spark.createDataFrame(texts, "id long, body_l2 string, body_l3 string")
        got = [tuple(r) for r in quality.uncovered_runs(df, least=least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert (82, 0, 6, "p q r s t u") in want and (82, 10, 5, "v w x y z") in want
