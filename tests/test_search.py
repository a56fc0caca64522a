"""Search over kept indexes and vector lists."""

import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import session
from quern.functions import text as tx
from quern.operators import index, search, vectors

RNG = random.Random(12)
WEIGHTS = {"title": 2.0, "body": 1.0}
SCHEMA = "id long, title string, body string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def held(ix):
    return {(i, t): (f, dl) for i, t, f, dl in rows(ix.postings.select("id", "token", "f", "dl"))}


def plain_postings(docs):
    out = {}
    for i, title, body in docs:
        if i is None:
            continue
        parts = [((t or "").lower().split(), w) for t, w in ((title, 2.0), (body, 1.0))]
        for words, w in parts:
            for x in words:
                f, _ = out.get((i, x), (0.0, 0))
                out[i, x] = (f + w, sum(len(p) for p, _ in parts))
    return out


def make(n):
    return [(i, " ".join(RNG.choices("abcdef", k=RNG.randint(0, 4))), RNG.choice([None, "", "x y " * RNG.randint(1, 9)])) for i in range(n)]


def test_index_follows_its_rows(spark, tmp_path, monkeypatch):
    path, docs = str(tmp_path / "ix"), make(40)
    frame = lambda: spark.createDataFrame(docs + docs[:5] + [(None, "a", "b")], SCHEMA).withColumn("digest", F.lit(1)).withColumn("seg", F.lit("x"))
    assert held(index.sync(frame(), path, "id", WEIGHTS)) == plain_postings(docs)
    for turn in range(12):
        del docs[RNG.randrange(len(docs))]
        docs.append((1000 + turn, "new one", "z"))
        docs[0] = (docs[0][0], f"changed {turn}", docs[0][2])
        found = index.sync(frame(), path, "id", WEIGHTS)
        assert held(found) == plain_postings(docs) and found.rows == len(docs)
    assert held(index.load(spark, path)) == plain_postings(docs)
    version = index._meta(spark, path)[0]
    index.sync(frame(), path, "id", WEIGHTS, stamp="s")
    index.sync(frame().limit(1), path, "id", WEIGHTS, stamp="s")
    assert index._meta(spark, path)[0] == version + 1


def test_index_of_nothing(spark, tmp_path):
    path = str(tmp_path / "ix")
    empty = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    for df in (empty, spark.createDataFrame([(1, None, "")], SCHEMA), spark.createDataFrame([(1, "a", "")], SCHEMA), empty):
        found = index.sync(df, path, "id", WEIGHTS)
        assert search.keyword_leg(found, asked).count() == df.where("title = 'a'").count()


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    path = str(tmp_path / "ix")
    index.sync(spark.createDataFrame([(1, "a", "b")], SCHEMA), path, "id", WEIGHTS)
    (tmp_path / "ix" / "meta" / "v=2").mkdir()
    assert index._meta(spark, path)[0] == 1
    assert index.sync(spark.createDataFrame([(1, "c", "b")], SCHEMA), path, "id", WEIGHTS).rows == 1
    assert set(held(index.load(spark, path))) == {(1, "c"), (1, "b")}


def test_only_the_tokens_parts_are_read(spark, tmp_path):
    found = index.sync(spark.createDataFrame(make(40), SCHEMA), str(tmp_path / "ix"), "id", WEIGHTS)
    plan = search.bm25(found, spark.createDataFrame([(1, "a")], "query_id long, text string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "body" not in plan


def test_filters_leave_weights_alone(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red cat"), (3, "dog"), (4, "cow"), (5, "red")], "id long, t string")
    asked = spark.createDataFrame([(7, "red fox")], "query_id long, text string")
    ix = search.index_of(docs, "id", {"t": 1.0})
    scores = {i: s for _, i, s in rows(search.bm25(ix, asked))}
    kept = {i: s for _, i, s in rows(search.bm25(ix, asked, only=docs.where("id < 3")))}
    assert kept == pytest.approx({i: scores[i] for i in (1, 2)})


def test_single_accents_are_folded(spark):
    words = ["phép", "ếch", "đường", "Sécurité", "Prüfung", "e\u0301", "a_b", "Straße"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = [r[0] for r in df.select(tx.search_tokens(tx.nfc("t"))).collect()]
    assert got == [["phep"], ["ếch"], ["đuờng"], ["securite"], ["prufung"], ["e"], ["a", "b"], ["straße"]]
    assert all(len(unicodedata.normalize("NFD", c)) == 2 for c in tx.ACCENTED) and len(tx.ACCENTED) == len(tx.BARE)


def clusters(n, dim=6):
    centres = np.random.default_rng(3).normal(size=(12, dim)) * 8
    g = np.random.default_rng(4)
    return [(i, (centres[i % 12] + g.normal(size=dim)).tolist()) for i in range(n)]


def test_neighbours_equal_brute_force(spark):
    g = np.random.default_rng(5)
    points = [(i, g.integers(0, 3, 4).astype(float).tolist()) for i in range(3000)] + [(9000, None), (9001, [1.0])]
    df = spark.createDataFrame(points, "id long, v array<double>")
    asked = df.where("id < 20 OR id = 9000").selectExpr("id AS query_id", "v AS vector")
    at = np.array([p for _, p in points[:3000]])
    for floor in (None, 0.6):
        want = []
        for q in range(20):
            d = np.sqrt(((at - at[q]) ** 2).sum(1))
            order = [i for i in np.lexsort((np.arange(3000), d)) if floor is None or 1 / (1 + d[i]) >= floor][:7]
            want += [(q, int(i), round(float(d[i]), 9), n + 1) for n, i in enumerate(order)]
        got = search.neighbours(df, "id", "v", asked, 7, floor)
        assert [(q, i, round(d, 9), n) for q, i, d, n in sorted(rows(got), key=lambda r: (r[0], r[3]))] == want


def test_lists_find_nearly_all(spark):
    df = spark.createDataFrame(clusters(4000) + [(5000, None)], "id long, v array<double>")
    asked = df.where("id % 100 = 0").selectExpr("id AS query_id", "v AS vector")
    exact = search.neighbours(df, "id", "v", asked, 20)
    own = vectors.lists(df, "id", "v", 20)
    assert own.probes < len(own.centroids) / 2
    assert vectors.recall(vectors.search_lists(own, asked, 20), exact, "id") >= 0.9
    all_ = vectors.search_lists(own, asked, 20, probes=len(own.centroids))
    near = lambda df: [(r[0], r[1], r[3]) for r in rows(df)]
    assert near(all_) == near(exact)
    none = vectors.lists(df.limit(0), "id", "v")
    assert vectors.search_lists(none, asked).count() == 0


def test_filter_behind_the_search(spark):
    leg = spark.createDataFrame([(1, i, i) for i in range(1, 9)], "query_id int, id int, rank int")
    got = search.after_cut(leg, "id", leg.where("id % 2 = 0").select("id"), 3)
    assert rows(got.select("id", "rank")) == [(2, 1), (4, 2), (6, 3)]


def test_ambiguous_results(spark):
    found = [(1, 5, 1, "keyword", "d"), (1, 6, 3, "keyword", "e"), (2, 5, 1, "keyword", "d"), (2, 6, 2, "hybrid", "e"), (3, 5, 1, "semantic", "d"), (3, 7, 2, "keyword", "d"), (4, 5, 1, "keyword", "d"), (5, 6, 1, "keyword", "d"), (5, 7, 2, "keyword", "e")]
    results = spark.createDataFrame(found, "query_id int, id int, rank int, mode string, doc_id string")
    keyword = spark.createDataFrame([(q, i, 2.0 if q < 5 else float(i)) for q in range(1, 6) for i in (5, 6, 7)], "query_id int, id int, score double")
    assert rows(search.ambiguous_top(results, keyword, "id", ["doc_id"])) == [(1, "score"), (3, "mirrored")]


def test_stages_can_be_dropped(spark):
    import os

    a, b = session.materialise(spark.range(3), "a"), session.materialise(spark.range(4), "b")
    session.drop(a, spark.range(1))
    assert not os.path.exists(a._quern_stage) and b.count() == 4
    session.release(spark)
    assert not os.path.exists(b._quern_stage)
