"""Encoding, counting and packing."""

import random
from collections import Counter
from pathlib import Path

import pytest

pytest.importorskip("quern.llm")
pytest.importorskip("ahocorasick")
from quern.llm.encoding import count_tokens, encode_texts  # noqa: E402
from quern.llm.packing import OpenBins, best_fit_decreasing, pack  # noqa: E402
from quern.llm.token_budget import token_budget  # noqa: E402
from quern.llm.vocabulary import FOLDER, load  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(FOLDER, "byte_bpe_50k.tiktoken").exists(), reason="no vocabulary files")

RNG = random.Random(7)
TEXTS = [
    "The report's 12th page,\r\n\tisn't here!  ", "Đường ếch phép — naïve ﬁ ①²™", "a" * 300, "=" * 257, " " * 90 + "x", "<|endoftext|> is text", "\x00\x7f﻿​",
    "".join(RNG.choice("abcdeghé 中-=\n0") for _ in range(5000)), "👩‍💻 日本語 العربية",
]


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    made.encode_special_tokens = True
    return lambda t: made.encode(t, add_special_tokens=False).ids


def test_equals_public_tokenizer(public):
    v = load()
    for t in TEXTS:
        assert list(v.encode(t)) == public(t)
        assert v.count(t) == len(public(t))


def test_three_ways_agree_and_round_trip():
    v = load()
    for _ in range(300):
        word = bytes(RNG.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(RNG.randint(1, 30)))
        assert v.by_prefix(word) == v.merged(word)
        assert b"".join(v.token[i] for i in v.longest_match(word)) == word


def test_longest_match_is_greedy():
    v = load()
    for _ in range(200):
        word = bytes(RNG.choice(b"abcdeing ") for _ in range(RNG.randint(1, 25)))
        at, want = 0, []
        while at < len(word):
            end = max(e for e in range(at + 1, len(word) + 1) if word[at:e] in v.ranks)
            want.append(v.ranks[word[at:end]])
            at = end
        assert v.longest_match(word) == want


def test_encode_texts_nulls_repeats_and_extra_columns(spark, public):
    rows = [(1, "Hello there", "x"), (2, "", "x"), (3, None, "x"), (1, "Hello there", "y"), (4, "é" * 50_000, "z")]
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "doc_id", "text").collect())
    assert got == sorted([(1, public("Hello there"))] * 2 + [(2, []), (3, []), (4, public("é" * 50_000))])
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []


def test_count_tokens(spark, public):
    df = spark.createDataFrame([("a", "x y", None), ("b", "", "some words")], "k string, t string, u string")
    got = {r["k"]: (r["n"], r["m"]) for r in count_tokens(df, ["k"], {"n": "t", "m": "u"}).collect()}
    assert got == {"a": (len(public("x y")), 0), "b": (0, len(public("some words")))}


def brute_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [(room, i) for i, room in enumerate(bins) if room >= s]
        if fit:
            bins[min(fit)[1]] -= s
        else:
            bins.append(capacity - s)
    return sorted(capacity - b for b in bins)


def test_histogram_equals_item_by_item_best_fit():
    for _ in range(200):
        capacity = RNG.choice([1, 10, 37, 64, 100])
        sizes = [RNG.randint(1, capacity) for _ in range(RNG.randint(0, 300))]
        segments, fill = {}, Counter()
        for size, rank, first, each in best_fit_decreasing(dict(Counter(sizes)), capacity):
            segments.setdefault(size, []).append((rank, first, each))
        for size, n in Counter(sizes).items():
            for j in range(n):
                rank, first, each = [s for s in sorted(segments[size]) if s[0] <= j][-1]
                fill[first + (j - rank) // each] += size
        assert sorted(fill.values()) == brute_best_fit(sizes, capacity)


def test_open_bins_find_the_tightest():
    bins = OpenBins(20)
    assert bins.tightest(1) is None
    for room in (3, 9, 20):
        bins.add(room, room, 1)
    assert [bins.tightest(s) for s in (1, 3, 4, 10, 20)] == [3, 3, 9, 20, 20]
    bins.take(9)
    assert bins.tightest(4) == 20


def test_pack_whole_result(spark):
    sizes = [RNG.choice([10, 10, 10, RNG.randint(1, 30), RNG.randint(60, 200)]) for _ in range(400)] + [0, None]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, tokens int").selectExpr("id", "tokens", "'x' AS piece")
    rows = pack(df, "id", "tokens", 64).collect()
    fill, total = Counter(), Counter()
    for r in rows:
        fill[r["container"]] += r["size"]
        total[r["id"]] += r["size"]
    assert total == Counter({i: s for i, s in enumerate(sizes) if s})
    assert max(fill.values()) <= 64
    items = [p for s in sizes if s for p in [64] * ((s - 1) // 64) + [s - (s - 1) // 64 * 64]]
    assert sorted(fill.values()) == brute_best_fit(items, 64)
    assert sorted(fill) == list(range(len(fill)))
    assert all(r["size"] == 64 for r in rows if sizes[r["id"]] > 64 and r["piece"] < (sizes[r["id"]] - 1) // 64)


def test_pack_nothing(spark):
    assert pack(spark.createDataFrame([], "id long, n long"), "id", "n", 64).collect() == []


def test_token_budget_counts_once(spark, public):
    sections = spark.createDataFrame(
        [(1, 1, "old", "d0", "1", 1), (2, 1, "r", "d1", "1", 1), (2, 1, "r", "d1", "1", 1), (2, 2, "r", "d1", "1", 2), (2, 1, "r", "d2", "1", 3), (2, 1, "s", "d3", "1", 4)],
        "snapshot_no int, delivered_at int, repo_id string, doc_id string, section_id string, id long",
    )
    fts = spark.createDataFrame([(1, "gone", "gone"), (2, "a b", "a b c"), (2, "a b", "a b c"), (3, None, ""), (4, "x", "y z")], "id long, body_l2 string, body_l3 string")
    tags = spark.createDataFrame([("r", "d1", "dom-hr"), ("r", "d1", "DOM-HR "), ("r", "d1", "dom-it"), ("r", "d1", " Lang-EN"), ("r", "d1", "d1"), ("r", "d2", None)], "repo_id string, doc_id string, tag string")
    got = {(r["slice_kind"], r["slice"]): (r["n_docs"], r["n_sections"], r["tokens_l2"], r["tokens_l3"]) for r in token_budget(sections, fts, tags).collect()}
    n = lambda t: len(public(t))
    d1, d3 = (1, 1, n("a b"), n("a b c")), (1, 1, n("x"), n("y z"))
    rest = (2, 2, n("x"), n("y z"))
    assert got == {
        ("document", "d1"): d1, ("document", "d2"): (1, 1, 0, 0), ("document", "d3"): d3, ("repository", "r"): (2, 2, *d1[2:]), ("repository", "s"): d3,
        ("language", "en"): d1, ("language", "untagged"): rest, ("domain", "hr"): d1, ("domain", "it"): d1, ("domain", "untagged"): rest,
    }
    assert token_budget(sections.limit(0), fts.limit(0), tags.limit(0)).count() == 0
