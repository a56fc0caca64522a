"""Repair of scanned pages."""

import random

import pytest

pytest.importorskip("quern.llm")
from quern.llm import scans as S  # noqa: E402

RNG = random.Random(9)
WORDS = "the manager should review annual contract team report desk window long-term cross-border organisation reconciliation methodology digital register summer".split()


@pytest.mark.parametrize(
    ("line", "number"),
    [("Page 13", 13), ("Page l4", 14), ("[3]", 3), ("- 7 -", 7), ("7 | 18", 7), ("Seite 5 | 9", 5), ("13 / 3S", 13), ("vi", 6), ("xiv", 14), ("   12", 12), ("Trang 9", 9), ("Page 7 of 18", 7), ("-" * 40 + " 13 " + "-" * 40, 13), ("7 of apples", None), ("18 13", None), ("the 7", None), ("FN-7", None), ("mix", None), ("", None), ("7 apples", None)],
)
def test_page_numbers(line, number):
    found = S.page_number(line)
    assert (found and found[0]) == number


def test_headers_misread_and_with_numbers():
    headers = S.Headers(S.header_forms("Zurtis Field Guide — 2025-02") | S.header_forms("Zurtis · Internal use only"))
    for line in ("Zurtis Ficld Guide — 2025-02", "ZURTIS FIELD GUIDE — 2025-02", "  Zurtis  ·  Interna1  use  on1y", "2 Zurtis Field Guide — 2025-02", "Zurtis Field Guide — 2025-02   35"):
        assert headers.repeated_by(line), line
    for line in ("Zurtis Field Guide: The report may send the plan", "The team should review", "Zurtis"):
        assert not headers.repeated_by(line), line


def test_near_headers_equal_comparing_all():
    from difflib import SequenceMatcher

    for _ in range(300):
        forms = {"".join(RNG.choices("abcde", k=RNG.randint(4, 40))) for _ in range(4)}
        made = S.Headers(forms)
        form = list(RNG.choice(sorted(forms)))
        for _ in range(RNG.randint(0, 5)):
            form[RNG.randrange(len(form))] = RNG.choice(["", "x", "a", "ab"])
        form = "".join(form)
        want = any(abs(len(form) - len(h)) <= 2 and len(h) >= 8 and SequenceMatcher(None, form, h, autojunk=False).ratio() >= 0.9 for h in forms)
        assert made._near(form) == want


def test_masks_are_those_of_joined_words():
    for line, other in (("Acme Field Guide 2025", "Zurtis Field Guide 2031"), ("The Acme", "Acme"), ("a " * 200 + "b", "a " * 200 + "c")):
        words = lambda t: [S.fold(w) for w in S.re.sub(r"\d+", "0", t).split()]
        joined = lambda w: {f for f in ("".join(w[:i] + w[i + 1 :]) for i in range(len(w))) if len(w) > 1 and len(f) >= 4}
        assert bool(set(S.masks(line)) & set(S.masks(other))) == bool(joined(words(line)) & joined(words(other)))
        assert len(S.masks(line)) == len(joined(words(line)))


PAIRS = (
    ("annual", "arinual"), ("team", "tearn"), ("window", "vvindow"), ("read", "rcacl"), ("list", "1lst"), ("holiday", "hohday"), ("internen", "intemen"), ("liệu", "lie.u"), ("mäßig", "mäbig"),
    ("minimum", "rniriirnurn"), ("window", "vviriclovv"),
)


def test_misreadings_have_the_words_skeleton():
    for word, seen in PAIRS:
        assert S.skeleton(word) == S.skeleton(seen) and S.confused(word, seen)
    for real, seen in S.CONFUSIONS:
        assert S.skeleton(real) == S.skeleton(seen)
    assert S.confused("team", "term") is None and S.confused("tearn", "team") == (18,) and S.confused("team", "team") == ()


def test_confusions_equal_all_ways():
    def every(word):
        if not word:
            return {"": 0}
        found = {word[0] + rest: n for rest, n in every(word[1:]).items()}
        for real, seen in S.CONFUSIONS:
            if word.startswith(real):
                for rest, n in every(word[len(real) :]).items():
                    found[seen + rest] = min(found.get(seen + rest, 99), n + 1)
        return found

    for word in ("annul", "child", "bốn", "line"):
        for seen, n in every(word).items():
            assert len(S.confused(word, seen)) == n and S.skeleton(seen) == S.skeleton(word)


def test_skeletons_in_sql(spark):
    words = [w for pair in PAIRS for w in pair] + ["ộậßq", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(S._skeleton_of(S.F.col("w"))).collect()] == [S.skeleton(w) for w in words]


def test_viterbi_equals_all_paths():
    import itertools
    import math

    unigram = {w: RNG.randint(1, 50) for w in "abcdef"}
    pairs = {(a, b): RNG.randint(0, 5) for a in "abcdef" for b in "abcdef"}
    total = sum(unigram.values())

    def score(path, line):
        s = 0
        for i, w in enumerate(path):
            alone = (unigram.get(w, 0) + 0.01) / total
            s += dict(line[i])[w] + math.log(alone if not i else (1 - S.PAIR_SHARE) * alone + S.PAIR_SHARE * pairs.get((path[i - 1], w), 0) / (unigram[path[i - 1]] + 1))
        return s

    for _ in range(50):
        line = [[(w, -RNG.random() * 5) for w in RNG.sample("abcdef", RNG.randint(1, 3))] for _ in range(5)]
        best = max(score(p, line) for p in itertools.product(*[[w for w, _ in o] for o in line]))
        assert score(S.viterbi(line, unigram, pairs, total), line) == pytest.approx(best)


BODY = """## 1.1 Title
The manager should review the long-
term con\xad
Acme Handbook
7

tract and pre- and
post-checks. The tearn of the organi¬
sation is cross-
border.

FN-7:
12
8
19
7 apples

| 8 | tearn |
"""


def tables(spark, body, pages=True, furniture=True):
    clean = [(i, "t", " ".join(RNG.choice(WORDS) for _ in range(40)), "pre and post checks and", "the and " * 30) for i in range(10, 60)]
    fts = spark.createDataFrame([(1, "x", None, "", body), (1, "x", None, "", body), (2, None, None, None, None), (3, "x", "", "", body.replace("tearn", "team")), *clean], "id long, title string, summary string, body_l2 string, body_l3 string")
    sections = spark.createDataFrame([(1, 1, "r", "d", "1", 1), (1, 1, "r", "d", "2", 2), (1, 1, "r", "other", "1", 3)], "snapshot_no int, delivered_at int, repo_id string, doc_id string, section_id string, id long")
    own = spark.createDataFrame([("r", "d", 1, "Acme Handbook\n1 Title\nThe manager\n7"), ("r", "d", 2, "Acme Handbook\ntract\n8"), ("r", "d", 3, None)], "repo_id string, doc_id string, page int, page_text string")
    lines = spark.createDataFrame([("r", "d", 1, "Acme Handbook"), ("r", "d", 1, "7"), ("r", "d", 2, None)], "repo_id string, doc_id string, page int, line_text string")
    spans = spark.createDataFrame([("r", "d", "f", "1", 1, 2), ("r", "d", "f", "1", 1, 2)], "repo_id string, doc_id string, file string, section_id string, page int, end_page int")
    return sections, fts, own if pages else own.limit(0), lines if furniture else lines.limit(0), spans


WANT = {(1, "broken", "long-term"), (1, "broken", "contract"), (1, "broken", "organisation"), (1, "broken", "cross-border"), (1, "misread", "team"), (1, "header", ""), (1, "page_number", "")}


@pytest.mark.parametrize("furniture", [True, False])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_found(spark, furniture, newline):
    got = [tuple(r) for r in S.scan_noise(*tables(spark, BODY.replace("\n", newline), furniture=furniture)).collect()]
    assert len(got) == len(set(got)) and set(got) == WANT


@pytest.mark.parametrize("head", [1, 5, 12])
def test_no_result_depends_on_the_head(spark, head):
    assert {tuple(r) for r in S.scan_noise(*tables(spark, BODY), head=head).collect()} == WANT
    fixed = lambda n: {tuple(r) for r in S.repair_scans(*tables(spark, BODY), head=n).collect()}
    assert fixed(head) == fixed(S.HEAD)


def test_many_confusions_and_rare_words(spark):
    sections, fts, pages, furniture, spans = tables(spark, "## 1\nThe annual rniriirnurn is in the vviriclovv of the contract.")
    known = spark.createDataFrame([(90, "the minimum", "", "", "")], fts.schema)
    got = {tuple(r) for r in S.scan_noise(sections, fts.where("id <> 3").unionByName(known), pages, furniture, spans).collect()}
    assert got == {(1, "misread", "minimum"), (1, "misread", "window")}


def test_deep_running_lines(spark):
    text = lambda n: "\n".join([*(f"Acme line {x}" for x in ("one", "two", "three", "four", "five")), f"body {n} of its own {n}", "more text.", "and more.", "end."])
    pages = spark.createDataFrame([("r", "d", n, text("abcd"[n])) for n in range(4)], "repo_id string, doc_id string, page int, page_text string")
    none = spark.createDataFrame([], "repo_id string, doc_id string, page int, line_text string")
    found = S.running_lines(pages, none).first()["headers"]
    assert {S.fold(f"Acme line {x}") for x in ("one", "two", "three", "four", "five")} <= set(found)


def test_repaired(spark):
    got = {r["id"]: r["body_l3"] for r in S.repair_scans(*tables(spark, BODY)).collect()}
    assert len(got) == 53 and got[3] == BODY.replace("tearn", "team") and got[2] is None
    assert got[1].splitlines()[:2] == ["## 1.1 Title", "The manager should review the long-term contract and pre- and post-checks. The team of the organisation is cross-border."]
    assert "| 8 | tearn |" in got[1] and "FN-7: 12 8 19 7 apples" in got[1]


def test_without_scans(spark):
    sections, fts, pages, furniture, spans = tables(spark, BODY, pages=False)
    assert S.scan_noise(sections, fts, pages, furniture, spans).count() == 0
    assert S.scan_noise(sections.limit(0), fts.limit(0), pages, furniture.limit(0), spans.limit(0)).count() == 0


def test_long_text(spark):
    got = S.scan_noise(*tables(spark, "## 1\n" + "The tearn should review.\n" * 20_000)).collect()
    assert [tuple(r) for r in got] == [(1, "misread", "team")]


def test_numbers_of_a_list_are_no_page_numbers():
    kinds = [line.kind for line in S.classify("x:\n12\n7\n\n8\ny\n7", S.Headers(()), {7, 8})]
    assert kinds == ["text", "text", "text", "blank", "page_number", "text", "page_number"]
