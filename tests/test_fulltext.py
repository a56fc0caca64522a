"""Full texts against their pages, sectioning, and small record operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import fulltext as ft
from quern.operators import records, sectioning

RNG = random.Random(6)
SECTIONS = "repo_id string, doc_id string, section_id string, ord int, title string, page int, end_page int, l3 string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*columns).first()


def test_words_and_marks(spark):
    assert one(spark, "Straße ﬁx-\n ture a_b K-\n  9", ft.normal_words(F.col("t")))[0] == ["strasse", "fixture", "a", "b", "k9"]
    md = "## Head *one*\n| a | b |\n|---|:-:|\n```py\ncode\n```\n![pic](x.png) [link](u) snake_case _em_"
    assert one(spark, md, ft.without_marks(F.col("t")))[0].split() == "Head one a b code pic link snake_case em".split()


def test_runs_and_furniture(spark):
    for _ in range(60):
        words, needle, start = RNG.choices("abc", k=RNG.randint(0, 12)), RNG.choices("abc", k=RNG.randint(0, 3)), RNG.randint(0, 3)
        df = spark.createDataFrame([(words, needle)], "w array<string>, n array<string>")
        want = next((i for i in range(start, len(words)) if needle and words[i : i + len(needle)] == needle), -1)
        left = list(words)
        for line in (needle, ["a"]):
            at = next((i for i in range(len(left)) if line and left[i : i + len(line)] == line), None)
            if at is not None:
                del left[at : at + len(line)]
        got = df.select(ft.run_at(F.col("w"), F.col("n"), F.lit(start)), ft.without_furniture(F.col("w"), F.array("n", F.array(F.lit("a"))))).first()
        assert tuple(got) == (want, left)


def test_prose_blocks(spark):
    text = "one\ntwo\n\nthree\n- item\nfour\n```\ncode\n\n```\nfive\n| t |\n\nsix"
    assert one(spark, text, ft.prose_blocks(F.col("t")))[0] == ["one\ntwo", "three", None, "four", None, None, None, None, "five", None, "six"]


@pytest.fixture
def document(spark):
    text = [
        ("1", 1, "Alpha overview", 1, 2, "Alpha overview the quick brown fox jumps over\n\nthe lazy dog today. Words the pages never had at all."),
        ("2", 2, "Beta details", 2, 2, "Beta details say nothing much here now"),
        ("3", 3, "Gamma appendix", 1, None, "Gamma appendix"),
        ("4-x", 4, "4 x", 4, 4, "empty page"),
        ("5", 5, "No page", None, None, "no page at all here"),
    ]
    sections = spark.createDataFrame([("r", "d", s, o, t, p, e, x) for s, o, t, p, e, x in text], SECTIONS)
    pages = spark.createDataFrame(
        [
            ("r", "d", 1, "Acme Guide\nAlpha overview the quick brown fox jumps over the lazy dog today."),
            ("r", "d", 2, "Acme Guide\nThis passage is lost from every text. Beta details say nothing much here now"),
            ("r", "d", 4, " \n "), ("r", "d", 9, None),
        ],
        "repo_id string, doc_id string, page int, page_text string",
    )
    furniture = spark.createDataFrame([("r", "d", 1, "ACME guide"), ("r", "d", 2, "Acme Guide"), ("r", "d", 2, None)], "repo_id string, doc_id string, page int, line_text string")
    return sections, pages, furniture


def test_findings(spark, document):
    sections, pages, furniture = document
    streams = ft.page_streams(pages, furniture)
    assert sorted((r["page"], len(r["words"]), r["start"]) for r in streams.collect()) == [(1, 12, 0), (2, 14, 12), (4, 0, 26), (9, 0, 26)]
    assert rows(ft.unverifiable(sections, streams)) == [("r", "d", "4-x", 4)]
    assert sorted(r[2:] for r in rows(ft.title_places(sections, streams))) == [("1", 0), ("2", 19)]
    content = sorted(r[2:] for r in rows(ft.content_findings(sections, streams)))
    assert content == [("1", "l3", 1, "words the pages never had at all"), ("1", "pdf", 2, "this passage is lost from every text")]
    assert rows(ft.break_findings(sections, pages)) == [("r", "d", "1", 0, 1, "brown fox jumps over", "the lazy dog today")]
    assert rows(ft.order_findings(sections, streams)) == [("r", "d", "3", 1, "2")]
    assert [r[2:] for r in rows(ft.fallback_findings(sections))] == [("4-x", 4, "4 x")]
    kinds = sorted((r["section_id"], r["kind"]) for r in ft.check_documents(*document).collect())
    assert kinds == [("1", "break"), ("1", "content"), ("1", "content"), ("3", "order"), ("4-x", "fallback"), ("4-x", "unverifiable")]
    none = ft.check_documents(sections.limit(0), pages.limit(0), furniture.limit(0))
    assert none.count() == 0


def test_outline(spark, document):
    outline = spark.createDataFrame([("r", "d", "1"), ("r", "d", "7.1"), ("r", "d", "7.1.1")], "repo_id string, doc_id string, section_id string")
    assert sorted(r[2:] for r in rows(ft.outline_gaps(document[0], outline))) == [("2", "extra"), ("3", "extra"), ("4-x", "extra"), ("5", "extra"), ("7.1", "missing")]


def test_section_ids(spark):
    want = {
        "Chapter 3: Scope": ("3", "Scope"), "CHAPTER 4": ("4", "CHAPTER 4"), "Appendix. Signals": ("appendix", "Signals"), "Appendix B.2 - Forms": ("appendix-b.2", "Forms"),
        "attachment 1": ("attachment-1", "attachment 1"), "5.0 Start": ("5", "Start"), "5.1.0 Deep": ("5.1.0", "Deep"), "5.15": ("5.15", ""), "123": None, "7 Rules": ("7", "Rules"), "Notes": None, "appendixes": None, " 2.1.  Two  words ": ("2.1", "Two words"), "": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {t: tuple(h) if h else None for t, h in rows(df.select("t", sectioning.section_ids(F.col("t"))))} == want
    german = sectioning.Headings(chapter=r"^kapitel\s+(\d+)\s*[.:]?\s*(.*)$")
    assert tuple(one(spark, "Kapitel 2. Ziel", sectioning.section_ids(F.col("t"), german))[0]) == ("2", "Ziel")


def test_noise(spark):
    items = [("d", 0, 1, "heading", "Run  line"), ("d", 1, None, "heading", "Run line"), ("d", 2, 2, "heading", "Run line"), ("d", 3, 3, "heading", "Run line"), ("d", 4, 3, "heading", "1.2 Id"), ("d", 5, 3, "heading", "Note:"), ("d", 6, 3, "text", "x")]
    df = spark.createDataFrame(items, "d string, o int, p int, kind string, t string")
    assert rows(sectioning.repeated_headings(df, ["d"], "o", "p", "t")) == [("d", "Run line", 3)]
    for text, n, reason in (("Table 5-6", 1, "caption"), ("Table of Contents", 1, None), ("Used On: x Length: 4", 1, "label line"), ("Run", 3, "repeated"), ("Run", 2, None)):
        assert one(spark, text, sectioning.noise_reason(F.col("t"), F.lit(n)))[0] == reason


def test_split_headings(spark):
    schema = "k int, t string, l array<struct<text: string, size: double>>, f array<string>"
    cases = [
        (1, "Big title small body", [("Big title", 14.0), ("small body", 9.0)], []),
        (2, "Wrapped title", [("Wrapped", 14.0), ("title", 14.0)], []),
        (3, "Title", [("Title", 14.0), ("Acme Acme", 9.0)], ["Acme", "7"]),
        (4, "Other text", [("Big title", 14.0), ("small", 9.0)], []),
        (5, "Acme body", [("Acme", 14.0), ("body", 9.0)], ["Acme"]),
        (6, "One", [("One", 14.0)], []),
        (7, "Title www.x.y", [("Title", 14.0), ("www.x.y", 14.0)], []),
        (8, None, None, None),
    ]
    got = {r["k"]: (r["heading"], r["body"]) for r in sectioning.split_headings(spark.createDataFrame(cases, schema), "k", "t", "l", "f").collect()}
    assert got == {1: ("Big title", ["small body"]), 3: ("Title", []), 5: ("Acme", ["body"]), 7: ("Title", ["www.x.y"])}


def test_uncarried(spark):
    items = spark.createDataFrame([("d", 1, "a b"), ("d", 2, "c  d"), ("d", 3, "zz"), ("d", 4, " "), ("e", 5, "a b")], "d string, i int, t string")
    units = spark.createDataFrame([("d", "ab\nx c\nd y")], "d string, b string")
    assert sorted(rows(sectioning.uncarried(items, units, ["d"], "i", "t", "b"))) == [("d", 3), ("e", 5)]


def test_guards(spark):
    df = spark.createDataFrame([("a-1.b",), ("../x",), ("a/b",), ("..",), ("a\n",), ("",), (None,)], "i string")
    assert rows(records.safe_doc_ids(df, "i")) == [("a-1.b",)]
    assert records.level(" L3 ") == "l3"
    with pytest.raises(ValueError):
        records.level("l4")
    with pytest.raises(ValueError):
        records.level("")


def test_pending_and_chapters(spark):
    key = "repo_id string, doc_id string, section_id string"
    sections = spark.createDataFrame([("r", "d", "1", "pending", "ch1"), ("r", "d", "2", " Pending", "ch2"), ("r", "d", "3", "reviewed", "ch1"), ("r", "g", "1", "pending", "ch1")], f"{key}, status string, file string")
    docs = spark.createDataFrame([("r", "g", ["generated"]), ("r", "d", None)], "repo_id string, doc_id string, tags array<string>")
    found, missing = records.pending(sections, docs, spark.createDataFrame([("r", "d", "1")], key))
    assert [r[2] for r in rows(found)] == ["1"] and [r[2] for r in rows(missing)] == ["2"]
    assert records.of_chapters(sections, ["ch2"]).count() == 1 and records.of_chapters(sections, None).count() == 4


def test_small_aggregates(spark):
    df = spark.createDataFrame([("t", "m2", None), ("t", "m1", None), ("t", "m3", "base"), ("t", "m2", None)], "k string, m string, a string")
    assert rows(records.set_aggregates(df, ["k"], "m", "a", F.col("a").isNotNull())) == [("t", ["m1", "m2"], {"m3": "base"})]
    cover = spark.createDataFrame([("a", "s", "f", "complete", None), ("a", "s", "f", "complete", "x.py"), ("b", "s", "f", "complete", None), ("c", "s", "f", "not scanned", None)], "area string, scope string, framework string, status string, site string")
    assert sorted(rows(records.coverage_rows(cover))) == [("a", "s", "f", "partial", "x.py"), ("b", "s", "f", "complete", ""), ("c", "s", "f", "not scanned", "")]
    ops = spark.createDataFrame([("get", "/b", ["x", "y"]), ("get", "/a", ["x"]), ("put", "/c", None), ("put", "/d", [])], "method string, path string, tags array<string>")
    assert {t: [tuple(o) for o in l] for t, l in rows(records.by_first_tag(ops))} == {"x": [("/a", "get"), ("/b", "get")], "surface": [("/c", "put"), ("/d", "put")]}
    recs = spark.createDataFrame([("t", "c", "prisma", "int"), ("t", "c", "sql", "bigint"), ("t", "d", "prisma", "text")], "tbl string, col string, reader string, type string")
    assert sorted(rows(records.merged_records(recs, ["tbl", "col"], "reader", ["sql", "prisma"], ["type"]))) == [("t", "c", "bigint", "sql", ["type"]), ("t", "d", "text", "prisma", [])]
    facts = spark.createDataFrame([("1", "b"), ("1", "a"), ("1", "b")], "k string, fact string")
    assert rows(records.merged_facts(facts, ["k"])) == [("1", ["a", "b"])]
    a, b = (spark.createDataFrame(x, "repo_id string, digest string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    docs = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "repo_id string, doc_id string")
    assert sorted(rows(records.digest_issues(a, b, docs))) == [("digest", "b"), ("doc-id", "x"), ("gone", "c"), ("unrecorded", "d")]
    finds = spark.createDataFrame([("b", 1), (None, 2), ("a", 10), ("a", 9)], "p string, n int")
    assert rows(finds.orderBy(*records.finding_order(["p", "n"]))) == [(None, 2), ("a", 10), ("a", 9), ("b", 1)]


def test_facts_by_kind(spark):
    table = "| Method | PATH |\n|---|---|\n| get | /a/:id/ |\n| post | /b\\|c |"
    df = spark.createDataFrame(
        [
            ("db.users", "| Column | Type | PK |\n|--|--|--|\n| id | int | Yes |\n| n | text | no |", ""), ("api.x", table, ""), ("route.x", table, ""), ("page.x", "| path |\n|--|\n| /p/{x} |", ""),
            ("job.x", "| Name | Schedule |\n|--|--|\n| j | daily |", ""), ("int.x", "| Env key |\n|--|\n| K |\n| |", ""), ("cmd.x", "Primary: `make it`", ""), ("dep.x", "**Frameworks**: a, b", ""), ("svc.x", "", "one\n two"), ("svc.y", "", "one two"), ("misc", table, ""), ("db.none", "no table", None),
        ],
        "sid string, l2 string, l3 string",
    )
    got = {}
    for sid, _, _, kind, value in rows(records.section_facts(df, "sid", "l2", "l3")):
        got.setdefault(sid, set()).add((kind, value))
    assert got["db.users"] == {("column", "id"), ("column", "n"), ("column_type", "id:int"), ("column_type", "n:text"), ("pk", "id")}
    assert got["api.x"] == {("route", "get /a/:id/"), ("route", "post /b|c")} and got["route.x"] == {("route", "GET /a/{}"), ("route", "POST /b|c")}
    assert got["page.x"] == {("page", "/p/{}")} and got["job.x"] == {("job", "j @ daily")} and got["int.x"] == {("env_key", "K")}
    assert got["cmd.x"] == {("command", "make it")} and got["dep.x"] == {("framework", "a"), ("framework", "b")}
    assert got["svc.x"] == got["svc.y"] and not {"misc", "db.none"} & set(got)


def test_replies_ages_and_cells(spark):
    reply = 'Sure:\n```json\n{"x": "1"}\n```\n{"summary": "a } b", "body": "c", "z": "d"} {"summary": "no", "body": "e"}'
    assert one(spark, reply, records.json_reply(F.col("t"), ["summary", "body"]))[0] == {"summary": "a } b", "body": "c"}
    assert one(spark, "none {", records.json_reply(F.col("t"), ["summary"]))[0] is None
    assert [one(spark, "", records.age_label(F.lit(s).cast("double")))[0] for s in (12.7, None)] == ["~12s", "unknown"]
    marks = spark.createDataFrame([("p", 1, 0, 0, 4, 4), ("p", 2, 12, 12, 14, 14), ("p", 3, 90, 0, 92, 2)], "p string, m int, x0 int, y0 int, x1 int, y1 int")
    bands = spark.createDataFrame([("p", 0, 0, 10), ("p", 1, 10, 20)], "p string, n int, a int, b int")
    got = records.in_cell(marks, bands.toDF("p", "row", "top", "bottom"), bands.toDF("p", "col", "left", "right"), ["p"])
    assert {(r["m"], r["row"], r["col"]) for r in got.collect()} == {(1, 0, 0), (2, 1, 1)}


def test_table_differences(spark):
    t = lambda *tables: spark.createDataFrame([(i, n, r.split("/")) for i, n, r in tables], "id int, at int, rows array<string>")
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    condensed, full = t((1, 0, "a"), (2, 0, "a"), (2, 5, "b"), (3, 0, "a"), (3, 4, "a"), (4, 0, "q")), t((1, 0, "a"), (2, 0, "b"), (2, 9, "a"), (3, 0, "a"), (3, 7, "c/d"), (5, 0, "e"))
    assert sorted(rows(records.table_differences(ids, condensed, full))) == [(2, "reordered", 1), (3, "extra", 1), (3, "missing", 1), (5, "missing", 1)]
