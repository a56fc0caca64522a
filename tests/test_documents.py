"""Headings, layout, references and merged checks."""

from pyspark.sql import functions as F

from quern.operators import documents as d


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tree_and_folding(spark):
    text = "# A\nxx\n## B\n" + "y" * 900 + "\n### C\nz\n#### D\nw\n```\n# no\n```\n## E\nshort\n# F"
    df = spark.createDataFrame([(1, text), (2, None), (3, "none")], "id int, t string")
    tree = d.heading_tree(df, "id", "t")
    assert [(r[2], r[3], r[4]) for r in sorted(rows(tree))] == [(1, "A", None), (2, "B", 0), (3, "C", 2), (4, "D", 4), (2, "E", 0), (1, "F", None)]
    folded = {r["title"]: r["folded"] for r in d.folded(tree, "id").collect()}
    assert folded == {"A": False, "B": False, "C": False, "D": True, "E": True, "F": False}
    assert not {r["title"]: r["folded"] for r in d.folded(tree, "id", most=4).collect()}["E"]


def test_orphans(spark):
    found = d.heading_ids(spark.createDataFrame([(1, "## 1 One\n## Own\n## 9 Nine\n```\n## 8 x\n```")], "id int, t string"), "id", "t")
    known = spark.createDataFrame([(1, "1")], "id int, section_id string")
    assert {r["section_id"] for r in d.orphan_headings(found, known, ["id"], True).collect()} == {"9"}
    assert {r["section_id"] for r in d.orphan_headings(found, known, ["id"], False).collect()} == {"9", "Own"}


def test_body_under(spark):
    df = spark.createDataFrame([("# A\n## B  \n\nbody\n### C\nmore\n## D\nx",), ("# A",), (None,)], "t string")
    assert [r[0] for r in df.select(d.body_under(F.col("t"), "## B")).collect()] == ["body\n### C\nmore", None, None]


def test_layout(spark):
    items = [(1, 0, 60, 10, 100, 20), (1, 1, 0, 10, 40, 20), (1, 2, 0, 30, 100, 40), (1, 3, 0, 50, 40, 60), (1, 4, 60, 45, 100, 55), (1, 5, 0, 22, 40, 28)]
    df = spark.createDataFrame(items, "page int, item int, x0 int, y0 int, x1 int, y1 int")
    assert [r["item"] for r in d.layout_order(df, ["page"]).orderBy("place").collect()] == [1, 5, 0, 2, 3, 4]


def test_references(spark):
    df = spark.createDataFrame([("a/b:doc-1  §4.2",), ("doc §x",), ("doc x",), ("no",), (None,)], "r string")
    assert [r[1:] for r in rows(d.parsed_references(df, "r"))] == [("a/b", "doc-1", "4.2"), (None, "doc", "x"), (None, "doc", "x"), (None, None, None), (None, None, None)]


def test_split_paragraphs(spark):
    r = spark.createDataFrame([(1, "The quick brown\n\nfox jumps over it.\n\nNew one here\n\n| t |"), (2, None)], "k int, t string")
    p = spark.createDataFrame([(1, "See: the quick brown fox jumps over it. New one"), (1, None)], "k int, page_text string")
    assert rows(d.split_paragraphs(r, p, ["k"], "t")) == [(1, 0, "the quick brown", "fox jumps over")]


def test_usage_blocks(spark):
    blocks = ['{"input_tokens": 3, "cache_creation": {"ephemeral_1h_input_tokens": 2}, "server_tool_use": {"web_search_requests": 1}}', '{"cache_creation_input_tokens": 9, "output_tokens": "x"}', "bad", None]
    df = spark.createDataFrame([(b,) for b in blocks], "b string")
    got = rows(df.select(*[c.alias(n) for n, c in d.usage_counts(F.col("b")).items()]))
    assert got == [(3, 0, 0, 0, 2, 1), (0, 0, 0, 9, 0, 0), (0,) * 6, (0,) * 6]


def test_stale_days_and_bits(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("",), (None,), ("soon",)], "p string")
    assert [r[0] for r in df.select(d.stale_days(F.lit("2026-01-31").cast("date"), F.col("p"))).collect()] == [30, 36500, 36500, 36500]
    assert spark.range(1).select(d.bits_apart(F.lit(5), F.lit(3))).first()[0] == 2


def test_merged_checks(spark):
    old = spark.createDataFrame([("a", "1", True), ("b", "1", True), ("c", "1", True)], "k string, digest string, ok boolean")
    new = spark.createDataFrame([("a", "1", False), ("b", "2", False), ("d", "1", False)], "k string, digest string, ok boolean")
    assert sorted(rows(d.merged_checks(old, new, ["k"], ["digest"], ["ok"]))) == [("a", "1", True), ("b", "2", False), ("c", "1", True), ("d", "1", False)]
