"""Operators that SQL doesn't check, against plain Python versions, and odd inputs."""

import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from quern.functions import plugins, text as tx
from quern.operators import catalog, differences, graphs, markdown, matching, ordered, quality, search, usage
from quern.streaming import limits

RNG = random.Random(5)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_limiter_equals_queue_per_key(spark):
    events = [(RNG.choice(["hot"] * 6 + ["a", "b", None]), RNG.randint(0, 400), i) for i in range(600)]
    df = spark.createDataFrame(events, "k string, t long, e long").select("k", F.timestamp_seconds("t").alias("t"), "e")
    want, recent = {}, {}
    for k, t, e in sorted(events, key=lambda x: (x[1], x[2])):
        q = recent.setdefault(k, deque())
        while q and q[0] <= t - 60:
            q.popleft()
        want[e] = len(q) < 3
        if want[e]:
            q.append(t)
    assert {e: ok for _, e, ok in rows(limits.limited(df, "k", "t", "e", 3, 60))} == want
    assert limits.limited(df.limit(0), "k", "t", "e", 3, 60).count() == 0


def test_unique_names_skip_taken(spark):
    df = spark.createDataFrame([("d", 1, "a"), ("d", 2, "a-2"), ("d", 3, "a"), ("d", 4, "a"), ("e", 1, "a")], "d string, o int, n string")
    assert sorted(rows(ordered.unique_names(df, ["d"], "o", "n"))) == [("d", 1, "a", "a"), ("d", 2, "a-2", "a-2"), ("d", 3, "a", "a-3"), ("d", 4, "a", "a-4"), ("e", 1, "a", "a")]


def test_as_of_takes_file_order_not_time(spark):
    left = spark.createDataFrame([("s", 5, "x"), ("s", 20, "y"), ("s", 1, "z"), ("t", 9, "w")], "k string, t int, id string")
    points = spark.createDataFrame([("s", 5, 1, "first"), ("s", 3, 2, "later in file"), ("s", 20, 0, "earlier in file")], "k string, t int, p int, v string")
    assert {r[2]: r[3] for r in rows(ordered.as_of(left, points, ["k"], "t", "p", "v", "v"))} == {"x": "later in file", "y": "later in file", "z": None, "w": None}


def test_collapse_keeps_first_identity_and_largest_usage(spark):
    df = spark.createDataFrame([("c", 1, 5, "first", "p"), ("c", 2, 9, "second", "q"), ("c", 3, 9, "third", "r"), ("d", 4, None, "only", "s")], "c string, o int, n int, who string, use string")
    assert sorted(rows(ordered.collapse_calls(df, ["c"], "o", "n", ["who"], ["use"]))) == [("c", "first", "q", 3), ("d", "only", "s", 1)]


def test_open_failures(spark):
    kinds = [(k, i, RNG.choice("fcx")) for k in "ab" for i in range(30)] + [("z", 1, "c")]
    df = spark.createDataFrame(kinds, "k string, i int, what string")
    want = {}
    for k, i, what in kinds:
        if what == "c":
            want.pop(k, None)
        elif what == "f":
            first, n = want.get(k, (i, -1))
            want[k] = (first, n + 1)
    assert {r[0]: r[1:] for r in rows(ordered.open_failures(df, ["k"], ["i"], F.col("what") == "f", F.col("what") == "c"))} == want


def test_fences_and_units(spark):
    text = "# t\n## 1 One\nbody\n```\n## 2 Two\n````\n~~~\n## 1 Again \nx\n##  \n## 3\n| a | b\\|c |\n|---|--:|\n| 1 | 2  3 |"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "~~~~\na\n~~~\nb\n~~~~~\nc")], "id int, t string")
    assert [r[1:] for r in sorted(rows(markdown.units(df, "id", "t")))][:2] == [(0, "1", "One", 0, "## 1 One\nbody\n```"), (1, "2", "Two", 0, "## 2 Two\n````\n~~~")]
    assert [(r[2], r[4]) for r in sorted(rows(markdown.units(df, "id", "t")))] == [("1", 0), ("2", 0), ("1", 1), ("3", 0)]
    assert [r[2] for r in sorted(rows(markdown.unfenced_lines(df, "id", "t"))) if r[0] == 4] == ["c"]
    inner = spark.createDataFrame([(1, "## 1 A\nx\n### 1.1 B\ny\n### 1.2 C\n## 1 D\nz")], "id int, t string")
    asked = spark.createDataFrame([(1, "1", 0), (1, "1", 1), (1, "1.1", 0), (1, "9", 0)], "id int, section_id string, occurrence int")
    assert sorted(r[1:] for r in rows(markdown.slices(inner, "id", "t", asked))) == [("1", 0, "## 1 A\nx\n### 1.1 B\ny\n### 1.2 C"), ("1", 1, "## 1 D\nz"), ("1.1", 0, "### 1.1 B\ny"), ("9", 0, None)]
    two = spark.createDataFrame([(1, "| a |\n|---|\n| b |\n\n| c |\n```\n| d |\n```")], "id int, t string")
    assert sorted(rows(markdown.tables(two, "id", "t"))) == [(1, 0, ["a", "b"]), (1, 4, ["c"])]
    cells = spark.createDataFrame([(1, "| a | b\\|c |\n|---|--:|\n| 1 | 2  3 |\n```\n| no |\n```")], "id int, t string")
    assert sorted(rows(markdown.table_cells(cells, "id", "t"))) == [(1, 0, 0, "a"), (1, 0, 1, "b|c"), (1, 2, 0, "1"), (1, 2, 1, "2 3")]


def plain_unfenced(text):
    fence, out = "", []
    for at, line in enumerate(text.replace("\r\n", "\n").split("\n")):
        mark = re.match(r"(`{3,}|~{3,})", line.strip(" \t"))
        if mark:
            fence = mark[1] if not fence else "" if mark[1][0] == fence[0] and len(mark[1]) >= len(fence) else fence
        elif not fence:
            out.append((at, line))
    return out


def test_fences_equal_a_walk(spark):
    lines = ["```", "````", "~~~", "  ``` x", "a", "", "b ``` c", "``", "~~~~~"]
    texts = [RNG.choice(["\n", "\r\n"]).join(RNG.choices(lines, k=RNG.randint(0, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for i, at, line in rows(markdown.unfenced_lines(df, "id", "t")):
        got.setdefault(i, []).append((at, line))
    assert got == {i: w for i, t in enumerate(texts) if (w := plain_unfenced(t))}


def test_prose_and_images(spark):
    df = spark.createDataFrame([("# h\none  \n\n\n\n| t |\n<!-- c -->\n![x](y)\ntwo\nFigure: z\n[table omitted]",)], "t string")
    assert df.select(markdown.prose(F.col("t"))).first()[0] == "one\n\ntwo"
    images = spark.createDataFrame([("![a b](x) ![a b](y)\n| ![no](z) |\n![](q) ![c](r)",)], "t string")
    assert images.select(markdown.image_texts(F.col("t"))).first()[0] == ["a b", "c"]


def test_transcribed_tables(spark):
    l3 = "| Code | Len |\n|---|---|\n| alpha | 12.5 |\n| beta | gamma ray |"
    df = spark.createDataFrame([(1, "We have Code, alpha, beta and gamma ray. Else.", l3), (2, "alphabet Code beta", l3), (3, None, None)], "id int, body_l2 string, body_l3 string")
    assert rows(quality.transcribed_tables(df)) == [(1, 0, 4)]
    again = spark.createDataFrame([(1, "The alphabet and alpha, beta, C\\E+ and gamma.", "| alpha | beta | gamma | C\\E+ |"), (2, "alpha, beta, gamma, delta", "```\n| alpha | beta | gamma | delta |\n```")], "id int, body_l2 string, body_l3 string")
    assert rows(quality.transcribed_tables(again)) == [(1, 0, 4)]


def test_gate_without_rows(spark):
    empty = spark.createDataFrame([], "id long, title string, summary string, body_l2 string, body_l3 string")
    assert quality.build_gate(empty).count() == 0


def test_graph_with_cycle(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (5, 6), (6, 5), (7, 6), (8, 99), (9, 9)], "node int, needs int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "node int")
    assert dict(rows(graphs.waves(nodes, edges))) == {1: 1, 2: 2, 3: 3, 4: 4, 8: 1}
    assert set(rows(graphs.cycle_groups(edges))) == {(5, 6), (6, 6), (9, 9)}
    assert (4, 1) in rows(graphs.closure(edges))
    assert sorted(rows(graphs.closure(edges, nodes.where("node IN (3, 7)")))) == [(3, 1), (3, 2), (7, 5), (7, 6)]
    paths = spark.createDataFrame([(2, "x"), (4, "x"), (5, "y"), (8, "y"), (8, "x")], "node int, path string")
    assert sorted(rows(graphs.conflicts(paths, edges))) == [(2, 8), (4, 8), (5, 8)]
    assert sorted(rows(graphs.conflict_counts(paths, edges))) == [("x", 2, 1), ("x", 4, 1), ("x", 8, 2), ("y", 5, 1), ("y", 8, 1)]
    assert graphs.waves(nodes.limit(0), edges.limit(0)).count() == 0


def reaches(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for n in after:
        todo, seen = list(after[n]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out[n] = seen
    return out


def test_cycles_of_random_graphs(spark):
    for many in (12, 25, 40):
        edges = [(RNG.randint(1, 20), RNG.randint(1, 20)) for _ in range(many)]
        reach = reaches(edges)
        want = {(n, max(m for m in reach if n in reach[m] and m in reach[n])) for n in reach if n in reach[n]}
        got = rows(graphs.cycle_groups(spark.createDataFrame(edges, "node int, needs int")))
        assert len(got) == len(set(got)) and set(got) == want


def test_bm25_against_formula(spark):
    import math

    docs = [(1, "red red fox", "a"), (2, "blue fox", "red"), (3, "", None), (4, "green", "x y z")]
    df = spark.createDataFrame(docs, "id int, a string, b string")
    asked = spark.createDataFrame([(1, "red fox red"), (2, "none"), (3, None)], "query_id int, text string")
    got = {(q, i): s for q, i, s in rows(search.bm25(search.index_of(df, "id", {"a": 2.0, "b": 1.0}), asked))}
    words = {i: ((a or "").split(), (b or "").split()) for i, a, b in docs}
    average = sum(len(a) + len(b) for a, b in words.values()) / 4
    want = {}
    for i, (a, b) in words.items():
        for t in ("red", "fox", "red"):
            f = 2 * a.count(t) + b.count(t)
            n = sum(t in x or t in y for x, y in words.values())
            idf = max(math.log((4 - n + 0.5) / (n + 0.5)), 0) or 1e-6
            if f:
                want[1, i] = want.get((1, i), 0) + idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(a) + len(b)) / average))
    assert got == pytest.approx(want)


def test_budget_prefix(spark):
    for _ in range(10):
        sizes, budget = [RNG.randint(0, 9) for _ in range(12)], RNG.randint(1, 30)
        df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "query_id int, rank int, s int")
        kept, used = [], 0
        for i, s in enumerate(sizes):
            if i and (used >= budget or used + s > budget):
                break
            kept.append(i)
            used += s
        assert sorted(r["rank"] for r in search.within_budget(df, F.col("s"), budget).collect()) == kept


def test_grouping_keeps_nulls_apart(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "x", None), (None, None, 2)], "p string, q string, v int")
    got = {(d, k): (n, v) for d, k, n, v in rows(usage.by_dimensions(df, ["p", "q"], {"v": "v"}))}
    assert got == {("p", "a"): (1, 1), ("p", "unattributed"): (2, 2), ("q", "x"): (1, None), ("q", "unattributed"): (2, 3), ("total", ""): (3, 3)}


def test_share_falls_back(spark):
    df = spark.createDataFrame([(True, 0, 3), (False, 0, 1)], "p boolean, cost int, tokens int")
    assert rows(usage.share_of(df, "p", ["cost", "tokens"])) == [("tokens", 75.0)]
    assert rows(usage.share_of(df.limit(0), "p", ["cost", "tokens"])) == [("none", 0.0)]


def test_parents(spark):
    known = spark.createDataFrame([("d", "3"), ("d", "3.2"), ("d", "5.6")], "d string, s string")
    asked = spark.createDataFrame([("d", "3.2.1"), ("d", "5.6-note"), ("d", "3"), ("e", "3.1")], "d string, s string")
    assert dict((r[1], r[2]) for r in rows(catalog.parent_of(asked, known, ["d"], "s", "s"))) == {"3.2.1": "3.2", "5.6-note": "5.6", "3": None, "3.1": None}


def test_kinds_by_title(spark):
    docs = [("a", "x", "Work — plan", ["plan", "generated"]), ("b", "x", "Work — tests", ["generated", "test"]), ("c", "x", "Work — plan", ["plan"]), ("d", "x-svc", "t", ["code"]), ("e", "civil-code", "t", None), ("f", "x", "Work (Plan)", ["plan", "generated"])]
    df = spark.createDataFrame(docs, "repo_id string, doc_id string, title string, tags array<string>")
    assert dict(rows(catalog.inferred_kinds(df))) == {"a": "ba", "b": "tester", "c": "kb", "d": "dev", "e": "kb", "f": "kb"}
    own = spark.createDataFrame([("a", "x", "1"), ("c", "x", "hist.1"), ("c", "x", "2")], "repo_id string, doc_id string, section_id string")
    assert rows(catalog.without_machine_sections(own, df)) == [("c", "x", "2")]


def test_siblings_parts_and_stable_pages(spark):
    heads = [(1, 0, "5.2"), (1, 1, "6"), (1, 2, "5.10"), (1, 3, "5.9"), (1, 4, "5.1"), (2, 0, "1.2"), (2, 1, "2.1"), (2, 2, "x")]
    df = spark.createDataFrame(heads, "page int, at int, sid string")
    assert rows(ordered.sibling_inversions(df, ["page"], [F.col("at")], "sid")) == [(1, "5.10", "5.9")]
    items = spark.createDataFrame([("d", 0, None), ("d", 1, 3), ("d", 2, None), ("d", 3, 7), ("d", 4, 4), ("e", 0, 1)], "doc string, at int, page int")
    parts = spark.createDataFrame([("d", 2, "A"), ("d", 5, "B"), ("d", 9, "C"), ("e", 4, "Z")], "doc string, page int, part string")
    assert [r["part"] for r in ordered.part_of_page(items, parts, ["doc"], "at", "page", "part").orderBy("doc", "at").collect()] == ["A", "A", "A", "B", "B", "Z"]
    assert [(r["at"], r["place"]) for r in ordered.stable_by_page(items.where("doc = 'd'"), ["doc"], [F.col("at")], "page", "place").orderBy("at").collect()] == [(0, 1), (1, 2), (2, 3), (3, 5), (4, 4)]


def test_kinds_and_tags(spark):
    assert catalog.kinds([" KB", "dev", "kb"]) == ["dev", "kb"]
    with pytest.raises(ValueError):
        catalog.kinds(["other"])
    tags = spark.createDataFrame([("r", "A "), ("s", "b")], "repo string, tag string")
    own = spark.createDataFrame([("r", 1), ("s", 2), ("t", 3)], "repo string, id int")
    assert rows(search.tagged(own, ["repo"], tags, [" a"])) == [("r", 1)]
    with pytest.raises(ValueError):
        search.tagged(own, ["repo"], tags, [str(i) for i in range(101)])


def test_text_functions(spark):
    df = spark.createDataFrame([("https://u:p@h/x", "/a/:id/b/{x}/<y>/[z]/", "Éa_b  Ctề!", "x<!-- a\n-->y")], "u string, r string, t string, h string")
    got = df.select(tx.redact_url(F.col("u")), tx.route_shape(F.col("r")), tx.slug(F.col("t")), tx.slug_id(F.col("t")), tx.strip_comments(F.col("h")), tx.tokens(F.col("t")), tx.natural_key(F.lit("1.10.x")), tx.slug_id(F.lit("Straße der Maße"))).first()
    assert tuple(got) == ("https://h/x", "/a/{}/b/{}/{}/{}", "ea-b-cte", "éa-b-ctề", "xy", ["éa", "b", "ctề"], [1, 10, None], "straße-der-maße")


def test_snippet(spark):
    df = spark.createDataFrame([("a" * 200 + " Word " + "b" * 200,), ("word",), ("none",)], "t string")
    got = [r[0] for r in df.select(tx.snippet(F.col("t"), F.array(F.lit("zzz"), F.lit("word")), 10)).collect()]
    assert got == ["…" + "a" * 9 + " Word " + "b" * 9 + "…", "word", None]
    ends = spark.createDataFrame([("x  word   y",)], "t string").select(tx.snippet(F.col("t"), F.array(F.lit("word")), 2))
    assert ends.first()[0] == "…word…"


def test_pattern_facts(spark):
    df = spark.createDataFrame([(1, "FN-7 FN-7 No. 3 Số 4 xSố 5 https://a.b/c)"), (2, None), (3, "")], "id int, t string")
    assert sorted(rows(plugins.pattern_facts(df, "id", "t"))) == [(1, "form", "FN-7", 2), (1, "reference", "3", 1), (1, "reference", "4", 1), (1, "url", "https://a.b/c", 1)]


def test_facts_function(spark):
    plugins.register(spark, "facts_test", (plugins.pattern_extractor("n", r"\d+"),))
    assert sorted(rows(spark.sql("SELECT f.* FROM VALUES ('1 22 1'), (NULL) v(t), LATERAL facts_test(v.t) f"))) == [("n", "1", 2), ("n", "22", 1)]


def test_alignment_and_bags(spark):
    df = spark.createDataFrame([(1, "a b c", "a x c d"), (2, None, "")], "id int, a string, b string")
    assert sorted(rows(matching.alignments(df, "id", "a", "b"))) == [(1, 2, 1, 0, 1), (2, 0, 0, 0, 0)]
    old, new = (spark.createDataFrame([(x,) for x in v], "x string") for v in ("aab", "abbc"))
    assert sorted(rows(differences.bag_difference(old, new, ["x"]))) == [("a", 1, 0), ("b", 0, 1), ("c", 0, 1)]
