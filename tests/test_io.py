"""Files, sinks and streams."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from quern.sources import files, sinks, yaml_files
from quern.streaming import limits, refresh


@pytest.fixture
def hub(tmp_path):
    for repo, meta in (("a", True), ("mid/b", True), ("c", False)):
        folder = tmp_path / repo / "docs"
        folder.mkdir(parents=True)
        (tmp_path / repo / "index.yaml").write_text("docs: []")
        if meta:
            (tmp_path / repo / "_meta.yaml").write_text("kind: kb")
        (folder / "d.md").write_text("## 1 One\nshort\n## 2 Two\nx\n")
        (folder / "d.raw.md").write_text("## 1 One\nlong text\n")
    return tmp_path


def test_federation(spark, hub):
    listed = files.listing(spark, str(hub))
    assert listed.count() == 9
    found = files.entries(spark, str(hub))
    assert {r[0] for r in found.collect()} == {"a", "mid/b"}
    held = files.owned(listed, found)
    assert held.groupBy("repo_id").count().where("count = 3").count() == 2
    before = files.stat_fingerprints(held)
    now = before.where("repo_id <> 'a'").unionByName(before.where("repo_id = 'a'").withColumn("digest", F.lit("x"))).unionByName(before.limit(1).withColumn("repo_id", F.lit("new")))
    assert {tuple(r) for r in files.changed_repos(now, before).collect()} == {("a", "read"), ("new", "read")}
    assert {tuple(r) for r in files.changed_repos(before.limit(0), before).collect()} == {("a", "drop"), ("mid/b", "drop")}


def test_markdown_files(spark, hub):
    got = files.sections_of(files.markdown_files(spark, str(hub)))
    assert {(r["stem"], r["section_id"], r["body_l2"], r["body_l3"]) for r in got.where("stem LIKE 'a/%'").collect()} == {
        ("a/docs/d", "1", "## 1 One\nshort", "## 1 One\nlong text"),
        ("a/docs/d", "2", "## 2 Two\nx", ""),
    }
    import hashlib

    assert dict(map(tuple, files.manifest(spark, str(hub)).collect()))["c/index.yaml"] == hashlib.sha256(b"docs: []").hexdigest()


def test_ledgers(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": "1", "n": 1}\n{"id": "2"}\n')
    bad.write_text('{"id": "1", "n": 9}\nnot json\n{"id": "3", "n": 3}\n')
    assert files.ledger(spark, str(good), "id string, n int").count() == 2
    with pytest.raises(Exception):
        files.ledger(spark, str(bad), "id string, n int").collect()
    lenient = files.ledger(spark, str(bad), "id string, n int", strict=False).drop("_file")
    both = files.first_of_each([files.ledger(spark, str(good), "id string, n int").drop("_file"), lenient], ["id"])
    assert sorted(map(tuple, both.collect())) == [("1", 1), ("2", None), ("3", 3)]


@pytest.mark.skipif(yaml_files.yaml is None, reason="no YAML parser")
def test_yaml(spark):
    df = spark.createDataFrame([("a", "kind: kb\nn: 3"), ("b", "- 1"), ("c", "x: ["), ("d", None)], "path string, text string")
    got = {r["path"]: (r["doc"], r["error"]) for r in yaml_files.parse_yaml(df, "text", "kind string, n int").collect()}
    assert tuple(got["a"][0]) == ("kb", 3) and got["a"][1] is None
    assert all(got[k][0] is None and got[k][1] for k in "bcd")


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "r string, n int"), path, "r")
    sinks.overwrite_partitions(spark.createDataFrame([("a", 7)], "r string, n int"), path, "r")
    assert sorted((r["r"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 7), ("b", 2)]
    ledger = str(tmp_path / "l")
    for _ in range(2):
        sinks.append_new(spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "k string, n int"), ledger, ["k"])
    assert spark.read.parquet(ledger).count() == 2
    assert "| x |" in sinks.markdown_report(spark.createDataFrame([("x",)], "k string"), "T")
    with pytest.raises(ValueError):
        sinks.markdown_report(spark.range(5), "T", 3)


def test_refresh_stream_equals_batch(spark, tmp_path):
    source, table, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    batches = [[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("c", 1, "w"), ("a", 2, "z")]]
    for n, rows in enumerate(batches):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip("kov", r))) for r in rows))
        query = refresh.refresh(spark.readStream.schema("k string, o int, v string").json(str(source)), table, mark, ["k"], "o")
        query.awaitTermination(60)
        query.stop()
    want = [("a", 2, "z"), ("b", 1, "y"), ("c", 1, "w")]
    rows = lambda: sorted((r["k"], r["o"], r["v"]) for r in refresh.current(spark, table).collect())
    assert rows() == want
    again = refresh.refresh(spark.readStream.schema("k string, o int, v string").json(str(source)), table, mark + "2", ["k"], "o")
    again.awaitTermination(60)
    assert rows() == want
    late = spark.createDataFrame([("d", 1, "n")], "k string, o int, v string")
    before = refresh._meta(spark, table)
    refresh.upsert(late, table, 0, ["k"], "o", mark)
    assert rows() == want and refresh._meta(spark, table)[0] == before[0]
    refresh.upsert(late, table, 9, ["k"], "o", mark)
    assert rows() == [*want, ("d", 1, "n")]
    changed = [p for p, n in dict(refresh._meta(spark, table)[1]["holders"]).items() if n > before[0]]
    assert len(changed) == 1
    refresh.sweep(spark, table)
    assert rows() == [*want, ("d", 1, "n")]


def test_limit_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "ev"
    source.mkdir()
    rows = [{"k": "a", "t": f"2024-01-01 00:00:{i:02d}", "e": i} for i in range(0, 60, 4)]
    for n in range(3):
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows[n * 5 : n * 5 + 5])))
        os.utime(source / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("k string, t timestamp, e long").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(source))
    query = limits.limit_stream(stream, "k", "t", "e", 2, 15).writeStream.format("memory").queryName("allowed").outputMode("append").start()
    deadline = time.time() + 60  # its timeouts keep it running, so it is stopped once all events are through
    while spark.table("allowed").count() < len(rows) and time.time() < deadline:
        time.sleep(0.5)
    query.stop()
    got = {r["e"]: r["allowed"] for r in spark.table("allowed").collect()}
    batch = spark.read.schema("k string, t timestamp, e long").json(str(source))
    assert got == {r["e"]: r["allowed"] for r in limits.limited(batch, "k", "t", "e", 2, 15).collect()}


def test_repeats_in_stream(spark, tmp_path):
    source = tmp_path / "ev"
    source.mkdir()
    (source / "a.json").write_text('{"k": 1, "t": "2024-01-01"}\n{"k": 1, "t": "2024-01-01"}\n{"k": 2, "t": "2024-01-01"}')
    stream = spark.readStream.schema("k int, t timestamp").json(str(source))
    query = refresh.without_repeats(stream, ["k"], "t").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("once").count() == 2
