"""Federations in files, mirrors, assets, kept vectors and transcripts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quern.functions.vectors import hash_embedder
from quern.operators import vectors
from quern.sources import federation, files, sinks, yaml_files

yaml = pytest.mark.skipif(yaml_files.yaml is None, reason="no YAML parser")


def entry(root, name, meta="kind: kb", index="docs:\n- {id: d, title: D, revision: v1}", manifest=None):
    folder = root / name
    (folder / "d").mkdir(parents=True)
    if meta is not None:
        (folder / "_meta.yaml").write_text(meta)
    if index is not None:
        (folder / "index.yaml").write_text(index)
    if manifest:
        (folder / "d" / "_manifest.yaml").write_text(manifest)
    return folder


def test_folders_at_any_depth(spark, tmp_path):
    entry(tmp_path, "a")
    entry(tmp_path, "l1/l2/l3/l4/l5/deep")
    entry(tmp_path, "a/inner")  # inside an entry, so no entry of its own
    entry(tmp_path, "half", index=None)
    entry(tmp_path, "half/under")
    (entry(tmp_path, "old") / "manifests").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "a")
    got = {r["repo_id"]: r["state"] for r in federation.folders(spark, str(tmp_path)).collect()}
    assert got == {"a": "entry", "l1/l2/l3/l4/l5/deep": "entry", "half": "half", "old": "old"}
    assert {r[0] for r in files.entries(spark, str(tmp_path)).collect()} == {"a", "l1/l2/l3/l4/l5/deep"}
    assert federation.folders(spark, str(tmp_path / "nowhere")).count() == 0


@yaml
def test_load(spark, tmp_path):
    entry(tmp_path, "a", "repo_id: other\nkind: ' KB '\nsource_url: u", "docs:\n- {id: d, title: D, tags: [x]}\n- {id: e, title: E, revision: r}", "revision: m7")
    entry(tmp_path, "mid/b", "kind: kb")
    entry(tmp_path, "mid/c", "kind: dev")
    entry(tmp_path, "n", "kind: odd", "docs:\n- {id: n-svc, title: N, tags: [code]}")
    entry(tmp_path, "broken", "kind: [")
    entry(tmp_path, "bytes").joinpath("index.yaml").write_bytes(b"\xff\xfe\x00")
    repos, docs = federation.load(spark, str(tmp_path))
    assert {(r["repo_id"], r["kind"]) for r in repos.collect()} == {("a", "kb"), ("mid/b", "kb"), ("n", "dev")}
    assert {(r["repo_id"], r["doc_id"], r["ord"], r["revision"]) for r in docs.collect()} == {("a", "d", 0, "m7"), ("a", "e", 1, "r"), ("mid/b", "d", 0, "v1"), ("n", "n-svc", 0, "")}
    digests = spark.createDataFrame([("a", "new"), ("n", "new"), ("mid/b", "new")], "repo_id string, digest string")
    recorded = spark.createDataFrame([("a", "old"), ("n", "old")], "repo_id string, digest string")
    index = federation.federation_index(repos, docs, digests, recorded, spark.createDataFrame([("n",)], "repo_id string"))
    assert {(r["repo_id"], r["digest"]) for r in index.collect()} == {("a", "old"), ("n", "new"), ("mid/b", "new")}


@yaml
def test_write_yaml(spark, tmp_path):
    df = spark.createDataFrame([("x/a", "ü: 1", None, ["p"]), ("b", "", 3, [])], "name string, z string, a int, l array<string>")
    federation.write_yaml(df, str(tmp_path / "out"), "name")
    assert (tmp_path / "out/x/a.yaml").read_text() == "name: x/a\nz: 'ü: 1'\nl:\n- p\n"
    with pytest.raises(Exception, match="leads out"):
        federation.write_yaml(spark.createDataFrame([("../q",)], "name string"), str(tmp_path / "out"), "name")


def test_mirror(spark, tmp_path):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    (tmp_path / "gone").mkdir()
    (tmp_path / "gone/g.md").write_bytes(b"g")
    (tmp_path / "same.md").write_bytes(b"s")
    local = spark.createDataFrame([("same.md", bytearray(b"s")), ("new/n.md", bytearray(b"n"))], "path string, content binary")
    remote = spark.createDataFrame([("same.md", sha(b"s")), ("gone/g.md", sha(b"g"))], "path string, digest string")
    done = {tuple(r) for r in sinks.mirror_files(local, remote, str(tmp_path)).collect()}
    assert done == {("new/n.md", "copy"), ("gone/g.md", "delete")}
    assert (tmp_path / "new/n.md").read_bytes() == b"n" and not (tmp_path / "gone").exists()
    with pytest.raises(ValueError):
        sinks.mirror_files(local.withColumn("path", F.lit("a/../../b")), remote, str(tmp_path))


def test_assets(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"1")), ("c", bytearray(b"2"))], "name string, content binary")
    path = str(tmp_path / "store")
    assert {(r["name"], r["added"]) for r in sinks.store_assets(spark, df.where("name = 'a'"), path).collect()} == {("a", True)}
    assert {(r["name"], r["added"]) for r in sinks.store_assets(spark, df, path).collect()} == {("a", False), ("b", False), ("c", True)}
    got = sinks.load_assets(spark, path, sinks.store_assets(spark, df, path)).collect()
    assert {bytes(r["content"]) for r in got} == {b"1", b"2"} and all(r["sound"] for r in got)


def test_vectors_are_filled_up(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "id long, t string")
    path, embed = str(tmp_path / "v"), hash_embedder(8)
    assert not vectors.covered(spark, path, "m")
    assert vectors.backfill(rows.where("id = 1"), path, "m", "id", "t", embed) == 1
    assert vectors.missing(rows, path, "m", "id").where("id IS NOT NULL").select("id").distinct().count() == 1
    assert vectors.backfill(rows, path, "m", "id", "t", embed) == 1
    assert vectors.backfill(rows, path, "m", "id", "t", embed) == 0 and vectors.covered(spark, path, "m")
    assert spark.read.parquet(f"{path}/m/complete").first()["n"] == 2
    assert vectors.missing(rows, path, "other", "id").count() == 4

    @F.pandas_udf("array<float>")
    def broken(t):
        raise ValueError("no")

    with pytest.raises(Exception):
        vectors.backfill(rows, path, "n", "id", "t", broken)
    assert not vectors.covered(spark, path, "n")


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a": 1}\nnot json\n[1]\n{"b": \n{"c": 2}\n')
    got = [(r["at"], r["row"]) for r in files.transcript(spark, str(tmp_path / "t.jsonl")).orderBy("at").collect()]
    assert got == [(0, '{"a": 1}'), (4, '{"c": 2}')]
