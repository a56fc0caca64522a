"""Claims, in batch and as a stream."""

import json
import os
import random
import time
from datetime import datetime, timedelta

from quern.streaming import claims

T0 = datetime(2026, 1, 1)
SCHEMA = "name string, at timestamp, seq long, action string, holder string, token string, phase string, pr string"


def make(spark, rows):
    return spark.createDataFrame([(n, T0 + timedelta(seconds=t), i, *rest) for i, (n, t, *rest) in enumerate(rows)], SCHEMA)


def test_outcomes(spark):
    rows = [
        ("a", 0, "take", "x", "1", "", ""), ("a", 5, "take", "y", "2", "", ""), ("a", 8, "take", "x", "1", "", ""), ("a", 9, "update", "x", "9", "", ""),
        ("a", 18, "take", "y", "2", "", ""), ("a", 19, "update", "x", "1", "", ""), ("a", 20, "update", "y", "2", "review", "pr7"), ("a", 90, "take", "x", "1", "", ""),
        ("a", 91, "release", "y", "2", "", ""), ("a", 92, "release", "y", "2", "", ""), ("a", 93, "dance", None, None, None, None), ("b", 0, "take", "z", "3", "", ""), ("b", 1, "update", "z", "3", "stopped", ""), ("b", 99, "take", "w", "4", "", ""),
    ]
    got = {r["seq"]: (r["outcome"], r["holder"], r["lapsed"]) for r in claims.outcomes(make(spark, rows), ["name"], 10).collect()}
    assert [got[i] for i in range(len(rows))] == [
        ("granted", "x", False), ("taken", "x", False), ("renewed", "x", False), ("wrong token", "x", False),
        ("granted", "y", True), ("wrong token", "y", False), ("renewed", "y", False), ("taken", "y", False),
        ("closed", "", False), ("lost", "", False), ("unknown", "", False), ("granted", "z", False), ("renewed", "z", False), ("taken", "z", False),
    ]
    assert claims.outcomes(make(spark, []), ["name"], 10).count() == 0


def test_one_holder_at_a_time(spark):
    rng = random.Random(1)
    rows, t = [], 0
    for _ in range(400):
        t += rng.randint(0, 4)
        who = rng.choice("xyz")
        rows.append((rng.choice("aab"), t, rng.choice(["take", "take", "update", "release"]), who, who, "", ""))
    got = {r["seq"]: r for r in claims.outcomes(make(spark, rows), ["name"], 10).collect()}
    holder = {}
    for i, (name, _, _, who, *_) in enumerate(rows):
        before, now = holder.get(name, ""), got[i]["holder"]
        assert now == before or got[i]["lapsed"] or before in ("", who)
        if got[i]["outcome"] in ("granted", "renewed"):
            assert now == who
        holder[name] = now


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [{"name": rng.choice("ab"), "at": f"2030-01-01 00:{i // 60:02d}:{i % 60:02d}", "seq": i, "action": rng.choice(["take", "update", "release"]), "holder": (w := rng.choice("xy")), "token": w, "phase": "", "pr": ""} for i in range(60)]
    for n in range(3):
        (tmp_path / f"{n}.json").write_text("\n".join(map(json.dumps, rows[n * 20 : n * 20 + 20])))
        os.utime(tmp_path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    query = claims.outcome_stream(stream, ["name"], 5).writeStream.format("memory").queryName("claimed").outputMode("append").start()
    deadline = time.time() + 90
    while spark.table("claimed").count() < len(rows) and time.time() < deadline:
        time.sleep(0.5)
    query.stop()
    batch = spark.read.schema(SCHEMA).json(str(tmp_path))
    assert sorted(map(tuple, spark.table("claimed").collect())) == sorted(map(tuple, claims.outcomes(batch, ["name"], 5).collect()))


def test_last_closed_and_held_back(spark):
    df = spark.createDataFrame([("a", 1, "x", "t1"), ("a", 2, "y", "t2"), ("a", 3, "z", None), ("b", 4, "w", None)], "name string, id int, holder string, closed_at string")
    assert [tuple(r) for r in claims.last_closed(df, ["name"]).collect()] == [("a", 2, "y", "t2")]
    rows = spark.createDataFrame([("f", 1, "c1"), ("f", 2, "c2"), ("f", 3, "c2"), ("g", 1, "c3")], "file string, at int, call string")
    live = spark.createDataFrame([("f",)], "file string")
    assert {tuple(r) for r in claims.held_back(rows, "file", "at", "call", live).collect()} == {("f", 1, "c1"), ("g", 1, "c3")}
