"""Comparison of full snapshots, against a plain Python version."""

import random
from datetime import datetime, timedelta

import pytest

from quern.operators.snapshots import current_sections, repo_changes, section_changes, store_changes

SCHEMA = "snapshot_no int, delivered_at timestamp, id long, repo_id string, doc_id string, section_id string, content_hash string, doc_revision string, change string"
T0 = datetime(2026, 1, 1)


def plain(rows):
    """(n, repo, doc, section) -> change, by dictionaries."""
    state = {}
    for n, at, _, *key, digest, revision, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1] or datetime.min):
        digest = (digest or "").strip().lower().removeprefix("sha256:").strip()
        state.setdefault(n, {})[tuple(k or "" for k in key)] = (digest, (revision or "").strip())
    out, numbers = set(), sorted(state)
    for a, b in zip(numbers, numbers[1:]):
        for key in state[a].keys() | state[b].keys():
            x, y = state[a].get(key), state[b].get(key)
            if x != y:
                out.add((b, *key, "added" if x is None else "removed" if y is None else "changed"))
    return out


def test_against_dictionaries(spark):
    rng = random.Random(3)
    rows = []
    for n in (1, 2, 4, 9):
        for d in range(40):
            if rng.random() < 0.8:
                for v in range(rng.choice([1, 1, 2])):
                    digest = rng.choice(["ab", "AB", "sha256:ab", " cd ", "cd", "xyz", None, ""])
                    rows.append((n, T0 + timedelta(seconds=len(rows)), d, rng.choice(["hot", "hot", None]), f"d{d}", "1", digest, rng.choice(["1", " 1", None, ""]), "x"))
    rows += rows[:30]
    rng.shuffle(rows)
    got = [tuple(r) for r in section_changes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows)


def test_late_and_superseded_rows_and_gaps(spark):
    rows = [
        (1, T0, 1, "r", "d", "1", "aa", None, ""),
        (1, T0 + timedelta(days=30), 1, "r", "d", "1", "bb", None, ""),  # arrives after the next snapshot
        (5, T0 + timedelta(days=7), 2, "r", "d", "1", "sha256:BB", "", ""),
        (None, T0, 2, "r", "d", "9", "bb", "", ""),
    ]
    assert section_changes(spark.createDataFrame(rows, SCHEMA)).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, T0, 1, "r", "d", "1", "aa", None, "")]])
def test_empty_and_first_snapshot(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert section_changes(df).count() == 0
    assert current_sections(df).count() == len(rows)


def test_repos_and_union(spark):
    repos = spark.createDataFrame([(1, T0, "a", "F0"), (1, T0, "b", "f1"), (2, T0, "a", "f0 "), (2, T0, "c", "1")], "snapshot_no int, delivered_at timestamp, repo_id string, fingerprint string")
    assert {tuple(r) for r in repo_changes(repos).collect()} == {(2, "b", "removed"), (2, "c", "added")}
    both = store_changes(spark.createDataFrame([], SCHEMA), repos)
    assert both.columns == ["entity", "snapshot_no", "repo_id", "doc_id", "section_id", "change"]
    assert both.where("entity = 'repos' AND doc_id = '' AND section_id = ''").count() == 2


def test_current_sections_takes_latest(spark):
    rows = [(2, T0, 7, "r", "d", "1", "a", "", ""), (2, T0 + timedelta(1), 8, "r", "d", "1", "b", "", ""), (1, T0 + timedelta(9), 9, "r", "d", "2", "b", "", "")]
    assert [tuple(r) for r in current_sections(spark.createDataFrame(rows, SCHEMA)).collect()] == [("r", "d", "1", 8)]
