"""Queries over full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators.snapshots import store_changes
from quern.sources import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed keys of sections and repos for every snapshot after the first."""
    return store_changes(table(spark, sf_dir, "sections"), table(spark, sf_dir, "repos"))


QUERIES = {"p5_found": p5_found}

_BLANK = r"'^[\s\x{00a0}]+|[\s\x{00a0}]+$'"


def _digest(column: str) -> str:
    return f"regexp_replace(regexp_replace(lower(regexp_replace(coalesce({column}, ''), {_BLANK}, '', 'g')), '^sha256:', ''), {_BLANK}, '', 'g')"


def _side(name: str, source: str, keys: list[str], values: list[str]) -> str:
    k, v = ", ".join(f"coalesce({x}, '') AS {x}" for x in keys), ", ".join(f"{e} AS v{i}" for i, e in enumerate(values))
    on = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    shown = ", ".join(f"coalesce(b.{x}, a.{x}) AS {x}" if x in keys else f"'' AS {x}" for x in ("repo_id", "doc_id", "section_id"))
    differ = " OR ".join(f"a.v{i} <> b.v{i}" for i in range(len(values)))
    return f"""
    SELECT '{name}' AS entity, coalesce(b.n, a.n) AS snapshot_no, {shown},
           CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM (SELECT s.nxt AS n, x.* EXCLUDE (snapshot_no) FROM
            (SELECT snapshot_no, {k}, {v}, row_number() OVER (PARTITION BY snapshot_no, {', '.join(keys)} ORDER BY delivered_at DESC NULLS LAST) AS rn FROM {source}) x
            JOIN (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS nxt FROM (SELECT DISTINCT snapshot_no FROM {source})) s USING (snapshot_no)
          WHERE rn = 1 AND s.nxt IS NOT NULL) a
    FULL JOIN (SELECT snapshot_no AS n, x.* EXCLUDE (snapshot_no) FROM
            (SELECT snapshot_no, {k}, {v}, row_number() OVER (PARTITION BY snapshot_no, {', '.join(keys)} ORDER BY delivered_at DESC NULLS LAST) AS rn FROM {source}) x
          WHERE rn = 1 AND snapshot_no > (SELECT min(snapshot_no) FROM {source})) b
      ON a.n = b.n AND {on}
    WHERE a.n IS NULL OR b.n IS NULL OR {differ}"""


_REVISION = f"regexp_replace(coalesce(doc_revision, ''), {_BLANK}, '', 'g')"
ORACLE = {
    "p5_found": _side("sections", "sections", ["repo_id", "doc_id", "section_id"], [_digest("content_hash"), _REVISION])
    + "\n    UNION ALL"
    + _side("repos", "repos", ["repo_id"], [_digest("fingerprint")])
}
