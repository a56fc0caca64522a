"""Claims that lapse: one holder at a time for each key, in batch and as a stream.

Requests are rows ``at`` (a time), ``seq``, ``action``, ``holder``, ``token``,
``phase``, ``pr``, with the columns of the key. ``take`` opens a claim, or renews one's
own; ``update`` renews it and changes its phase and pull request, where given, or stops
it with the phase ``stopped``; ``release`` closes it. A claim that nobody renewed for its
time to live is closed before the next request is looked at, unless it is stopped or
waits in review or publishing with a pull request. Locks of environments are claims whose key is a name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Phases in which a claim with a pull request waits for others.
WAITING = ("review", "publishing")



@dataclass(frozen=True)
class Claim:
    """An open claim; ``seen`` is when it was last renewed."""

    holder: str
    token: str
    phase: str
    pr: str
    seen: int

    def lapsed(self, now: int, ttl: int) -> bool:
        """Whether nobody holds it any more; exactly that old it is."""
        return self.phase != "stopped" and not (self.phase in WAITING and self.pr) and self.seen <= now - ttl


def decide(claim: Claim | None, now: int, action: str, holder: str, token: str, phase: str, pr: str, ttl: int) -> tuple[Claim | None, str, bool]:
    """The claim after a request, what came of it, and whether another one lapsed before it.

    Outcomes: ``granted``, ``renewed``, ``taken`` by another, ``closed``, ``wrong token``, ``lost`` where there is none, ``unknown`` for other actions.
    """
    lapsed = claim is not None and claim.lapsed(now, ttl)
    claim = None if lapsed else claim
    if action == "take":
        if claim is None:
            return Claim(holder, token, phase, pr, now), "granted", lapsed
        if (claim.holder, claim.token) == (holder, token):
            return replace(claim, seen=now), "renewed", lapsed
        return claim, "taken", lapsed
    if action not in ("update", "release"):
        return claim, "unknown", lapsed
    if claim is None:
        return None, "lost", lapsed
    if claim.token != token:
        return claim, "wrong token", lapsed
    if action == "release":
        return None, "closed", lapsed
    return replace(claim, phase=phase or claim.phase, pr=pr or claim.pr, seen=now), "renewed", lapsed


def _prepared(df: DataFrame, keys: list[str]) -> DataFrame:
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("action", "holder", "token", "phase", "pr")]
    return df.select(*keys, F.unix_micros(F.col("at").cast("timestamp")).alias("_t"), "seq", *text).where("_t IS NOT NULL")


def outcomes(requests: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """``keys, seq, outcome, holder, lapsed`` of every request, in order of time and ``seq`` within its key.

    ``holder`` is who holds the key afterwards, or ''. What a request gives depends on all
    before it, so a key's requests stream through one task, which holds the one open claim.
    """
    rows = _prepared(requests, keys)
    schema = T.StructType([*(rows.schema[k] for k in keys), rows.schema["seq"], *T.StructType.fromDDL("outcome string, holder string, lapsed boolean")])
    ttl = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, claim = None, None
        for batch in batches:
            out = []
            for *key, now, _, action, holder, token, phase, pr in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    current, claim = key, None
                claim, outcome, lapsed = decide(claim, now, action, holder, token, phase, pr, ttl)
                out.append((outcome, claim.holder if claim else "", lapsed))
            columns = list(zip(*out)) or [()] * 3
            kinds = (pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "seq")), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "_t", "seq").mapInArrow(run, schema)


def outcome_stream(requests: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """The same for a stream: the state of a key is its open claim, kept until it is closed or has lapsed."""
    rows = _prepared(requests, keys)
    out = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*keys, "seq")), "outcome string, holder string, lapsed boolean"])
    ttl = seconds * 1_000_000

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            claim = Claim(*state.get)
            if claim.lapsed(state.getCurrentProcessingTimeMs() * 1000, ttl):
                state.remove()
            return
        claim = Claim(*state.get) if state.exists else None
        group = pd.concat(list(frames)).sort_values(["_t", "seq"], kind="stable")
        found = []
        for row in group.itertuples(index=False):
            claim, outcome, lapsed = decide(claim, row[len(keys)], row.action, row.holder, row.token, row.phase, row.pr, ttl)
            found.append((outcome, claim.holder if claim else "", lapsed))
        if claim:
            state.update((claim.holder, claim.token, claim.phase, claim.pr, claim.seen))
            state.setTimeoutDuration(seconds * 1000)
        elif state.exists:
            state.remove()
        yield group[[*keys, "seq"]].assign(**dict(zip(("outcome", "holder", "lapsed"), map(list, zip(*found)))))

    return rows.groupBy(*keys).applyInPandasWithState(step, out, "holder string, token string, phase string, pr string, seen long", "append", "ProcessingTimeTimeout")


def last_closed(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the closed claim with the greatest ``id``; ``claims`` has ``id`` and ``closed_at``."""
    rest = [c for c in claims.columns if c not in (*keys, "id")]
    best = claims.where("closed_at IS NOT NULL").groupBy(*keys).agg(F.max(F.struct("id", *rest)).alias("_c"))
    return best.select(*keys, "_c.id", *[F.col(f"_c.{c}").alias(c) for c in rest])


def held_back(rows: DataFrame, source: str, order: str, call: str, live: DataFrame) -> DataFrame:
    """Rows without those of the last call of each source that is ``live``, as it may still grow; rows of one call stand together."""
    last = F.max_by(F.col(call), F.col(order)).over(Window.partitionBy(source))
    marked = rows.withColumn("_last", last).join(live.select(source).distinct().withColumn("_live", F.lit(True)), source, "left")
    return marked.where(F.col("_live").isNull() | ~F.col(call).eqNullSafe(F.col("_last"))).select(*rows.columns)
