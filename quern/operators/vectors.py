"""Nearly the nearest vectors, by lists around centroids, and vectors that are kept up to date."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.search import LEG, top
from quern.session import materialise
from quern.sources.sinks import exists, remove

#: Vectors the centroids are fitted on at most, taken by the hash of their key; and rounds of fitting.
SAMPLE, ROUNDS = 50_000, 8
#: Share of the true nearest that a query's lists have to hold among the sample, and how many of the sample are asked.
TARGET, ASKED = 0.95, 256


@dataclass(frozen=True)
class Lists:
    """Every vector under the centroid nearest to it: ``key, vector, list``; and how many lists a query looks into."""

    rows: DataFrame
    key: str
    vector: str
    centroids: np.ndarray
    probes: int


def _nearest(rows: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    off = (centroids**2).sum(1)[None, :] - 2 * rows @ centroids.T
    return np.argsort(off, axis=1, kind="stable")[:, :n]


def _probes(points: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """In how many lists, the nearest first, so many of the ``k`` nearest points are, on average."""
    asked = points[:ASKED]
    true = np.argsort((points**2).sum(1)[None, :] - 2 * asked @ points.T, axis=1, kind="stable")[:, :k]
    place = np.argsort(_nearest(asked, centroids, len(centroids)), axis=1)
    nth = np.take_along_axis(place, _nearest(points, centroids)[:, 0][true], axis=1)
    return int(np.sort(nth.ravel())[min(int(target * nth.size), nth.size - 1)]) + 1


def lists(vectors: DataFrame, key: str, vector: str, k: int = LEG, target: float = TARGET, sample: int = SAMPLE) -> Lists:
    """All vectors put into lists. Centroids, as many as its root, are fitted on a sample of bounded size.

    So is the number of lists a query looks into: as many as hold the share ``target``
    of the ``k`` nearest within the sample. Where vectors lie in clusters these are few,
    where they have no structure most of them. Null vectors are in no list; all others must have one length.
    """
    own = vectors.where(F.col(vector).isNotNull()).select(key, vector)
    taken = own.orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()
    points = np.array([r[0] for r in taken], float) if taken else np.zeros((1, 1))
    centroids = points[np.unique(np.linspace(0, len(points) - 1, max(1, int(len(points) ** 0.5))).astype(int))].copy()
    for _ in range(ROUNDS):
        near = _nearest(points, centroids)[:, 0]
        sizes = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    schema = T.StructType([own.schema[key], own.schema[vector], T.StructField("list", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = pc.list_flatten(batch.column(vector)).to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest(rows, centroids)[:, 0], pa.int32())], names=schema.names)

    return Lists(materialise(own.mapInArrow(run, schema), "lists"), key, vector, centroids, _probes(points, centroids, min(k, len(points)), target))


def search_lists(held: Lists, queries: DataFrame, k: int = LEG, probes: int | None = None) -> DataFrame:
    """``query_id, key, distance, rank``: the nearest vectors of the lists whose centroids are nearest to the query.

    Queries meet only the rows of their lists. The share of the true nearest that come
    out grows with ``probes``; over all lists the result is exact, as by ``search.neighbours``.
    """
    n = min(probes or held.probes, len(held.centroids))
    centroids, key, vector = held.centroids, held.key, held.vector
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    schema = T.StructType([*asked.schema.fields, T.StructField("list", T.ArrayType(T.IntegerType()))])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = pc.list_flatten(batch.column("vector")).to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest(rows, centroids, n).tolist(), pa.list_(pa.int32()))], names=schema.names)

    each = asked.mapInArrow(probes, schema).select("query_id", F.col("vector").alias("_asked"), F.explode("list").alias("list"))
    squares = F.zip_with(vector, "_asked", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    near = held.rows.join(each, "list").select("query_id", key, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)).alias("distance"))
    return top(near, key, [F.col("distance")], k)


def recall(found: DataFrame, exact: DataFrame, key: str) -> float:
    """Which share of the exact rows were found."""
    met = exact.select("query_id", key).join(found.select("query_id", key), ["query_id", key], "left_semi").count()
    return met / max(exact.count(), 1)


def missing(rows: DataFrame, path: str, model: str, key: str) -> DataFrame:
    """The rows that have no vector yet among those kept at ``path`` for a model; all of them for another model or where none are kept."""
    spark = rows.sparkSession
    where = f"{path}/{model}"
    if not exists(spark, f"{where}/data"):
        return rows
    return rows.join(spark.read.parquet(f"{where}/data").select(key).distinct(), key, "left_anti")


def backfill(rows: DataFrame, path: str, model: str, key: str, text: str, embed, digest: str | None = None) -> int:
    """Add the vectors that are missing for ``rows`` and return how many; what is there stays, whatever run wrote it.

    ``embed`` makes a vector column of a text column. While vectors are added ``dirty``
    is there; ``complete`` is written once every row has one, and tells the model and the
    count. A run that failed is run again and goes on. Repeated rows count once; rows
    without a key have none. With ``digest``, a row whose text changed is missing again,
    and of several vectors of a key readers take that of the row's digest.
    """
    spark, keys = rows.sparkSession, [key, *([digest] if digest else [])]
    where = f"{path}/{model}"
    own = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).select(*keys, text)
    if exists(spark, f"{where}/data"):
        own = own.join(spark.read.parquet(f"{where}/data").select(*keys).distinct(), keys, "left_anti")
    spark.range(1).write.mode("overwrite").parquet(f"{where}/dirty")
    made = materialise(own.select(*keys, embed(F.col(text)).alias("vector")), "vectors")
    n = made.count()
    if n:
        made.write.mode("append").parquet(f"{where}/data")
    total = spark.read.parquet(f"{where}/data").select(*keys).distinct().count() if exists(spark, f"{where}/data") else 0
    spark.createDataFrame([(model, total)], "model string, n long").write.mode("overwrite").parquet(f"{where}/complete")
    remove(spark, f"{where}/dirty")
    return n


def covered(spark: SparkSession, path: str, model: str) -> bool:
    """Whether all vectors of a model were written and no run is under way or broke off."""
    return exists(spark, f"{path}/{model}/complete/_SUCCESS") and not exists(spark, f"{path}/{model}/dirty")
