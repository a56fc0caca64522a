"""Hybrid search over sections: weighted BM25, vector neighbours, rank fusion and a token budget.

Every operator takes a batch of queries and answers all of them in one job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from quern.functions.text import nfc, search_tokens
from quern.session import materialise, spread

#: Fixed values of the ranking: BM25, rows a leg, fusion, and the least vector similarity.
K1, B = 1.2, 0.75
LEG = 50
FUSION = 60
FLOOR = 0.6
#: Queries that are answered together and their terms, and queries and rows of one matrix product.
BLOCK, TERMS, PART, ROWS = 10_000, 500_000, 256, 1_000
#: Parts of a kept index, by token.
BUCKETS = 64
#: How many times more rows the vector leg fetches where a filter comes behind it.
OVERFETCH = 4


def search_rows(fts: DataFrame) -> DataFrame:
    """The sections' texts, composed so that equal words are equal tokens; null texts become ''. Repeated rows stay."""
    texts = ["title", "summary", "body_l2", "body_l3"]
    return spread(fts.where(F.col("id").isNotNull()).select("id", *texts)).select("id", *[nfc(F.coalesce(c, F.lit(""))).alias(c) for c in texts])


@dataclass(frozen=True)
class Index:
    """What keyword search needs of a set of rows, not their texts.

    ``postings`` has ``key, token, f, dl``: how much of a token a row has, weighted by
    column, and how many tokens of any kind; and ``bucket``, the token's, if it is kept in files.
    """

    postings: DataFrame
    key: str
    rows: int
    average: float


def counted(rows: DataFrame, key: str, columns: dict[str, float]) -> DataFrame:
    """``key, dl, token, f``: for each row its length in tokens, its different tokens, and their weighted frequencies.

    Each row is counted where it lies. Repeated rows stay; null texts count as ''.
    """
    by_column = [search_tokens(F.col(c)).alias(f"_{i}") for i, c in enumerate(columns)]
    weights = list(columns.values())
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL("dl long, token array<string>, f array<double>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, length, row, words = batch.num_rows, np.zeros(batch.num_rows, np.int64), [], []
            for i in range(len(weights)):
                lists = batch.column(f"_{i}")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                row.append(np.repeat(np.arange(n), sizes))
                words.append(pc.list_flatten(lists))
                length += sizes
            coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
            coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
            codes, many = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
            cell, back = np.unique(np.concatenate(row) * many + codes, return_inverse=True)
            f = np.bincount(back, np.repeat(weights, [len(r) for r in row]), len(cell))
            of_row, c = np.divmod(cell, many)
            ends = pa.array(np.searchsorted(of_row, np.arange(n + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (coded.dictionary.take(pa.array(c)), pa.array(f))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(length), *lists], names=schema.names)

    return rows.where(F.col(key).isNotNull()).select(key, *by_column).mapInArrow(run, schema)


def postings_of(each: DataFrame, key: str) -> DataFrame:
    """``key, token, f, dl`` of counted rows."""
    return each.select(key, "dl", F.explode(F.arrays_zip("token", "f")).alias("p")).select(key, "p.token", "p.f", "dl")


def index_of(rows: DataFrame, key: str, columns: dict[str, float]) -> Index:
    """An index of rows that isn't kept. Repeated rows count once. Reads the rows once."""
    each = materialise(counted(rows, key, columns).dropDuplicates([key]), "counted")
    n, total = each.agg(F.count("*"), F.sum("dl")).first()
    return Index(postings_of(each, key), key, n, (total or 0) / max(n, 1))


def postings(rows: DataFrame, key: str, columns: dict[str, float]) -> DataFrame:
    """``key, field, token, tf``: how often each token occurs in each column of each row; repeated rows count once."""
    rows = rows.dropDuplicates([key])
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), search_tokens(F.col(c)).alias("t")) for c in columns]))
    each = rows.select(F.col(key), fields.alias("f")).select(key, "f.field", F.explode("f.t").alias("token"))
    return each.groupBy(key, "field", "token").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, token, times`` of ``query_id, text``; a term that is repeated counts as often."""
    return queries.select("query_id", F.explode(search_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))


def bucket_of(token: Column) -> Column:
    """The part of a kept index a token is in."""
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def bm25(index: Index, queries: DataFrame, k: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """``query_id, key, score`` of every row with one of the query's terms; a higher score is better.

    Term frequencies are weighted by column, lengths are not. A term's weight is the
    logarithm of its odds of absence, at least one millionth, so that a term in most
    rows still counts a little. Of the index only the queries' tokens are read, and
    only these are shuffled, by row. Keys are integers. ``only`` has the keys that may
    come out; weights are taken over all rows nonetheless. With ``k`` each task keeps,
    of all its scores, the ``k`` best of a query (to nine digits, ties to the lower key), as ``top`` would.
    """
    scored = None
    terms = query_terms(queries).withColumn("bucket", bucket_of(F.col("token")))
    for block in _blocks(terms, TERMS):
        part = _bm25_block(queries.sparkSession, index, block, queries.schema["query_id"], k, only)
        scored = part if scored is None else scored.unionByName(part)
    return scored


def _blocks(rows: DataFrame, most: int) -> Iterator[list[Row]]:
    """The rows of queries in parts of about ``BLOCK`` queries and ``most`` rows, by a hash of their query's id; one part where all are that few."""
    first = rows.limit(most + 1).collect()
    if len(first) <= most and len({r["query_id"] for r in first}) <= BLOCK:
        yield first
        return
    kept = materialise(rows, "asked")
    queries, n = kept.agg(F.countDistinct("query_id"), F.count("*")).first()
    parts = max(-(-queries // BLOCK), -(-n // most))
    for i in range(parts):
        yield kept.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect()


def _bm25_block(spark: SparkSession, index: Index, terms: list[Row], query_id: T.StructField, k: int | None, only: DataFrame | None) -> DataFrame:
    key = index.key
    asked = [(r["query_id"], r["token"], r["times"], r["bucket"]) for r in terms]
    ids, known = sorted({q for q, *_ in asked}), sorted({t for _, t, *_ in asked})
    code, at = {t: i for i, t in enumerate(known)}, {q: i for i, q in enumerate(ids)}
    wanted = sorted((at[q], code[t], n) for q, t, n, _ in asked)
    avgdl = index.average
    codes = F.broadcast(spark.createDataFrame(list(code.items()), "token string, c int"))
    found = index.postings
    if "bucket" in found.columns:
        found = found.where(F.col("bucket").isin(sorted({b for *_, b in asked})))
    hits = found.join(codes, "token")
    idf = np.full(len(known), 1e-6)
    for c, df in hits.groupBy("c").count().collect():
        idf[c] = max(math.log((index.rows - df + 0.5) / (df + 0.5)), 0) or 1e-6
    if only is not None:
        hits = hits.join(only.select(key).distinct(), key, "left_semi")
    cells = F.array_sort(F.collect_list(F.struct("c", "f")))
    small = hits.groupBy(key).agg(F.first("dl").alias("dl"), cells.alias("t")).select(key, "dl", F.col("t.c").alias("codes"), F.col("t.f").alias("f"))
    result = T.StructType([query_id, index.postings.schema[key], T.StructField("score", T.DoubleType())])
    id_type, key_type = (to_arrow_type(x.dataType) for x in result.fields[:2])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_asked_of(wanted, i, min(i + PART, len(ids))) for i in range(0, len(ids), PART)]
        least, kept, size = np.zeros(len(ids)), [], 0
        names = pa.array(ids, id_type)

        def best() -> None:
            nonlocal kept, size
            q, key_, s = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((key_, -np.round(s, 9), q))
            q, key_, s = q[order], key_[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            last = rank == k - 1
            least[q[last]] = np.round(s[last], 9)
            kept, size = [(q[rank < k], key_[rank < k], s[rank < k])], int((rank < k).sum())

        def made(q: np.ndarray, key_: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            columns_ = [names.take(pa.array(q)), pa.array(key_).cast(key_type), pa.array(s)]
            return pa.RecordBatch.from_arrays(columns_, names=result.names)

        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                own = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
                dl = batch.column("dl").to_numpy(zero_copy_only=False)
                codes, f = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("codes", "f"))
                row = np.repeat(np.arange(len(own)), pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False))
                gain = idf[codes] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl[row] / avgdl))
                for first, place, times in parts:
                    there = place[codes] >= 0
                    grid = np.zeros((len(own), len(times)))
                    grid[row[there], place[codes[there]]] = gain[there]
                    s = grid @ times
                    r, q = np.nonzero((s > 0) & (np.round(s, 9) >= least[first : first + s.shape[1]]))
                    if k is None:
                        yield made(q + first, own[r], s[r, q])
                    elif len(r):
                        kept.append((q + first, own[r], s[r, q]))
                        size += len(r)
                        if size > 4 * k * len(ids) + 100_000:
                            best()
        if kept:
            best()
            yield made(*kept[0])

    return small.mapInArrow(score, result)


def _asked_of(wanted: list[tuple[int, int, int]], first: int, end: int) -> tuple[int, np.ndarray, np.ndarray]:
    """For the queries from ``first`` on: where each token stands among theirs, or -1, and how often each query has it."""
    own = [(q - first, c, n) for q, c, n in wanted if first <= q < end]
    codes = sorted({c for _, c, _ in own})
    place = np.full(max(c for _, c, _ in wanted) + 1, -1)
    place[codes] = np.arange(len(codes))
    times = np.zeros((len(codes), end - first))
    for q, c, n in own:
        times[place[c], q] = n
    return first, place, times


def top(scored: DataFrame, key: str, order: list[Column], k: int = LEG) -> DataFrame:
    """The best ``k`` rows of each query with their ``rank`` from 1; each task keeps no more than ``k``."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order, F.col(key)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_leg(index: Index, queries: DataFrame, k: int = LEG, only: DataFrame | None = None) -> DataFrame:
    """The best rows by BM25; scores are compared to nine digits, ties go to the lower key."""
    return top(bm25(index, queries, k, only), index.key, [F.round("score", 9).desc()], k)


def neighbours(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = LEG, floor: float | None = None) -> DataFrame:
    """``query_id, key, distance, rank`` of the nearest vectors to each query's ``vector``, exactly.

    Distances are matrix products of Arrow batches with blocks of about ``BLOCK``
    queries; those that may be among the nearest are taken again without rounding
    errors. Every row is compared where it lies, and each task keeps ``k`` a query.
    Null vectors, and those of another length than the query's, are near to none. Keys are integers.
    """
    found = None
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    for block in _blocks(asked, BLOCK):
        part = top(_near(vectors, key, vector, block, queries.schema["query_id"], k, floor), key, [F.col("distance")], k)
        found = part if found is None else found.unionByName(part)
    return found


def _near(vectors: DataFrame, key: str, vector: str, queries: list[Row], query_id: T.StructField, k: int, floor: float | None) -> DataFrame:
    by_size: dict[int, list] = {}
    for r in queries:
        by_size.setdefault(len(r["vector"]), []).append((r["query_id"], r["vector"]))
    groups = {n: ([q for q, _ in rows], np.array([v for _, v in rows], float).reshape(len(rows), n)) for n, rows in by_size.items()}
    sent = vectors.sparkSession.sparkContext.broadcast(groups)
    result = T.StructType([query_id, vectors.schema[key], T.StructField("distance", T.DoubleType())])
    id_type, key_type = (to_arrow_type(x.dataType) for x in result.fields[:2])
    most = math.inf if floor is None else 1 / floor - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: _Nearest(len(ids), k) for n, (ids, _) in sent.value.items()}
        for whole in batches:
            sizes = pc.list_value_length(whole.column(vector)).to_numpy(zero_copy_only=False)
            for n, (_, asked) in sent.value.items():
                own = whole.filter(pa.array(sizes == n))
                for start in range(0, own.num_rows, ROWS):
                    batch = own.slice(start, ROWS)
                    rows = pc.list_flatten(batch.column(vector)).to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, n)
                    keys = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
                    for first in range(0, len(asked), PART):
                        held[n].take(first, asked[first : first + PART], rows, keys, most)
        for n, (ids, _) in sent.value.items():
            q, own, distance = held[n].best()
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type).take(pa.array(q)), pa.array(own).cast(key_type), pa.array(distance)], names=result.names)

    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, result)


class _Nearest:
    """The ``k`` nearest keys so far of each of some queries."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit, self.kept, self.size = k, np.full(queries, np.inf), [], 0

    def take(self, first: int, asked: np.ndarray, rows: np.ndarray, keys: np.ndarray, most: float) -> None:
        """Compare some rows with the queries from ``first`` on."""
        norms = (rows**2).sum(1)
        squares = norms[:, None] + (asked**2).sum(1)[None, :] - 2 * rows @ asked.T
        slack = 1e-9 * (1 + norms.max(initial=0.0) + (asked**2).sum(1))
        limit = np.minimum(self.limit[first : first + len(asked)], most) ** 2
        if len(rows) > self.k:
            limit = np.minimum(limit, np.partition(squares, self.k - 1, axis=0)[self.k - 1] + slack)
        r, q = np.nonzero(squares <= limit + slack)
        distance = np.sqrt(((rows[r] - asked[q]) ** 2).sum(1))
        near = distance <= most
        self.kept.append((q[near] + first, keys[r[near]], distance[near]))
        self.size += int(near.sum())
        if self.size > 4 * self.k * len(self.limit) + 100_000:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, own, distance = (np.concatenate([x[i] for x in self.kept] or [np.zeros(0, np.int64 if i < 2 else float)]) for i in range(3))
        order = np.lexsort((own, distance, q))
        q, own, distance = q[order], own[order], distance[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.limit[q[rank == self.k - 1]] = distance[rank == self.k - 1]
        self.kept, self.size = [(q[rank < self.k], own[rank < self.k], distance[rank < self.k])], int((rank < self.k).sum())
        return self.kept[0]


def fuse(legs: dict[str, DataFrame], key: str) -> DataFrame:
    """``query_id, key, score, mode, rank``: the sum of 1/(60 + rank) over the legs that found a row."""
    found = None
    for name, leg in legs.items():
        part = leg.select("query_id", key, F.lit(name).alias("leg"), "rank")
        found = part if found is None else found.unionByName(part)
    modes = F.array_sort(F.collect_set("leg"))
    fused = found.groupBy("query_id", key).agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score"), modes.alias("m"))
    mode = F.when(F.size("m") > 1, F.lit("hybrid")).otherwise(F.element_at("m", 1))
    return top(fused.select("query_id", key, "score", mode.alias("mode")), key, [F.round("score", 12).desc()], 2**31 - 1)


def within_budget(ranked: DataFrame, size: Column, budget: int) -> DataFrame:
    """The longest run of best rows whose sizes fit the budget; the first is let in whatever its size."""
    w = Window.partitionBy("query_id").orderBy("rank")
    sized = ranked.withColumn("tokens", size).withColumn("_sum", F.sum("tokens").over(w))
    before = F.col("_sum") - F.col("tokens")
    fits = F.when((F.row_number().over(w) == 1) | ((F.col("_sum") <= budget) & (before < budget)), 0).otherwise(1)
    return sized.withColumn("_over", F.sum(fits).over(w)).where("_over = 0").drop("_sum", "_over")


def truncated(legs: dict[str, DataFrame], k: int = LEG) -> DataFrame:
    """``query_id, leg, n, truncated``: whether a leg has as many rows as it may."""
    parts = [leg.groupBy("query_id").agg(F.count("*").alias("n")).select("query_id", F.lit(name).alias("leg"), "n", (F.col("n") >= k).alias("truncated")) for name, leg in legs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ambiguous_top(results: DataFrame, keyword: DataFrame, key: str, same: list[str], ratio: float = 1.0) -> DataFrame:
    """Queries whose two best results can't be told apart: ``query_id, reason``.

    ``mirrored`` if they agree in the columns ``same``; ``score`` if both come from the
    keyword leg alone and the second's score there reaches the first's up to the ratio
    (to nine digits) without passing it.
    """
    scores = keyword.select("query_id", key, F.col("score").alias("_score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    best = results.withColumn("_nth", nth).where("_nth <= 2").join(scores, ["query_id", key], "left")
    a, b = best.where("_nth = 1").alias("a"), best.where("_nth = 2").alias("b")
    both = a.join(b, F.col("a.query_id") == F.col("b.query_id"))
    mirrored = F.lit(True)
    for c in same:
        mirrored = mirrored & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    high, low = F.round("a._score", 9), F.round("b._score", 9)
    close = (F.col("a.mode") == "keyword") & (F.col("b.mode") == "keyword") & (high > 0) & (low <= high) & (low >= ratio * high)
    reason = F.when(mirrored, "mirrored").when(close, "score")
    return both.select(F.col("a.query_id"), reason.alias("reason")).where("reason IS NOT NULL")


def after_cut(leg: DataFrame, key: str, allowed: DataFrame, k: int = LEG) -> DataFrame:
    """The rows of a leg that may come out, ranked anew and cut to ``k``: a filter behind the search.

    The leg should have several times ``k`` rows, as what is filtered out leaves fewer.
    """
    kept = leg.join(allowed.select(key).distinct(), key, "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def tagged(rows: DataFrame, keys: list[str], tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows with one of the tags (compared in lower case, without blanks), filtered before anything is ranked."""
    if len(wanted) > 100:
        raise ValueError("at most 100 tags")
    normal = sorted({t.strip().lower() for t in wanted})
    return rows.join(tags.where(F.lower(F.trim("tag")).isin(normal)).select(*keys).distinct(), keys, "left_semi")

