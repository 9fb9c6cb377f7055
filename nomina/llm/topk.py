"""Exact top-k inner products by norm buckets (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nomina.llm.common import stored, table

K = 5
#: Components are floor(SCALE * x).
SCALE = 256
#: Queries that travel together, those multiplied at once, vectors in a cell, coordinates that coordinate pruning sees.
BLOCK, STEP, CELL, FOCUS = 16384, 512, 8192, 12
#: Buckets a doubling of the length: lengths of doubles give at most 2100 * BUCKETS of them, whatever the rows.
BUCKETS = 4
#: Products below this are exact in doubles.
EXACT = 2.0**53
#: What rounding may take from a bound.
SLACK = 1 + 1e-9


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v array<double>, norm, bucket): the whole-number vectors; rows with a null id, a null vector or a component
    that is null or that isn't finite, by itself or SCALE times, take no part. bucket: of vectors of similar length."""
    x = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < float("inf"))), F.lit(False))
    # from 2^53 on a double is a whole number, and beyond 2^63 floor() would cut it
    whole = lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)
    rows = rows.filter(fine).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: whole(SCALE * c.cast("double"))).alias("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))
    bucket = F.when(F.col("norm") == 0, -1).when(F.col("norm") == float("inf"), 1024 * BUCKETS).otherwise(F.floor(F.log2("norm") * BUCKETS))
    return rows.withColumn("bucket", bucket.cast("int"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to one width."""
    flat, sizes = np.asarray(column.flatten(), np.float64), np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _large(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether some product might not be exact in doubles."""
    return bool(len(q) and len(x)) and not q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < EXACT


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products [queries, vectors] as int64: exact, cut to the range of int64."""
    if not _large(q, x):
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        low = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= low)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))[:k]]


def search(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[tuple]:
    """Rows (query_id, vec_id, score) of one bucket: at most k a query, those that can still reach its floor.

    Length pruning leaves out a query whose floor exceeds |q| times the bucket's greatest length. Its local threshold is
    the cosine that a vector of that length needs; where it is high, coordinate pruning leaves out vectors whose product
    over the query's largest coordinates, with Cauchy and Schwarz for the others, stays below the floor. The rest is
    verified by whole products. Nothing is pruned where products might not be exact in doubles."""
    if _large(q, x):
        floor = np.full(len(q), -np.inf)
    out = []
    qn, xn = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    top = xn.max(initial=0.0)
    live = np.flatnonzero((qn * top * SLACK >= floor) | (floor == -np.inf))
    cosine = floor[live] / np.maximum(qn[live] * top, 1e-300)
    tight = cosine > 0.5
    for i in live[tight]:
        focus = np.argsort(-np.abs(q[i]))[:FOCUS]
        part = x[:, focus]
        rest_q = np.sqrt(max(qn[i] ** 2 - (q[i, focus] ** 2).sum(), 0.0))
        rest_x = np.sqrt(np.maximum(xn**2 - (part * part).sum(axis=1), 0.0))
        bound = part @ q[i, focus] + rest_q * rest_x
        near = np.flatnonzero((bound + (SLACK - 1) * (np.abs(bound) + qn[i] * top) >= floor[i]) & (x_ids != q_ids[i]))
        out += _kept(q_ids[i], _products(q[i : i + 1], x[near])[0], x_ids[near], floor[i], k)
    loose = live[~tight]
    score = _products(q[loose], x)
    for j, i in enumerate(loose):
        own = x_ids != q_ids[i]
        out += _kept(q_ids[i], score[j][own], x_ids[own], floor[i], k)
    return out


def _kept(query: int, score: np.ndarray, ids: np.ndarray, floor: float, k: int) -> list[tuple]:
    at = best(score, ids, k)
    return [(int(query), int(ids[a]), int(score[a])) for a in at if score[a] >= floor]


def top_k(rows: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with is_query its k highest integer inner products with all others.

    Vectors are dealt into buckets of similar length and these by hash into cells of about CELL rows. Queries travel in
    blocks: first to one cell of long vectors, whose k-th score is a floor for the query, then with that floor to the cells
    of those buckets whose greatest length can still reach it. A vector shorter than a query counts as filled up with
    zeros. Each row is a candidate, repeated rows and ids too, except for queries of the same id; a repeated query id ranks
    the candidates of all its rows together, each as often as it has rows. Scores beyond the range of long are cut to it.
    With no candidates there are no rows for a query."""
    all_ = stored(vectors(rows).withColumn("_h", F.xxhash64("vec_id", F.monotonically_increasing_id())))
    stats = all_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.max(F.size("v")).alias("width")).collect()  # a row a bucket
    if not stats:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(r["width"] for r in stats)
    cells = lambda n: max(1, -(-n // CELL))
    of = F.array(*[F.struct(F.lit(r["bucket"]).alias("bucket"), F.lit(r["top"]).alias("top"), F.lit(cells(r["n"])).alias("cells")) for r in stats])
    split = F.create_map(*[F.lit(x) for r in stats for x in (r["bucket"], cells(r["n"]))])
    dealt = stored(all_.withColumn("cell", F.pmod("_h", split[F.col("bucket")]).cast("int")))
    queries = dealt.filter(is_query).select("vec_id", "v", "norm", "_h")
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("_h"), F.lit(blocks)).cast("int"))
    # the longest bucket that has vectors enough for a floor
    first = max(stats, key=lambda r: (min(r["n"], 4 * k), r["bucket"]))["bucket"]
    start = queries.withColumns({"floor": F.lit(float("-inf")), "bucket": F.lit(first), "cell": F.lit(0)})
    got = _search(start, dealt.filter((F.col("bucket") == first) & (F.col("cell") == 0)), k, width, blocks)
    floors = got.groupBy("vec_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # k a row of the query
    floors = stored(floors.select("vec_id", F.get("s", F.lit(k - 1)).cast("double").alias("low")))
    queries = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("low", F.lit(float("-inf"))))
    near = F.filter(of, lambda b: (F.col("floor") == float("-inf")) | (F.col("norm") * b["top"] * SLACK >= F.col("floor")))
    spread = queries.withColumn("b", F.explode(near)).withColumn("bucket", F.col("b.bucket")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("b.cells") - 1)))
    found = _search(spread, dealt, k, width, blocks)
    order = Window.partitionBy("vec_id").orderBy(F.col("score").desc(), "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("vec_id").alias("query_id"), "rank", F.col("other").alias("vec_id"), "score")


def _search(queries: DataFrame, dealt: DataFrame, k: int, width: int, blocks: int) -> DataFrame:
    """(vec_id, other, score) of the queries (vec_id, v, floor, block) in their cells (bucket, cell), at most k of each."""
    q = queries.select("bucket", "cell", "block", "vec_id", "v", "floor")
    x = dealt.select("bucket", "cell", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("vec_id").alias("id"), F.col("v").alias("x"))

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        got = []
        if len(one) and len(two):
            ids, floor, qids = two.column("id").to_numpy(), one.column("floor").to_numpy(), one.column("vec_id").to_numpy()
            xm, v = _matrix(two.column("x").combine_chunks(), width), one.column("v").combine_chunks()
            for at in range(0, len(qids), STEP):
                s = slice(at, at + STEP)
                got += search(_matrix(v[s], width), qids[s], floor[s], xm, ids, k)
        return pa.table([pa.array([g[i] for g in got], pa.int64()) for i in range(3)], names=["vec_id", "other", "score"])

    keys = ("bucket", "cell", "block")
    return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(run, "vec_id long, other long, score long")


def op10_norm_bucket_top_k(spark, sf_dir) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
