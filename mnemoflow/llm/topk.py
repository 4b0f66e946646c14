"""Exact top-k search by inner product: no-random-access aggregation over sorted lists.

Candidates and queries are dealt into blocks; every query block meets every candidate block once. Within a block each
component has a list of the candidates sorted by it (for a negative query component it is read from the other end). Lists
are read sequentially and in step; a candidate's lower bound is the sum of what was read of it plus the worst that its
unread components can give, its upper bound the same with what the lists have reached. Reading stops when the k-th lower
bound is at least the upper bound of everything else seen and of the unseen; candidates that are left are resolved by reading
on. The k best of each block meet in a window by query.

Components are floor(1024 * x) of the double x; scores are exact 64-bit integers. The largest components bound every score:
where doubles could not hold the bounds exactly (2 ** 51), blocks are scored whole in 64 bits, and where 64 bits could not
hold a score, in Python's integers; scores are then strings of decimal digits.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, as query or candidate; so do rows
without an id; lengths may differ (missing components count as 0); ties go to the smaller id;
repeated rows are candidates each, and queries each with a ranking of its own; an empty table gives no rows; other columns are ignored.

How far lists are read depends on the data: components of one size and no correlation leave bounds so wide that nearly whole
lists are read (figures in the README); few large components stop the reading early.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

QUERY_BLOCK, CANDIDATE_BLOCK, EXACT, LONG = 256, 16_384, 2.0**51, 2.0**62


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def _integers(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(1024 * x) of doubles of any size, as Python's integers."""
    out = np.zeros((len(column), width), object)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = [n * 1024 // d for n, d in map(float.as_integer_ratio, v)]
    return out


def sorted_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per component the rows in descending order of it, and the values in that order: (dims, n) each."""
    order = np.argsort(-x, axis=0, kind="stable").T.copy()
    return order, np.take_along_axis(x.T, order, 1)


def nra(query: np.ndarray, x: np.ndarray, order: np.ndarray, values: np.ndarray, k: int, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can be among the k best of the block, and their exact scores; rows in `skip` do not take part."""
    n = x.shape[0]
    dims = np.flatnonzero(query)
    dims = dims[np.argsort(-np.abs(query[dims]) * (values[dims, 0] - values[dims, -1]), kind="stable")]
    if not len(dims):
        return np.arange(n), x @ query
    q = query[dims]
    worst = np.where(q > 0, q * values[dims, -1], q * values[dims, 0])
    low = np.full(n, worst.sum())
    slack = np.zeros(n)  # of a row: sum over its read components of (what the list reached - worst there)
    live = np.ones(n, bool)
    if skip is not None:
        live[skip] = False
    reached, depth = np.where(q > 0, q * values[dims, 0], q * values[dims, -1]), 0
    read = np.zeros((n, len(dims)), bool)
    step = max(k, n // 8)
    while True:
        to = min(n, depth + step)
        for j, d in enumerate(dims):
            rows = order[d, depth:to] if q[j] > 0 else order[d, n - to : n - depth]
            part = values[d, depth:to] if q[j] > 0 else values[d, n - to : n - depth]
            low[rows] += q[j] * part - worst[j]
            read[rows, j] = True
            reached[j] = q[j] * (part[-1] if q[j] > 0 else part[0])
        depth = to
        gap = (reached - worst).astype(float)
        slack = gap.sum() - read @ gap
        at = np.flatnonzero(live)
        if len(at) <= k or depth == n:
            break
        kth = np.partition(low[at], len(at) - k)[len(at) - k]
        live[at[low[at] + slack[at] < kth]] = False
        left = np.flatnonzero(live)
        # Few are left: their final scores are resolved, which reading on would give.
        if len(left) <= 4 * k or depth == n:
            break
    left = np.flatnonzero(live)
    return left, x[left] @ query


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of vectors for each row of queries, itself excepted by id; scores are longs, or
    strings of digits where the tables' components are too large for 64 bits."""
    scaled = F.transform(embedding, lambda v: F.floor(F.lit(1024.0) * v.cast("double")))
    fine = F.forall(embedding, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))

    def ready(df: DataFrame) -> DataFrame:
        return df.where(F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & fine)

    def form(df: DataFrame) -> DataFrame:
        return df.select(F.col(vec_id).cast("long").alias("id"), (F.transform(embedding, lambda v: v.cast("double")) if large else scaled).alias("v"))

    left, right = ready(vectors), ready(queries)
    top = F.max(F.array_max(F.transform(embedding, lambda v: F.abs(v.cast("double")))))
    (n, wide, top_x), (m, wide_q, top_q) = (df.agg(F.count("*"), F.max(F.size(embedding)), top).first() for df in (left, right))
    most = max(1, wide or 0, wide_q or 0) * (1024.0 * (top_x or 0) + 1) * (1024.0 * (top_q or 0) + 1)
    # A component alone must fit as well, though the other side's be small.
    large = max(most, 1024.0 * (top_x or 0), 1024.0 * (top_q or 0)) >= LONG
    left, right, matrix = form(left), form(right), _integers if large else _matrix
    width = max(wide or 0, wide_q or 0)
    blocks, parts = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    # A block of queries goes to each block of candidates, and the other way round.
    x = left.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = right.groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("own", F.sha1(F.to_json("v")))
    q = right.select("id", "v", "own", "times", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("v", "id"), F.lit(parts)).cast("int").alias("part"))

    def run(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if candidates.num_rows and wanted.num_rows:
            ids, mat = candidates.column("id").to_numpy(), matrix(candidates.column("v"), width)
            order, values = sorted_lists(mat) if most < EXACT else (None, None)
            by_id = np.argsort(ids, kind="stable")
            sorted_ids = ids[by_id]
            for qid, own_key, times, row in zip(*(wanted.column(c).to_pylist() for c in ("id", "own", "times")), matrix(wanted.column("v"), width), strict=True):
                own = by_id[np.searchsorted(sorted_ids, qid) : np.searchsorted(sorted_ids, qid, "right")]
                rows, score = nra(row, mat, order, values, k, own) if most < EXACT else (np.arange(len(ids)), mat @ row)
                keep = ids[rows] != qid
                rows, score = rows[keep], score[keep]
                best = np.lexsort((ids[rows], -score))[:k]
                out += ((qid, i, x, own_key, times) for i, x in zip(ids[rows[best]].tolist(), score[best].tolist(), strict=True))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        made = {n: pa.array(columns[c], k) for n, c, k in (("query_id", 0, pa.int64()), ("vec_id", 1, pa.int64()), ("own", 3, pa.string()), ("times", 4, pa.int64()))}
        if not large:
            return pa.table(made | {"score": pa.array(columns[2], pa.int64())})
        # Beside the digits, a key of fixed length in the order of scores.
        return pa.table(made | {"score": pa.array(map(str, columns[2]), pa.string()), "key": pa.array([(x + (1 << 2200)).to_bytes(276) for x in columns[2]], pa.binary())})

    found = x.groupBy("block", "part").cogroup(q.groupBy("block", "part")).applyInArrow(run, "query_id long, vec_id long, own string, times long, score " + ("string, key binary" if large else "long"))
    rank = F.row_number().over(Window.partitionBy("query_id", "own").orderBy(F.col("key" if large else "score").desc(), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
