"""Hard negatives for contrastive training: rows of another label that score just below a positive, found through a PCA rotation.

Vectors are scaled to integers, and scores are integer inner products. An orthogonal rotation, fitted on a bounded sample, turns
them so that the leading components hold most of their length. A candidate's score is summed up over leading components; the rest
is at most the product of both residual norms (Cauchy-Schwarz), and a slack covers the rounding of the doubles and the rotation's
distance from orthogonality. Candidates that cannot be among the best are left out after each group of components; what survives
is scored by integer products, which alone decide. The rotation changes the speed, never a result.

Candidates are dealt into blocks of about BLOCK rows, each moved once; the anchors go to every block and stream past it. Two
passes: the positives of an anchor (its K best rows of the same label), then for each positive the K best rows of another label
whose score s satisfies low * p <= 100 * s <= 100 * p, p being the positive's score. In both, a block gives K rows for each wish, and
the K best of all blocks meet in a window by anchor (and positive).

Defined cases: rows with a null id, label or vector, and vectors with null or non-finite components, take no part; of vectors of several
lengths the missing components count as 0; rows that bear an anchor's id are no candidates of it; repeated rows are candidates each, and
anchors each with results of their own; ties go to the smaller id; a positive with a negative score has no negatives, one of score
0 those of score 0; an empty table gives no rows; other columns are ignored. Scores are longs; where the components are so large that
64 bits may not hold a score, they are worked out in Python's integers and given as strings of decimal digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, table

BLOCK, LEAST_BLOCK, STEP, K, LONG = 65_536, 512, 8, 5, 2.0**62
#: Vectors that the rotation is fitted on, and how many numbers they hold at most; it decides how soon candidates are left out, nothing else.
SAMPLE, SAMPLE_NUMBERS = 4_096, 1 << 20
#: Relative error allowed for doubles, by component; several times what sums of products in any order can come to.
ULP = 2.0**-50


def fit_rotation(vectors: DataFrame, n: int, width: int) -> np.ndarray:
    """(width, width): orthonormal columns, those of the largest second moments of the sample first."""
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // width))
    rows = vectors.where(F.pmod(F.xxhash64("id", "v"), F.lit(max(1, n))) < most).select("v").limit(2 * most).collect()
    x = np.zeros((len(rows), width))
    for i, (v,) in enumerate(rows):
        x[i, : len(v)] = v
    # A power of two leaves the digits alone and keeps squares of large numbers finite.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(initial=0))[1])
    turned = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    return np.ascontiguousarray(turned) if np.isfinite(turned).all() else np.eye(width)


def integers(column: pa.Array, width: int, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) of doubles; as Python's integers where 64 bits may not do."""
    if not wide:
        flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
        out = np.zeros((len(column), width), np.int64)
        out[np.arange(width)[None, :] < sizes[:, None]] = np.floor(scale * flat)
        return out
    out = np.zeros((len(column), width), object)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = [n * scale // d for n, d in map(float.as_integer_ratio, v)]
    return out


class Rotated:
    """Rows turned by the rotation, with the norms of what follows each group of leading components."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray, unit: int):
        self.x = x
        small = x / float(unit) if x.dtype != object else np.array([[v / unit for v in r] for r in x], float).reshape(x.shape)
        y, d = small @ rotation, x.shape[1]
        ends = [*range(STEP, d, STEP), d]
        #: Groups of components, each in memory of its own.
        self.y = [np.ascontiguousarray(y[:, e - STEP if e % STEP == 0 else e - e % STEP : e]) for e in ends]
        self.rest = [np.sqrt((y[:, e:] ** 2).sum(1)) * (1 + d * ULP) for e in ends]
        self.norm = np.sqrt((small**2).sum(1)) * (1 + d * ULP)


def slack(rotation: np.ndarray) -> float:
    """Share of the product of two norms by which sums of rotated doubles may differ from the integers' product."""
    d = len(rotation)
    return 4 * (d**1.5 * ULP + np.abs(rotation.T @ rotation - np.eye(d)).sum(1).max())


def survivors(block: Rotated, one: Rotated, i: int, rows: np.ndarray, k: int, wishes: list[tuple[float, float]], loose: float) -> np.ndarray:
    """The rows that can be among the k best of a wish (least, most), scores within its limits, for row i of `one`."""
    so_far, norm = np.zeros(len(rows)), loose * one.norm[i]
    for y, z, rest, other in zip(block.y, one.y, block.rest, one.rest, strict=True):
        if len(rows) <= k:
            break
        so_far = so_far + y[rows] @ z[i]
        gap = rest[rows] * other[i] + norm * block.norm[rows] + 1e-290
        low, high = so_far - gap, so_far + gap
        live = np.zeros(len(rows), bool)
        for least, most in wishes:
            can = (high >= least) & (low <= most)
            sure = low[(low >= least) & (high <= most)]
            if len(sure) >= k:
                can &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            live |= can
        rows, so_far = rows[live], so_far[live]
    return rows


def _search(candidates: DataFrame, wanted: DataFrame, blocks: int, rotation: np.ndarray, unit: int, scale: int, wide: bool, k: int, low: int | None) -> DataFrame:
    """The k best rows of each block for each wish of wanted(key, id, label, v, positives): without `low`, of the anchor's label; with it, of
    another label within the limits that the positives (id, score) set. (key, positive, positive_score, id, score)."""
    width, score_type = rotation.shape[0], pa.string() if wide else pa.int64()
    to_text, loose = (str if wide else int), slack(rotation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, ids, labels = [], None, None, None
        current = None
        for batch in batches:
            own, is_query = batch.column("block").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
            # Rows come by block, candidates first; a batch is cut where either changes.
            at = [0, *(np.flatnonzero((np.diff(own) != 0) | (is_query[1:] != is_query[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(at, at[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if own[a] != current:
                    held, block, current = [], None, own[a]
                if not is_query[a]:
                    held.append(part)
                    continue
                if not held and block is None:
                    continue
                if block is None:
                    x = np.concatenate([integers(p.column("v"), width, scale, wide) for p in held])
                    ids = np.concatenate([p.column("id").to_numpy() for p in held])
                    labels = np.concatenate([p.column("label").to_numpy() for p in held])
                    order = np.argsort(ids, kind="stable")
                    block, ids, labels, held = Rotated(x[order], rotation, unit), ids[order], labels[order], []
                yield from found(part, block, ids, labels)

    def found(part: pa.RecordBatch, block: Rotated, ids: np.ndarray, labels: np.ndarray) -> Iterator[pa.RecordBatch]:
        one = Rotated(integers(part.column("v"), width, scale, wide), rotation, unit)
        out: list[tuple] = []
        for i, (key, own, label, positives) in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "id", "label", "positives")), strict=True)):
            begin, end = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
            fits = labels == label if low is None else labels != label
            fits[begin:end] = False
            rows = np.flatnonzero(fits)
            limits = [(-np.inf, np.inf)]
            if low is not None:
                # Slightly widened, as these are integers' quotients; the integers decide below.
                scores = [int(p["score"]) for p in positives]
                limits = [(_down(low * p, 100 * unit * unit), _up(p, unit * unit)) for p in scores if p >= 0]
            if not len(limits):
                continue
            rows = survivors(block, one, i, rows, k, limits, loose)
            exact = block.x[rows] @ one.x[i] if len(rows) else np.zeros(0, np.int64)
            if low is None:
                for j in np.lexsort((ids[rows], -exact))[:k]:
                    out.append((key, None, None, int(ids[rows[j]]), to_text(exact[j])))
                continue
            order = np.lexsort((ids[rows], -exact))
            ordered = [int(v) for v in exact[order]]
            for p, s in zip(positives, scores, strict=True):
                at = [j for j, v in zip(order, ordered, strict=True) if low * s <= 100 * v and v <= s][:k]
                out.extend((key, p["id"], to_text(s), int(ids[rows[j]]), to_text(exact[j])) for j in at)
        columns = zip(*out, strict=True) if out else [()] * 5
        kinds = (pa.string(), pa.int64(), score_type, pa.int64(), score_type)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "positive", "positive_score", "id", "score"])

    none = F.lit(None)
    score = "string" if wide else "bigint"
    left = candidates.select("block", F.lit(False).alias("is_query"), none.cast("string").alias("key"), "id", "label", "v", none.cast(f"array<struct<id:bigint,score:{score}>>").alias("positives"))
    right = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_query"), "key", "id", "label", "v", "positives")
    dealt = left.union(right).repartition(blocks, "block").sortWithinPartitions("block", "is_query")
    return dealt.mapInArrow(run, f"key string, positive long, positive_score {score}, id long, score {score}")


def _down(x: int, by: int) -> float:
    return x / by * (1 - 1e-12) - 1e-290


def _up(x: int, by: int) -> float:
    return x / by * (1 + 1e-12) + 1e-290


def hard_negatives(vectors: DataFrame, anchors: DataFrame, k: int = K, low: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row of anchors among vectors, both of
    (vec_id, label, embedding): the k hardest negatives of each of its k best positives, from `low` per cent of the positive's score on."""
    fine = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))

    def ready(df: DataFrame) -> DataFrame:
        own = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
        return own.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))

    left, right = ready(vectors), ready(anchors)
    top = F.max(F.array_max(F.transform("v", F.abs)))
    (n, wide_x, top_x), (_, wide_q, top_q) = (df.agg(F.count("*"), F.max(F.size("v")), top).first() for df in (left, right))
    width, most = max(1, wide_x or 0, wide_q or 0), scale * max(top_x or 0.0, top_q or 0.0) + 1
    # Products of the ratio with 100 must fit too.
    wide = 100.0 * width * most * most >= LONG
    # A power of two above all components, so that rotated ones are small.
    rotation, unit = fit_rotation(left, n, width), 1 << max(0, int(np.frexp(max(top_x or 0.0, top_q or 0.0))[1]) + scale.bit_length())
    # Small tables are dealt out over some tasks too.
    blocks = max(1, -(-n // BLOCK), min(32, n // LEAST_BLOCK))
    candidates = left.withColumn("block", F.pmod(F.xxhash64("id", "v", "label"), F.lit(blocks)).cast("int"))
    # Repeated anchors are worked out once; `times` brings their rows back.
    key = F.concat_ws(":", F.col("id").cast("string"), F.sha2(F.to_json(F.struct("label", "v")), 256))
    wanted = save(right.withColumn("key", key).groupBy("key").agg(F.first("id").alias("id"), F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("times")), "anchors")

    # Digits of one sign and length sort as numbers do; a long sorts by itself.
    descending = (lambda c: [F.col(c).cast("long").desc()]) if not wide else (lambda c: [F.col(c).startswith("-"), F.when(F.col(c).startswith("-"), -F.length(c)).otherwise(F.length(c)).desc(), F.when(~F.col(c).startswith("-"), F.col(c)).desc(), F.col(c)])
    first = _search(candidates, wanted.withColumn("positives", F.lit(None).cast(f"array<struct<id:bigint,score:{'string' if wide else 'bigint'}>>")), blocks, rotation, unit, scale, wide, k, None)
    place = F.row_number().over(Window.partitionBy("key").orderBy(*descending("score"), "id"))
    best = first.withColumn("place", place).where(F.col("place") <= k)
    # Equal pairs (of repeated rows) are asked for once, and come back as often as they occur.
    positives = save(best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("all")), "positives")
    asked = wanted.join(positives, "key").withColumn("positives", F.array_distinct(F.transform("all", lambda p: F.struct(p["id"].alias("id"), p["score"].alias("score")))))
    second = _search(candidates, asked, blocks, rotation, unit, scale, wide, k, low)
    rank = F.row_number().over(Window.partitionBy("key", "positive", "positive_score").orderBy(*descending("score"), "id"))
    ranked = second.withColumn("rank", rank).where(F.col("rank") <= k)
    pairs = wanted.join(positives, "key").select("key", F.col("id").alias("anchor_id"), "times", F.explode("all").alias("p")).groupBy("key", "anchor_id", F.col("p.id").alias("positive"), F.col("p.score").alias("positive_score")).agg(F.sum("times").alias("times"))
    rows = ranked.join(pairs, ["key", "positive", "positive_score"]).withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return rows.select("anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Labels of rows divisible by 7 are moved on by one, as noise; anchors are the rows divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, c.vec_id AS c, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) AS BIGINT) AS s
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, c AS p, s AS ps FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, c) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, p.p, p.ps, s.c, s.s, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.c) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * ps <= 100 * s.s AND 100 * s.s <= 100 * ps)
SELECT a AS anchor_id, p AS positive_id, r AS rank, c AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE r <= 5
"""
