"""Search: vectors, full text (BM25), hybrid scores, merging and re-ranking. All take and return DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, cosine, event_decay, overlap, rerank_terms, round_to
from ..sources.shared import written
from .fulltext import Postings, Scan
from .graph import expand_results

Text = Scan | Postings

def vector_top_k(vectors: DataFrame, query: list[float], k: int = 10, least: float = 0.0, score: Column | None = None) -> DataFrame:
    """vectors(id, embedding, ...) by similarity to a query vector, rounded to four places; ties by id. Takes k per task first."""
    similarity = cosine(F.col("embedding"), F.array(*map(F.lit, map(float, query))))
    found = vectors.withColumn("similarity", similarity).where(F.col("similarity") >= least)
    return found.select("id", round_to(F.col("similarity") if score is None else F.col("similarity") * score).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def normalized(hits: DataFrame, score: str = "rank") -> DataFrame:
    """Best rank to 1, worst to 0, a single one to 1; the bounds are one broadcast row."""
    hits = written(hits.select("id", score), "hits")
    bounds = hits.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col(score)) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return hits.join(F.broadcast(bounds)).select("id", round_to(share).alias("fts_score"))


def hybrid(text: Text, vectors: DataFrame, terms: list[str], query: list[float], now: float, k: int = 20, candidates: int = 200, least: float = 0.1) -> DataFrame:
    """0.3 * text + 0.7 * similarity of the text candidates, with event decay; (id, score)."""
    found = normalized(text.best(terms, candidates))
    scored = found.join(text.nodes.select("id", "last_event"), "id").join(vectors.select("id", "embedding"), "id", "left")
    similarity = F.coalesce(cosine(F.col("embedding"), F.array(*map(F.lit, map(float, query)))), F.lit(0.0))
    score = round_to((0.3 * F.col("fts_score") + 0.7 * similarity) * event_decay(now - F.col("last_event")))
    return scored.select("id", score.alias("score")).where(F.col("score") >= least).orderBy(F.col("score").desc(), "id").limit(k)


def match_hubs(text: Text, vectors: DataFrame, terms: list[str], query: list[float], least: float = 0.85, enough: int = 3, k: int = 5, every: bool = False) -> DataFrame:
    """(id, score) of the hubs at least `least` similar, by 0.2 * text + 0.8 * similarity: of the text's hits among hubs where it has `enough`, else
    of all hubs, those that the text does not hit with 0 for it."""
    hub = F.col("node_role") == "hub"
    found = normalized(text.best(terms, 50, keep=hub, every=every))
    hits = F.broadcast(found.agg(F.count("*").alias("n")))
    near = cosine(F.col("embedding"), F.array(*map(F.lit, map(float, query))))
    all_ = text.nodes.where(hub).select("id").join(vectors.select("id", near.alias("near")), "id").where(F.col("near") >= least).join(found, "id", "left").join(hits)
    scored = all_.where((F.col("n") < enough) | F.col("fts_score").isNotNull())
    return scored.select("id", round_to(0.2 * F.coalesce("fts_score", F.lit(0.0)) + 0.8 * F.col("near")).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def merge_paths(vector: DataFrame, graph: DataFrame, weight: float = 0.6, bonus: float = 0.1, minmax: bool = True, least: float = 0.05, k: int = 20) -> DataFrame:
    """Two scored paths (id, score) by full outer join; items of both get a bonus; (id, score, n_sources)."""

    def ready(df: DataFrame, name: str) -> DataFrame:
        if not minmax:
            return df.select("id", F.col("score").alias(name))
        # The path is worked out once, for its bounds and its rows.
        df = written(df.select("id", "score"), "path")
        bounds = df.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        share = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
        return df.join(F.broadcast(bounds)).select("id", share.alias(name))

    both = ready(vector, "v").join(ready(graph, "g"), "id", "full_outer")
    score = F.when(F.col("g").isNull(), weight * F.col("v")).when(F.col("v").isNull(), (1 - weight) * F.col("g")).otherwise(weight * F.col("v") + (1 - weight) * F.col("g") + bonus)
    sources = F.col("v").isNotNull().cast("long") + F.col("g").isNotNull().cast("long")
    return both.select("id", round_to(clamp(score)).alias("score"), sources.alias("n_sources")).where(F.col("score") >= least).orderBy(F.col("score").desc(), F.col("n_sources").desc(), "id").limit(k)


def rerank(items: DataFrame, graph: DataFrame, query: str) -> DataFrame:
    """0.5 coarse + 0.35 graph (by its maximum) + 0.15 term overlap; unchanged where both are 0. items(id, score, content)."""
    top = graph.agg(F.max("score").alias("top"))
    scaled = graph.join(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("graph"))
    terms = rerank_terms(F.lit(query))
    joined = items.join(scaled, "id", "left").withColumn("graph", F.coalesce("graph", F.lit(0.0))).withColumn("content_score", overlap(terms, rerank_terms(F.col("content"))))
    new = 0.5 * F.col("score") + 0.35 * F.col("graph") + 0.15 * F.col("content_score")
    return joined.select("id", round_to(F.when((F.col("graph") == 0) & (F.col("content_score") == 0), F.col("score")).otherwise(new)).alias("score"))


def blend(items: DataFrame, relevance: DataFrame, alpha: float = 0.7, least: float = 0.1) -> DataFrame:
    """alpha * relevance + (1 - alpha) * score; items scored under `least` go, unscored ones stay as they are."""
    joined = items.join(relevance, "id", "left").where(F.col("relevance").isNull() | (F.col("relevance") >= least))
    return joined.select("id", round_to(F.when(F.col("relevance").isNull(), F.col("score")).otherwise(alpha * F.col("relevance") + (1 - alpha) * F.col("score"))).alias("score"))


def blend_top(items: DataFrame, relevance: DataFrame, most: int = 20, alpha: float = 0.7, least: float = 0.1) -> DataFrame:
    """blend() of the best `most` of items(id, score), a bounded list; the others are not judged and stay as they are."""
    top = items.orderBy(F.col("score").desc(), "id").limit(most)
    rest = items.join(top.select("id"), "id", "left_anti").select("id", "score")
    return blend(top, relevance, alpha, least).unionByName(rest)


def with_depth(items: DataFrame, nodes: DataFrame, full: int = 5) -> DataFrame:
    """(id, depth): of the best `full` items those that are known L2, other known ones L1, unknown ones L0."""
    top = items.orderBy(F.col("score").desc(), "id").limit(full).select("id", F.lit(True).alias("top"))
    known = items.select("id").join(nodes.select("id", F.lit(True).alias("known")), "id", "left").join(top, "id", "left")
    return known.select("id", F.when(F.col("known").isNull(), "L0").when(F.col("top"), "L2").otherwise("L1").alias("depth"))


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.0, block: int = 65_536, spread: int = 1_024) -> DataFrame:
    """(query_id, id, score) of the k most similar rows of vectors(id, embedding, factor) for each of queries(query_id, embedding).

    Candidates are dealt into blocks and move once; the queries go to every block and stream past it in Arrow batches, each a matrix
    product. The k best of a block meet in a window by query: no pair of rows is ever a row of Spark. Rows are kept from `least`
    similarity on; the score is the similarity times the row's factor, to four places. Vectors of another length than the block's or the batch's
    longest, null or zero ones score 0. Small tables are dealt out in blocks of `spread` rows too, over 32 tasks at most.
    """

    def matrix(column: pa.Array) -> np.ndarray:
        rows = column.to_pylist()
        width = max((len(r) for r in rows if r), default=0)
        m = np.array([r if r and len(r) == width else [0.0] * width for r in rows], float).reshape(len(rows), width)
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def best_of(part: pa.RecordBatch, a: np.ndarray, ids: np.ndarray, factor: np.ndarray) -> pa.RecordBatch:
        b, out = matrix(part.column("embedding")), []
        names = part.column("id").to_pylist()
        # Some rows at a time, so that a product holds no more than a few million numbers.
        step = max(1, (1 << 22) // max(1, len(a)))
        for begin in range(0, len(b), step):
            some = b[begin : begin + step]
            near = some @ a.T if a.shape[1] == b.shape[1] else np.zeros((len(some), len(a)))
            for q, row in zip(names[begin : begin + step], near, strict=True):
                row = np.maximum(row, 0)
                at = np.flatnonzero(row >= least)
                score = np.floor(row[at] * factor[at] * 1e4 + 0.5) / 1e4
                top = np.lexsort((ids[at], -score))[:k]
                out += zip([q] * len(top), ids[at][top].tolist(), score[top].tolist(), strict=True)
        q, i, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "id", "score"])

    def run(batches):
        current, held, block_ = None, [], None
        for batch in batches:
            own, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            # Rows come by block, candidates first; a batch is cut where either changes.
            cuts = [0, *(np.flatnonzero((np.diff(own) != 0) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if own[a] != current:
                    current, held, block_ = own[a], [], None
                if not asks[a]:
                    held.append(part)
                    continue
                if block_ is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    block_ = matrix(whole.column("embedding")), whole.column("id").to_numpy(), whole.column("factor").to_numpy()
                    held = []
                if block_ is not None:
                    yield best_of(part, *block_)

    n = vectors.count()
    blocks = max(1, -(-n // block), min(32, n // spread))
    left = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), F.col("id").cast("long").alias("id"), "embedding", F.col("factor").cast("double").alias("factor"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), F.col("query_id").cast("long").alias("id"), F.col("embedding").cast(left.schema["embedding"].dataType).alias("embedding"), F.lit(1.0).alias("factor"))
    found = left.union(right).repartition(blocks, "block").sortWithinPartitions("block", "asks").mapInArrow(run, "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "id", "score")


def hybrid_or_all(text: Text, vectors: DataFrame, terms: list[str], query: list[float], now: float, k: int = 20, enough: int = 5, least: float = 0.1, every: bool = False) -> DataFrame:
    """hybrid() where the text finds `enough` rows; else all vectors at 0.7 * similarity too, the better score by id."""
    hits = written(text.best(terms, 200, every=every), "hits")
    found = normalized(hits).join(vectors.select("id", "embedding"), "id", "left")
    near = F.coalesce(cosine(F.col("embedding"), F.array(*map(F.lit, map(float, query)))), F.lit(0.0))
    scored = found.select("id", (0.3 * F.col("fts_score") + 0.7 * near).alias("score"))
    if hits.limit(enough).count() < enough:
        scored = scored.union(vectors.select("id", (0.7 * near).alias("score"))).groupBy("id").agg(F.max("score").alias("score"))
    aged = scored.join(text.nodes.select("id", "last_event"), "id").select("id", round_to(F.col("score") * event_decay(now - F.col("last_event"))).alias("score"))
    return aged.where(F.col("score") >= least).orderBy(F.col("score").desc(), "id").limit(k)


def chunk_search(vectors: DataFrame, superseded: DataFrame, query: list[float], k: int = 20, least: float = 0.3) -> DataFrame:
    """The k most similar rows without those in superseded(id), which are taken off afterwards: fewer than k may stay."""
    return vector_top_k(vectors, query, k, least).join(superseded.select("id").distinct(), "id", "left_anti")


def recall(text: Text, vectors: DataFrame, edges: DataFrame, terms: list[str], query: list[float], now: float, k: int = 20) -> DataFrame:
    """Both paths: similar rows and what the graph reaches from the text's best rows, merged; (id, score, n_sources, depth)."""
    near = vector_top_k(vectors, query, 30)
    seeds = written(hybrid(text, vectors, terms, query, now, k=10, least=0.01), "seeds")
    reached = expand_results(edges, seeds, seeds.limit(0)).orderBy(F.col("score").desc(), "id").limit(50)
    merged = written(merge_paths(near, seeds.unionByName(reached), k=k), "merged")
    return merged.join(with_depth(merged, text.nodes), "id")
