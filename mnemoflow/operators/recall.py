"""Recall by anchors in its stages: anchors near the question, what hangs on them, re-ranking by graph and words, judged relevance, what
a search in breadth adds, and the reinforcement of the paths that led to the results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine, reinforce, round_to
from ..sources.shared import written
from . import graph as G
from . import retrieval as R


@dataclass(frozen=True)
class Recalled:
    """items(id, score, source, depth); anchors(id, similarity, score) that were activated; edges after reinforcement, with `reinforced`."""

    items: DataFrame
    anchors: DataFrame
    edges: DataFrame


def near_anchors(anchors: DataFrame, query: list[float], effective: Column, k: int = 10, least: float = 0.3) -> DataFrame:
    """(id, similarity, weight, score) of the k anchors(id, embedding, current_weight) of the best similarity times effective weight, at least
    `least` similar."""
    near = anchors.withColumn("similarity", cosine(F.col("embedding"), F.array(*map(F.lit, map(float, query))))).where(F.col("similarity") >= least)
    return near.select("id", "similarity", F.col("current_weight").alias("weight"), round_to(F.col("similarity") * effective).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def unified_recall(
    anchors: DataFrame, query: list[float], effective: Column, edges: DataFrame, nodes: DataFrame, question: str | None = None, relevance: DataFrame | None = None,
    k: int = 10, least_similarity: float = 0.3, per_anchor: int = 5, least: float = 0.05, judged: int = 20, added: int = 30, most: int = 20, rate: float = 0.05, deep: int = 5,
) -> Recalled:
    """Recall over anchors(id, embedding, current_weight, ...), edges(source_id, target_id, weight up to 1) and nodes(id, content).

    `question` switches the re-ranking on, relevance(id, relevance) the judgement of the best `judged` items: an item judged under 0.1 goes,
    those beyond the judged ones stay as they are. `added` is the budget of the search in breadth. The edges and anchors are read once;
    from the anchors on, all but the edges is bounded by the stages' numbers of rows.
    """
    edges = written(edges.select("source_id", "target_id", "weight"), "edges")
    found = written(near_anchors(anchors, query, effective, k, least_similarity), "anchors")
    own = found.select("id", "score")
    items = own.select("id", "score").union(G.expand(own, edges, 0.1, per_anchor).select("id", "score")).groupBy("id").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    if question is not None:
        seeds = found.select("id", F.col("similarity").alias("score"))
        reached = G.traverse(edges, seeds).select("id", "score").join(seeds.withColumnRenamed("score", "near"), "id", "full_outer").select("id", F.coalesce("near", "score").alias("score"))
        items = R.rerank(written(items, "items").join(nodes.select("id", "content"), "id", "left"), reached, question)
    if relevance is not None:
        items = R.blend_top(written(items, "ranked"), relevance, judged)
    items = written(items, "judged")
    seeds = found.select("id", F.col("weight").alias("score"), F.struct((-F.col("score")).alias("s"), "id").alias("place"))
    wider = G.traverse_bounded(edges, seeds, nodes, most=added)
    fresh = wider.join(items.select("id").union(found.select("id")).distinct(), "id", "left_anti").join(found.select(F.col("id").alias("source"), "similarity"), "source")
    new = fresh.select("id", round_to(F.col("score") * F.col("similarity") * 0.8).alias("score"), F.lit("graph").alias("source"))
    best = written(items.select("id", "score", F.lit("vector").alias("source")).unionByName(new).orderBy(F.col("score").desc(), "id").limit(most), "best")
    hit = edges.join(found.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(best.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", F.lit(True).alias("reinforced")).distinct()
    marked = edges.join(hit, ["source_id", "target_id"], "left").withColumn("reinforced", F.coalesce("reinforced", F.lit(False)))
    after = marked.withColumn("weight", F.when(F.col("reinforced"), reinforce(F.col("weight"), rate, 1.0)).otherwise(F.col("weight")))
    return Recalled(best.join(R.with_depth(best, nodes, deep), "id"), found, after)
