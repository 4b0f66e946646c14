"""Graph operators over edges(source_id, target_id, weight, ...): levels are joins, a node keeps its best score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_to


def step(level: DataFrame, edges: DataFrame, *columns) -> DataFrame:
    """What the frontier level(id, ...) meets, in both directions of the edges: id of the other end, and the given columns.

    The frontier is joined as it is; nothing is grouped or turned round beforehand.
    """
    out = level.join(edges, F.col("id") == F.col("source_id")).select(F.col("target_id").alias("id"), *columns)
    back = level.join(edges, F.col("id") == F.col("target_id")).select(F.col("source_id").alias("id"), *columns)
    return out.union(back)


def traverse(edges: DataFrame, seeds: DataFrame, hops: int = 2, least_weight: float = 0.1, hop_decay: float = 0.7, least_score: float = 0.05) -> DataFrame:
    """(id, score, hops) from seeds(id, score): best product of weight * hop_decay over walks of at most `hops` edges.

    Each level joins the frontier with the edges and keeps the best score of a node, so that a frontier has at most one row a
    node. `edges` has weights up to 1.
    """
    own = edges.where(F.col("weight") >= least_weight).select("source_id", "target_id", "weight")
    level = seeds.groupBy("id").agg(F.max("score").alias("score"))
    reached = level.select("id", "score", F.lit(0).alias("hops"))
    for hop in range(1, hops + 1):
        met = step(level, own, (F.col("score") * F.col("weight") * hop_decay).alias("score")).where(F.col("score") >= least_score)
        level = met.groupBy("id").agg(F.max("score").alias("score"))
        reached = reached.union(level.select("id", "score", F.lit(hop).alias("hops")))
    best = reached.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "hops")).alias("b"))
    return best.select("id", round_to(-F.col("b.s")).alias("score"), F.col("b.hops").alias("hops"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, depth): least number of edges from a seed, up to `hops`."""
    own = edges.select("source_id", "target_id")
    seen = level = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    for hop in range(1, hops + 1):
        level = step(level.select("id"), own).distinct().withColumn("depth", F.lit(hop))
        seen = seen.union(level)
    return seen.groupBy("id").agg(F.min("depth").alias("depth"))


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def neighbors(edges: DataFrame, node: int) -> DataFrame:
    """(id, weight) of the nodes next to one, by their greatest weight."""
    own = edges.where((F.col("source_id") == node) | (F.col("target_id") == node))
    other = F.when(F.col("source_id") == node, F.col("target_id")).otherwise(F.col("source_id"))
    return own.groupBy(other.alias("id")).agg(F.max("weight").alias("weight"))


def best_per_source(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges of each source; the row numbers are cut on the map side too."""
    order = Window.partitionBy("source_id").orderBy(F.col("weight").desc(), "target_id")
    return edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def expand(anchors: DataFrame, edges: DataFrame, least: float = 0.1, per_anchor: int = 5, k: int = 50) -> DataFrame:
    """(id, score): leaves of scored anchors(id, score), anchor score times edge weight, best per leaf."""
    top = best_per_source(edges.where(F.col("weight") >= least).join(anchors.select(F.col("id").alias("source_id"), "score"), "source_id"), per_anchor)
    best = top.groupBy(F.col("target_id").alias("id")).agg(F.max(F.col("score") * F.col("weight")).alias("score"))
    return best.select("id", round_to(F.col("score")).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are in nodes(id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(ids, F.col("target_id") == F.col("id"), "left_semi")


def traverse_directed(edges: DataFrame, seeds: DataFrame, hops: int = 2, least_weight: float = 0.1) -> DataFrame:
    """(id, score, hops) of what seeds(id, score) reach along edges: products of weights, best per node.

    A node is expanded once, with the product by which it was first found: by its parent's place, then weight, then id.
    """
    own = edges.where(F.col("weight") >= least_weight).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight")
    level = seeds.select("id", "score", F.struct(F.col("id").alias("p"), F.lit(0.0).alias("w"), F.col("id").alias("i")).alias("place"))
    done, reached = level.select("id"), None
    for hop in range(1, hops + 1):
        found = level.join(own, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("score") * F.col("weight")).alias("score"), F.struct(F.col("id").alias("p"), (-F.col("weight")).alias("w"), F.col("dst").alias("i")).alias("place"))
        best = found.groupBy("id").agg(F.max("score").alias("score"), F.min_by("score", "place").alias("first"), F.min("place").alias("place"))
        new = best.select("id", "score", F.lit(hop).alias("hops"))
        reached = new if reached is None else reached.union(new)
        level = best.join(done, "id", "left_anti").select("id", F.col("first").alias("score"), "place")
        done = done.union(level.select("id"))
    return reached.groupBy("id").agg(F.max("score").alias("score"), F.min("hops").alias("hops")).select("id", round_to(F.col("score")).alias("score"), "hops")


def expand_results(edges: DataFrame, seeds: DataFrame, items: DataFrame, hops: int = 2, weight: float = 0.8) -> DataFrame:
    """(id, score) of nodes that traverse() reaches from the seeds and that are neither seeds nor items."""
    found = traverse(edges, seeds, hops).join(seeds.select("id").union(items.select("id")).distinct(), "id", "left_anti")
    return found.select("id", round_to(F.col("score") * weight).alias("score"))


def relationship(edges: DataFrame, a: int, b: int) -> DataFrame:
    """All edges between two nodes, in both directions."""
    return edges.where(((F.col("source_id") == a) & (F.col("target_id") == b)) | ((F.col("source_id") == b) & (F.col("target_id") == a)))


def seeds_by_terms(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(id, term): the first of the terms that the content of nodes(id, content) holds, case aside."""
    text = F.lower("content")
    first = F.coalesce(*(F.when(text.contains(t.lower()), F.lit(t)) for t in terms))
    return nodes.select("id", first.alias("term")).where("term is not null")


def bounded_subgraph(edges: DataFrame, center: int, hops: int = 2, most: int = 200, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a node: nodes(id, depth, place) of at most `most`, and edges(source_id, target_id, weight) between them.

    Nodes are taken up in the order of a search in breadth: by the place of the node they are met from, then by the edge's weight, then by id;
    the search ends with the node that fills the budget, and edges met after it are left out. A level's frontier, of `most` ids at most, goes
    through the driver; the edges it meets do not.
    """
    spark, kind = edges.sparkSession, edges.schema["source_id"].dataType.simpleString()
    own = edges.where(F.col("weight") >= least).select("source_id", "target_id", "weight")
    visited, frontier, met = {center: (0, 0)}, [(center, 0)], None
    for hop in range(1, hops + 1):
        if not frontier or len(visited) >= most:
            break
        level = spark.createDataFrame(frontier, f"id {kind}, place int")
        way = F.struct("place", (-F.col("weight")).alias("w"), "other", "source_id", "target_id").alias("way")
        out = level.join(own, F.col("id") == F.col("source_id")).withColumn("other", F.col("target_id"))
        back = level.join(own, (F.col("id") == F.col("target_id")) & (F.col("source_id") != F.col("target_id"))).withColumn("other", F.col("source_id"))
        found = out.union(back).select("other", way)
        # As many rows as are still wanted come back.
        new = found.where(~F.col("other").isin(list(visited))).groupBy("other").agg(F.min("way").alias("way")).orderBy("way").limit(most - len(visited))
        rows = new.select("other", "way.place", "way.w", "way.source_id", "way.target_id").collect()
        full = len(rows) == most - len(visited)
        if full:
            last = rows[-1]
            end = F.struct(F.lit(last["place"]).alias("place"), F.lit(last["w"]).cast(own.schema["weight"].dataType).alias("w"), F.lit(last["other"]).cast(kind).alias("other"), F.lit(last["source_id"]).cast(kind).alias("source_id"), F.lit(last["target_id"]).cast(kind).alias("target_id"))
            found = found.where(F.col("way") <= end)
        seen = found.select("way.source_id", "way.target_id", (-F.col("way.w")).alias("weight"))
        met = seen if met is None else met.union(seen)
        frontier = [(r["other"], i) for i, r in enumerate(rows)]
        visited |= {r["other"]: (hop, len(visited) + i) for i, r in enumerate(rows)}
    nodes = spark.createDataFrame([(i, *v) for i, v in visited.items()], f"id {kind}, depth int, place int")
    ids = list(visited)
    none = own.limit(0) if met is None else met
    return nodes, none.where(F.col("source_id").isin(ids) & F.col("target_id").isin(ids)).distinct()


def local_graph(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): reach() from the seeds, and each edge once that has an end nearer than `hops` edges."""
    nodes = reach(edges, seeds, hops)
    inner = nodes.where(F.col("depth") < hops).select("id")
    own = edges.select("source_id", "target_id", "weight")
    return nodes, own.join(inner, F.col("id") == F.col("source_id"), "left_semi").union(own.join(inner, F.col("id") == F.col("target_id"), "left_semi")).distinct()


def traverse_bounded(edges: DataFrame, seeds: DataFrame, leaves: DataFrame, hops: int = 2, least_weight: float = 0.1, most: int = 50, kinds: list[str] | None = None) -> DataFrame:
    """(id, score, depth, source) of the leaves(id) that seeds(id, score[, place]) reach along edges, by products of weights, until `most` are
    collected.

    Nodes are expanded in the order of a search in breadth, seeds by their place or id, each once and whole; the one that brings the number of leaves to `most` or beyond
    is the last. Of a leaf's products the greatest stays, with its depth and seed. At most `most` rows of counts a level reach the driver.
    """
    own = edges.where(F.col("weight") >= least_weight)
    own = (own.where(F.col("edge_type").isin(*kinds)) if kinds else own).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight")
    wanted = leaves.select("id").distinct()
    # A seed's place is its number in their order; the seeds are a bounded list.
    order = seeds.orderBy("place" if "place" in seeds.columns else "id").select("id", "score").collect()
    kinds_ = f"id {seeds.schema['id'].dataType.simpleString()}, score double, place array<double>"
    level = seeds.sparkSession.createDataFrame([(r["id"], float(r["score"]), [float(i)]) for i, r in enumerate(order)], kinds_).withColumn("source", F.col("id"))
    done, collected, left = level.select("id"), None, most
    for hop in range(1, hops + 1):
        child = F.concat("place", F.array(-F.col("weight").cast("double"), F.col("dst").cast("double")))
        found = level.join(own, F.col("id") == F.col("src")).select("place", child.alias("child"), F.col("dst").alias("id"), (F.col("score") * F.col("weight")).alias("score"), "source")
        leaf = found.join(wanted, "id", "left_semi")
        fresh = leaf if collected is None else leaf.join(collected.select("id").distinct(), "id", "left_anti")
        counts = fresh.groupBy("id").agg(F.min("place").alias("place")).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").limit(left).collect()
        end = None
        for r in counts:
            left -= r["n"]
            if left <= 0:
                end = F.array(*map(F.lit, r["place"]))
                break
        within = (lambda df: df.where(F.col("place") <= end)) if end is not None else (lambda df: df)  # noqa: B023
        new = within(leaf).select("id", "score", F.lit(hop).alias("depth"), "source", "child")
        collected = new if collected is None else collected.union(new)
        if end is not None or hop == hops:
            break
        first = found.groupBy("id").agg(F.min(F.struct("child", "score", "source")).alias("f"))
        level = first.join(done, "id", "left_anti").select("id", "f.score", "f.source", F.col("f.child").alias("place"))
        done = done.union(level.select("id"))
    best = collected.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "depth", "child", "source")).alias("b"))
    return best.select("id", (-F.col("b.s")).alias("score"), F.col("b.depth").alias("depth"), F.col("b.source").alias("source"))


def strongest_connections(weighted: DataFrame, memory: DataFrame, node: int, k: int = 20) -> DataFrame:
    """(id, weight, graph) of the k strongest neighbours of a node: each with its greatest weight among the weighted edges, or, where it has none,
    among the memory edges."""
    own = lambda df, name, order: neighbors(df, node).select("id", F.struct(F.lit(order).alias("order"), (-F.col("weight")).alias("w"), F.lit(name).alias("graph")).alias("c"))
    best = own(weighted, "weighted", 0).union(own(memory, "memory", 1)).groupBy("id").agg(F.min("c").alias("c"))
    return best.select("id", (-F.col("c.w")).alias("weight"), F.col("c.graph").alias("graph")).orderBy(F.col("weight").desc(), "id").limit(k)


def sample(nodes: DataFrame, edges: DataFrame, most: int = 500, hubs: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the most activated hubs of nodes(id, node_role, activation_count), at most `hubs`, leaves by activation up to `most` nodes in
    all, and the edges between them."""
    order = (F.col("activation_count").desc(), "id")
    first = nodes.where("node_role = 'hub'").orderBy(*order).limit(min(hubs, most)).select("id", "node_role", "activation_count")
    rest = nodes.where("node_role = 'leaf'").orderBy(*order).limit(most).select("id", "node_role", "activation_count")
    both = first.union(rest).orderBy(F.col("node_role"), *order).limit(most)
    return both, induced(edges, both)
