"""Pages with totals, statistics over several groupings, scores of pairs with and without vectors, and the upkeep of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp, combined_decay, cosine, edge_decay, effective_shield, jaccard, lazy_weight, reinforce, round_to, temporal_proximity, time_decay, usage_decay

#: Orders of edges; ties go by the ends.
EDGE_ORDERS = {
    "weight_desc": (F.desc, "weight"),
    "weight_asc": (F.asc, "weight"),
    "activation_desc": (F.desc, "activation_count"),
    "recent_first": (F.desc_nulls_last, "last_event"),
}


def page(rows: DataFrame, *order: Column | str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of rows in that order, each with `total`, the number of all rows; an empty page has no rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def edges_page(edges: DataFrame, order: str = "weight_desc", offset: int = 0, limit: int = 50) -> DataFrame:
    way, column = EDGE_ORDERS[order]
    return page(edges, way(column), "source_id", "target_id", offset=offset, limit=limit)


MONITORED = ("weight", "effective_weight", "shield", "effective_shield", "activation_count", "decay_rate", "last_event")


def monitor(edges: DataFrame, now: float, by: str = "effective_weight", descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of edges by one of MONITORED, with weight and shield as they are after lazy decay (to four places) and the number of all edges."""
    gap = F.greatest(now - F.col("last_event"), F.lit(0.0))
    idle = (gap <= 0) | (F.col("decay_rate") <= 0)
    shield = F.when(idle, F.col("shield")).otherwise(effective_shield(F.col("shield"), gap))
    own = edges.withColumn("effective_weight", round_to(lazy_weight(F.col("weight"), F.col("shield"), F.col("decay_rate"), gap))).withColumn("effective_shield", round_to(shield))
    if by not in MONITORED:
        raise ValueError(f"edges are not ordered by {by}")
    return page(own, F.col(by).desc() if descending else F.col(by), "source_id", "target_id", offset=offset, limit=limit)


def node_totals(nodes: DataFrame) -> DataFrame:
    """(by, value, n) of nodes(node_type, node_role): all nodes, by role, and by type (null as `none`), in one pass."""
    each = nodes.select(F.explode(F.array(*(F.struct(F.lit(b).alias("by"), v.alias("value")) for b, v in (("all", F.lit("")), ("role", F.coalesce("node_role", F.lit("none"))), ("type", F.coalesce("node_type", F.lit("none"))))))).alias("k"))
    return each.groupBy("k.by", "k.value").agg(F.count("*").alias("n"))


def edge_totals(edges: DataFrame, now: float) -> DataFrame:
    """(edge_type, n, mean_weight, mean_effective, mean_shield, dead) of each type and of all (null): effective weights are those after lazy
    decay, an edge without any is dead; means to four places."""
    effective = lazy_weight(F.col("weight"), F.col("shield"), F.col("decay_rate"), F.greatest(now - F.col("last_event"), F.lit(0.0)))
    own = edges.select("edge_type", "weight", "shield", effective.alias("effective"))
    mean = lambda c: round_to(F.coalesce(F.avg(c), F.lit(0.0)))
    return own.rollup("edge_type").agg(F.count("*").alias("n"), mean("weight").alias("mean_weight"), mean("effective").alias("mean_effective"), mean("shield").alias("mean_shield"), F.count(F.when(F.col("effective") <= 0, 1)).alias("dead"))


def upsert_keeping(rows: DataFrame, updates: DataFrame, keys: tuple[str, ...], keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Keyed upsert in which an update replaces all columns but those of `keep`, which stay as a key was first written."""
    rest = [c for c in rows.columns if c not in keys]
    new = updates.select(*keys, F.struct(*rest).alias("_new"))
    both = rows.select(*keys, F.struct(*rest).alias("_old")).join(new, list(keys), "full_outer")
    pick = lambda c: F.when(F.col("_new").isNull() | (F.col("_old").isNotNull() if c in keep else F.lit(False)), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))
    return both.select(*keys, *(pick(c).alias(c) for c in rest))


def edge_type(source: Column, target: Column) -> Column:
    """What joins two kinds of nodes: a hub and a leaf `about`, any others `related`."""
    return F.when(((source == "hub") & (target == "leaf")) | ((source == "leaf") & (target == "hub")), "about").otherwise("related")


def score_against(reference: DataFrame, nodes: DataFrame, link: float = 0.3, most: int = 20) -> DataFrame:
    """(a, b, score, edge_type, weight) of one reference row against all other rows: those with a score of `link` or more, the best `most`.

    Rows are (id, role, seconds, terms, entities, uses, embedding). 0.2 temporal + 0.4 semantic + 0.2 co-occurrence + 0.2 entities, to three
    places; semantic is the cosine where both have a vector, else the overlap of terms. The reference is one row and is broadcast.
    """
    one = F.broadcast(reference.limit(1).select(*(F.col(c).alias(f"ref_{c}") for c in ("id", "role", "seconds", "terms", "entities", "uses", "embedding"))))
    both = nodes.join(one, F.col("id") != F.col("ref_id"))
    lower = lambda c: F.array_distinct(F.transform(c, F.lower))
    semantic = F.when(F.col("embedding").isNotNull() & F.col("ref_embedding").isNotNull(), cosine(F.col("ref_embedding"), F.col("embedding"))).otherwise(jaccard(F.col("ref_terms"), F.col("terms")))
    shared = F.least("uses", "ref_uses")
    together = F.when(F.greatest("uses", "ref_uses") > 0, F.least(F.lit(1.0), shared / (F.col("uses") + F.col("ref_uses") - shared))).otherwise(0.0)
    score = 0.2 * temporal_proximity(F.col("seconds") - F.col("ref_seconds")) + 0.4 * semantic + 0.2 * together + 0.2 * jaccard(lower("ref_entities"), lower("entities"))
    scored = both.select(F.col("ref_id").alias("a"), F.col("id").alias("b"), clamp(round_to(score, 3)).alias("score"), edge_type(F.col("ref_role"), F.col("role")).alias("edge_type"))
    linked = scored.where(F.col("score") >= link)
    return linked.withColumn("weight", F.greatest(F.lit(0.1), "score")).orderBy(F.col("score").desc(), "b").limit(most)


def reinforce_by_relevance(edges: DataFrame, scored: DataFrame, rate: float = 0.1) -> DataFrame:
    """(a, b, edge_type, weight, delta) of scored(a, b, score, edge_type): the weight of edges(source_id, target_id, edge_type, weight), 0 where there
    is none, grown by rate * score * headroom; both to four places."""
    old = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "edge_type", F.col("weight").alias("old"))
    joined = scored.join(old, ["a", "b", "edge_type"], "left").withColumn("old", F.coalesce("old", F.lit(0.0)))
    delta = rate * F.col("score") * (1 - clamp(F.col("old")))
    return joined.select("a", "b", "edge_type", round_to(clamp(F.col("old") + delta)).alias("weight"), round_to(delta).alias("delta"))


def access_anchors(anchors: DataFrame, used: DataFrame, rate: float = 0.05) -> DataFrame:
    """anchors with each of used(id, at) counted: w + rate * (1 - w) for every access, access_count, and the newest access as accessed_at."""
    n = used.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    both = anchors.join(n, "id", "left")
    out = both.withColumn("current_weight", F.when(F.col("_n") > 0, reinforce(F.col("current_weight"), rate, 1.0, F.col("_n"))).otherwise(F.col("current_weight")))
    return out.withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).withColumn("accessed_at", F.greatest("accessed_at", "_at")).drop("_n", "_at")


def expand_decayed(anchors: DataFrame, edges: DataFrame, least: float = 0.1, per_anchor: int = 5, k: int = 50) -> DataFrame:
    """expand() with edges after their decay: edges(source_id, target_id, weight, idle_seconds, decay_rate, activation_count) under `least` of effective
    weight are left out, each anchor(id, score) keeps the `per_anchor` that are best, and a leaf its best score."""
    from .graph import expand

    rate = F.coalesce("decay_rate", F.lit(0.01))
    effective = edge_decay(F.col("weight"), F.col("idle_seconds"), rate, F.coalesce("activation_count", F.lit(0)))
    return expand(anchors, edges.withColumn("weight", effective), least, per_anchor, k)


POLICIES = {
    "time": lambda t, u: t,
    "access": lambda t, u: u,
    "combined": combined_decay,
    "none": lambda t, u: F.lit(1.0),
}


def apply_decay(edges: DataFrame, policy: str = "combined", prune: float = 0.05, dry_run: bool = False) -> DataFrame:
    """edges(weight up to 1, idle_seconds, decay_rate, activation_count) after one of the policies time, access, combined or none.

    Edges whose rate is 0 or less are left as they are. Those under `prune` go; with `dry_run` nothing changes, and `new_weight` and `pruned` say
    what would.
    """
    time, use = time_decay(F.greatest("idle_seconds", F.lit(0.0)), F.col("decay_rate")), usage_decay(F.col("activation_count"))
    decays = F.col("decay_rate") > 0
    new = F.when(decays & F.lit(policy != "none"), F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("weight") * POLICIES[policy](time, use)))).otherwise(F.col("weight"))
    marked = edges.withColumn("new_weight", new).withColumn("pruned", decays & (F.col("new_weight") < prune))
    return marked if dry_run else marked.where(~F.col("pruned")).withColumn("weight", F.col("new_weight")).drop("new_weight", "pruned")


def simulation_events(edges: DataFrame, steps: int, size: int = 1) -> DataFrame:
    """(source_id, target_id, final_weight, dead, death_event, shield_event): of a simulation of `steps` steps of `size` events from each edge's last one,
    the first simulated events at which its weight and its shield are gone; null where that does not happen in it."""
    at = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    gap = (F.col("step") * size).cast("double")
    weight = lazy_weight(F.col("weight"), F.col("shield"), F.col("decay_rate"), gap)
    shield = F.when(F.col("decay_rate") <= 0, F.col("shield")).otherwise(F.greatest(F.col("shield") - 0.5 * gap, F.lit(0.0)))
    seen = at.select("source_id", "target_id", "step", (F.col("last_event") + gap).alias("event"), weight.alias("w"), shield.alias("s"))
    own = seen.groupBy("source_id", "target_id").agg(F.max_by("w", "step").alias("final"), F.min(F.when(F.col("w") <= 0, F.col("event"))).alias("death_event"), F.min(F.when(F.col("s") <= 0, F.col("event"))).alias("shield_event"))
    return own.select("source_id", "target_id", round_to(F.col("final")).alias("final_weight"), (F.col("final") <= 0).alias("dead"), "death_event", "shield_event")
