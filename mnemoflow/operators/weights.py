"""Weight dynamics: each operator returns the edges with their new weights; a caller writes them as the next snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import absorb, activation_level, clamp, edge_decay, effective_shield, hebbian_delta, jaccard, lazy_weight, overflow, reinforce, round_to, shield_cap, temporal_proximity


def decay_lazy(edges: DataFrame, now: float) -> DataFrame:
    gap = F.greatest(now - F.col("last_event"), F.lit(0.0))
    idle = (gap <= 0) | (F.col("decay_rate") <= 0)
    shield = F.when(idle, F.col("shield")).otherwise(effective_shield(F.col("shield"), gap))
    return edges.withColumns({"weight": round_to(lazy_weight(F.col("weight"), F.col("shield"), F.col("decay_rate"), gap)), "shield": round_to(shield)})


def decay_absorb(edges: DataFrame, now: float, prune_below: float | None = None) -> DataFrame:
    """Both columns from the old ones, in one select."""
    weight, shield = absorb(F.col("weight"), F.col("shield"), F.col("decay_rate"), now - F.col("last_event"))
    out = edges.withColumns({"weight": round_to(weight), "shield": round_to(shield)})
    return out if prune_below is None else out.where(F.col("weight") >= prune_below)


def reinforce_batch(edges: DataFrame, used: DataFrame, rate: float, cap: float = 100.0) -> DataFrame:
    """Edges used n times in used(source_id, target_id) get n compounding steps; the uses are counted before the join."""
    counts = used.groupBy("source_id", "target_id").agg(F.count("*").alias("times"))
    joined = edges.join(counts, ["source_id", "target_id"], "left")
    return joined.withColumn("weight", round_to(F.when(F.col("times").isNull(), F.col("weight")).otherwise(reinforce(F.col("weight"), rate, cap, F.col("times"))))).drop("times")


def upsert(edges: DataFrame, updates: DataFrame, strategy: str = "max", keys: tuple[str, ...] = ("source_id", "target_id")) -> DataFrame:
    """Full outer join on the keys; both weights by replace, max, average or hebbian (1 - (1 - a)(1 - b))."""
    a, b = F.col("weight"), F.col("new_weight")
    both = {"replace": b, "max": F.greatest(a, b), "average": (a + b) / 2, "hebbian": 1 - (1 - a) * (1 - b)}[strategy]
    joined = edges.select(*keys, "weight").join(updates.select(*keys, F.col("weight").alias("new_weight")), list(keys), "full_outer")
    return joined.select(*keys, round_to(F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)).alias("weight"))


def merge_updates(edges: DataFrame, updates: DataFrame, strategy: str = "average", keys: tuple[str, ...] = ("source_id", "target_id")) -> DataFrame:
    """edges after any number of updates(keys, weight, seq) of a key, one after the other by seq; the first of a new key makes the edge.

    replace and max need no order or one comparison, hebbian is a product; an average of averages weighs an update by half for each that comes
    after it. Updates are summed up before they meet the edges; averages number a key's updates first, the oldest of more than a
    thousand weigh nothing that doubles could show.
    """
    own, k = updates.select(*keys, "weight", "seq"), list(keys)
    if strategy == "average":
        order = Window.partitionBy(*keys).orderBy(F.col("seq").desc(), F.col("weight").desc())
        own = own.withColumn("after", F.row_number().over(order) - 1)
        # Where there is no old weight, the first update stands for it and is not halved once more.
        first = F.max(F.struct("after", "weight"))
        merged = own.groupBy(*keys).agg(F.sum(F.col("weight") * F.pow(F.lit(0.5), F.col("after") + 1)).alias("part"), F.count("*").alias("n"), first["weight"].alias("first"))
        new = F.when(F.col("weight").isNull(), F.col("part") + F.col("first") * F.pow(F.lit(0.5), F.col("n"))).otherwise(F.col("part") + F.col("weight") * F.pow(F.lit(0.5), F.col("n")))
    elif strategy == "hebbian":
        merged = own.groupBy(*keys).agg(F.product(1 - F.col("weight")).alias("part"))
        new = 1 - (1 - F.coalesce("weight", F.lit(0.0))) * F.col("part")
    elif strategy == "max":
        merged = own.groupBy(*keys).agg(F.max("weight").alias("part"))
        new = F.greatest("weight", "part")
    else:
        merged = own.groupBy(*keys).agg(F.max(F.struct("seq", "weight"))["weight"].alias("part"))
        new = F.col("part")
    joined = edges.select(*keys, "weight").join(merged, k, "full_outer")
    return joined.select(*keys, round_to(F.when(F.col("part").isNull(), F.col("weight")).otherwise(new)).alias("weight"))


def pair_counts(events: DataFrame, most: int = 20, parts: int = 0) -> DataFrame:
    """(a, b, frequency, first_seen, last_seen) of unordered pairs within the first `most` items of an event.

    An event gives at most most * (most - 1) / 2 pairs; counts are summed before the shuffle. With `parts`, events(.., shard) lie in that
    many partitions by their shard; counts are summed within a shard and dealt into twice as many, whatever the session's number is.
    """
    shard = ["shard"] * bool(parts)
    own = events.where(F.size("nodes") >= 2).select(*shard, "event_id", F.slice("nodes", 1, most).alias("nodes"))
    left = own.select(*shard, "event_id", "nodes", F.posexplode("nodes").alias("at", "x"))
    each = left.select(*shard, "event_id", "x", F.explode(F.expr("slice(nodes, at + 2, size(nodes))")).alias("y"))
    pairs = each.select(*shard, "event_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    counts = pairs.groupBy(*shard, "a", "b").agg(F.count("*").alias("frequency"), F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen"))
    if not parts:
        return counts
    dealt = counts.drop("shard").repartition(2 * parts, "a", "b")
    return dealt.groupBy("a", "b").agg(F.sum("frequency").alias("frequency"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def hebbian(pairs: DataFrame, activations: DataFrame, rate: float = 0.1) -> DataFrame:
    """(a, b, delta, weight): new weights of pairs(a, b, weight) from both ends' activations(id, count)."""
    level = lambda name: activations.select(F.col("id").alias(name), activation_level(F.col("count")).alias(f"level_{name}"))
    joined = pairs.join(level("a"), "a").join(level("b"), "b")
    delta = hebbian_delta(rate, F.col("level_a"), F.col("level_b"), F.col("weight"))
    return joined.select("a", "b", round_to(delta).alias("delta"), round_to(F.least(F.lit(1.0), F.col("weight") + delta)).alias("weight"))


def simulate(edges: DataFrame, steps: int) -> DataFrame:
    """One row per edge and step 0 .. steps: lazily decayed weight and shield."""
    at = edges.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    gap = F.col("step").cast("double")
    return at.select("source_id", "target_id", "step", round_to(lazy_weight(F.col("weight"), F.col("shield"), F.col("decay_rate"), gap)).alias("weight"), round_to(F.when(F.col("decay_rate") <= 0, F.col("shield")).otherwise(effective_shield(F.col("shield"), gap))).alias("shield"))


def reinforce_once(edges: DataFrame, rate: float, importance: float = 0.0, cap: float = 100.0) -> DataFrame:
    """One step of every edge; weight beyond the cap goes to the shield."""
    raw = F.col("weight") + rate * cap * F.greatest(F.lit(0.0), (cap - F.col("weight")) / cap)
    weight, shield = overflow(raw, F.col("shield"), shield_cap(F.lit(importance)))
    return edges.withColumns({"weight": round_to(weight), "shield": round_to(shield), "activation_count": F.col("activation_count") + 1})


def hebbian_shield(edges: DataFrame, activations: DataFrame, rate: float = 0.1, cap: float = 100.0) -> DataFrame:
    """Edges between activated ends(id, count): weight grows by rate * cap * both levels * headroom, the excess goes to the shield."""
    level = lambda name: activations.select(F.col("id").alias(name), activation_level(F.col("count")).alias(f"level_{name}"))
    joined = edges.join(level("source_id"), "source_id").join(level("target_id"), "target_id")
    w = F.least(F.lit(cap), F.greatest(F.lit(0.0), F.col("weight")))
    delta = rate * cap * F.col("level_source_id") * F.col("level_target_id") * ((cap - w) / cap)
    weight, shield = overflow(w + delta, F.col("shield"), shield_cap(F.lit(0.0)))
    return joined.select("source_id", "target_id", round_to(delta).alias("delta"), round_to(weight).alias("weight"), round_to(shield).alias("shield"))


def decay_timed(edges: DataFrame, prune: float = 0.05) -> DataFrame:
    """edges(weight up to 1, idle_seconds, decay_rate, activation_count) after time and use decay, and whether to prune."""
    new = edge_decay(F.col("weight"), F.col("idle_seconds"), F.col("decay_rate"), F.col("activation_count"))
    return edges.withColumn("new_weight", new).withColumn("prune", F.col("new_weight") < prune).withColumn("new_weight", round_to(F.col("new_weight")))


def decay_factor(edges: DataFrame, factor: float, most: float | None = None, kinds: list[str] | None = None, prune_below: float | None = None) -> DataFrame:
    """Weights of the chosen edges times a factor; pruning holds for edges that are chosen by their decayed weight too."""
    chosen = lambda w: (w <= most if most is not None else F.lit(True)) & (F.col("edge_type").isin(*kinds) if kinds else F.lit(True))
    out = edges.withColumn("weight", F.when(chosen(F.col("weight")), F.greatest(F.lit(0.0), F.col("weight") * factor)).otherwise(F.col("weight")))
    return out if prune_below is None else out.where(~(chosen(F.col("weight")) & (F.col("weight") < prune_below)))


def edge_scores(pairs: DataFrame, least: float = 0.1) -> DataFrame:
    """pairs(a, b, seconds, terms_a, terms_b, shared, only_a, only_b, entities_a, entities_b) with score, of `least` or more.

    0.2 temporal + 0.4 semantic + 0.2 co-occurrence + 0.2 entity overlap, to three places.
    """
    lower = lambda c: F.array_distinct(F.transform(c, F.lower))
    total = F.col("only_a") + F.col("only_b") - F.col("shared")
    together = F.when(total > 0, F.least(F.lit(1.0), F.col("shared") / total)).otherwise(0.0)
    score = 0.2 * temporal_proximity(F.col("seconds")) + 0.4 * jaccard(F.col("terms_a"), F.col("terms_b")) + 0.2 * together + 0.2 * jaccard(lower("entities_a"), lower("entities_b"))
    return pairs.select("a", "b", clamp(round_to(score, 3)).alias("score")).where(F.col("score") >= least)
