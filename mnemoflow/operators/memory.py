"""Facts, episodes, concepts and their links: writes, lookups over several tables, linking pipelines and their edges.

Snapshots go in, the next snapshot comes out. Nothing here collects a group into one row but bounded lists of one answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import capitalized, clamp, reinforce, round_to, shield_cap
from .entities import normalize_label

#: Events of a range of simulation_summary().
SPAN = 1_024


def append_new(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """rows and those of `new` whose key they do not hold; of new rows with one key one stays."""
    fresh = new.dropDuplicates([key]).join(rows.select(key), key, "left_anti")
    return rows.unionByName(fresh)


def without_source(concepts: DataFrame, source: int, column: str = "sources") -> DataFrame:
    """concepts with a source taken out of their list; those that had no other are gone, those without any source stay."""
    left = F.array_remove(column, source)
    return concepts.where((F.size(left) > 0) | (F.size(column) == 0) | F.col(column).isNull()).withColumn(column, left)


def increment(counters: DataFrame, changes: DataFrame) -> DataFrame:
    """counters(key, value) with changes(key, value) added; new keys begin at 0."""
    return counters.unionByName(changes).groupBy("key").agg(F.sum("value").alias("value"))


def split_by_status(traces: DataFrame) -> DataFrame:
    """The data of trace events in a column of its kind: what a start was given, what a completion returned, what an error said."""
    own = {"input": F.col("status") == "start", "output": F.col("status").isin("complete", "skipped"), "error": F.col("status") == "error"}
    return traces.select(*(c for c in traces.columns if c != "data"), *(F.when(f, F.col("data")).alias(n) for n, f in own.items()))


def lookup(ids: DataFrame, *tables: tuple[str, DataFrame]) -> DataFrame:
    """ids(id, ...) with (kind, content) of the first of the tables (kind, rows(id, content)) that holds the id; null where none does.

    The ids' side is joined with a union of the tables' own ids, so that a table is read once, by its two columns.
    """
    every = reduce(DataFrame.union, (rows.select("id", F.struct(F.lit(i).alias("place"), F.lit(kind).alias("kind"), F.col("content").alias("content")).alias("own")) for i, (kind, rows) in enumerate(tables)))
    first = every.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("own").alias("own"))
    return ids.join(first, "id", "left").select(*(ids[c] for c in ids.columns), F.col("own.kind").alias("kind"), F.col("own.content").alias("content"))


def typed_lookup(ids: DataFrame, *tables: tuple[str, DataFrame]) -> DataFrame:
    """ids(id, kind) with the content of the row of that kind."""
    every = reduce(DataFrame.union, (rows.select("id", F.lit(kind).alias("kind"), "content") for kind, rows in tables))
    return ids.join(every, ["id", "kind"], "left")


def facts_of_anchors(anchors: DataFrame, edges: DataFrame, facts: DataFrame, least: float, per_anchor: int = 5) -> DataFrame:
    """(anchor_id, fact_id, weight, score): of each of anchors(id, score) the heaviest edges to facts that are not superseded."""
    own = edges.where(F.col("weight") >= least).join(anchors.select(F.col("id").alias("source_id"), "score"), "source_id")
    live = own.join(facts.where(~F.col("superseded")).select(F.col("id").alias("target_id")), "target_id")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("weight").desc(), "target_id"))
    return live.withColumn("place", place).where(F.col("place") <= per_anchor).select(F.col("source_id").alias("anchor_id"), F.col("target_id").alias("fact_id"), "weight", "score")


def rerank_context(found: DataFrame) -> DataFrame:
    """(fact_id, anchors, weight, score) of facts_of_anchors(): its anchors in order, greatest weight and best score times weight."""
    return found.groupBy("fact_id").agg(F.array_sort(F.collect_set("anchor_id")).alias("anchors"), F.max("weight").alias("weight"), round_to(F.max(F.col("score") * F.col("weight"))).alias("score"))


def create_edges(edges: DataFrame) -> DataFrame:
    """New edges with weight between 0 and 100 and shield between 0 and what the importance allows."""
    cap = shield_cap(F.coalesce("importance", F.lit(0.0)))
    return edges.withColumn("weight", clamp(F.col("weight"), 0.0, 100.0)).withColumn("shield", F.least(F.greatest("shield", F.lit(0.0)), cap)).drop("importance")


def reinforce_paths(edges: DataFrame, anchors: DataFrame, results: DataFrame, rate: float = 0.1, cap: float = 1.0) -> DataFrame:
    """edges with those from a matched anchor to a result reinforced and counted once; `cap` is the scale of the weights."""
    hit = edges.join(anchors.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi").join(results.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")
    marked = edges.join(hit.select("source_id", "target_id", F.lit(True).alias("_hit")).distinct(), ["source_id", "target_id"], "left")
    on = F.coalesce("_hit", F.lit(False))
    new = F.when(on, F.least(F.lit(cap), reinforce(F.col("weight"), rate, cap))).otherwise(F.col("weight"))
    return marked.withColumn("weight", new).withColumn("activation_count", F.col("activation_count") + on.cast("long")).drop("_hit")


def best_connections(scored: DataFrame, most: int = 5) -> DataFrame:
    """The best `most` pairs of each node of scored(a, b, score)."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "b"))
    return scored.withColumn("place", place).where(F.col("place") <= most).drop("place")


def activate(nodes: DataFrame, used: DataFrame, event: float | Column) -> DataFrame:
    """nodes with the number of their rows in used(id) added to activation_count, and the event as last_event of those."""
    n = used.groupBy("id").agg(F.count("*").alias("_n"))
    event = F.lit(event) if not isinstance(event, Column) else event
    out = nodes.join(n, "id", "left").withColumn("last_event", F.when(F.col("_n") > 0, event).otherwise(F.col("last_event")))
    return out.withColumn("activation_count", F.col("activation_count") + F.coalesce("_n", F.lit(0))).drop("_n")


def create_hubs(mentioned: DataFrame, hubs: DataFrame, weight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(hubs, edges) of mentioned(entity, id): an entity goes to the hub with its label, or to a new one whose id is its hash.

    New hubs have a label with a capital; an edge joins a hub to each node that mentions it.
    """
    own = mentioned.select(normalize_label(F.col("entity")).alias("label_key"), "id").where("label_key <> ''").distinct()
    known = hubs.groupBy(normalize_label(F.col("label")).alias("label_key")).agg(F.min("id").alias("hub_id"))
    linked = own.join(known, "label_key", "left")
    made = F.coalesce("hub_id", F.xxhash64("label_key"))
    new = linked.where("hub_id is null").select(F.xxhash64("label_key").alias("id"), capitalized(F.col("label_key")).alias("label")).distinct()
    return hubs.unionByName(new), linked.select(made.alias("source_id"), F.col("id").alias("target_id"), F.lit(weight).alias("weight")).distinct()


def link_anchors(decided: DataFrame, anchors: DataFrame, weight: float = 0.5) -> DataFrame:
    """(fact_id, anchor_id, label, weight, is_new) of decided(fact_id, decision): links to known anchors, and to new ones.

    A label that an anchor has, case aside, is a link to that (the smallest id). A label that none has makes one anchor, whose id is its hash,
    for the first answer and place that names it (is_new); every other one with that label is a link to it.
    """
    old = decided.select("fact_id", F.explode("decision.connect").alias("c")).select("fact_id", F.col("c.anchor_id").cast("long").alias("anchor_id"), F.lit(None).cast("string").alias("label"), "c.weight", F.lit(False).alias("is_new"))
    made = decided.select("fact_id", F.posexplode("decision.create").alias("place", "c")).select("fact_id", "place", "c.label", F.coalesce("c.weight", F.lit(weight)).alias("weight"), F.lower("c.label").alias("key"))
    known = anchors.groupBy(F.lower("label").alias("key")).agg(F.min("id").alias("known_id"))
    first = made.groupBy("key").agg(F.min(F.struct("fact_id", "place")).alias("first"))
    new = made.join(known, "key", "left").join(first, "key")
    is_new = F.col("known_id").isNull() & (F.struct("fact_id", "place") == F.col("first"))
    return old.unionByName(new.select("fact_id", F.coalesce("known_id", F.xxhash64("key")).alias("anchor_id"), "label", "weight", is_new.alias("is_new")))


def decay_summary(factors: DataFrame, least: float = 0.05) -> DataFrame:
    """One row of factors(weight, factor): processed, decayed (factor under 1), to prune (new weight under `least`), and the mean
    factor, 1 where there are none."""
    new = F.col("weight") * F.col("factor")
    return factors.agg(F.count("*").alias("processed"), F.count(F.when(F.col("factor") < 1, 1)).alias("decayed"), F.count(F.when(new < least, 1)).alias("prune"), round_to(F.coalesce(F.avg("factor"), F.lit(1.0))).alias("mean_factor"))


def simulation_summary(ends: DataFrame) -> DataFrame:
    """One row of ends(start, final, death): dying (a death is known), surviving, mean final weight, mean retention in per cent, and
    the upper median of the deaths where at least half of the edges die.

    The median is found by counts: of ranges of SPAN events first, then of the events of the range that holds it, so that a window orders no
    more rows than there are ranges, or events in one.
    """
    totals = ends.agg(F.count("*").alias("n"), F.count("death").alias("dying"), round_to(F.coalesce(F.avg("final"), F.lit(0.0))).alias("mean_final"), round_to(F.coalesce(F.avg(F.when(F.col("start") > 0, F.col("final") / F.col("start") * 100).otherwise(0.0)), F.lit(0.0)), 2).alias("mean_retention"))
    middle = F.floor(F.col("dying") / 2)
    whole = totals.select("dying")

    def holding(counts: DataFrame, key: str, before: str) -> DataFrame:
        """The first row of counts(key, k, before) up to which more than half of all come, `before` being what lies ahead of all rows."""
        upto = counts.withColumn("upto", F.col(before) + F.sum("k").over(Window.orderBy(key)))
        return upto.join(F.broadcast(whole)).where(F.col("upto") > middle).orderBy(key).limit(1)

    deaths = ends.where("death is not null").groupBy("death").agg(F.count("*").alias("k"))
    ranges = deaths.groupBy(F.floor(F.col("death") / SPAN).alias("range")).agg(F.sum("k").alias("k")).withColumn("none", F.lit(0))
    hit = holding(ranges, "range", "none").select("range", (F.col("upto") - F.col("k")).alias("ahead"))
    inside = deaths.withColumn("range", F.floor(F.col("death") / SPAN)).join(F.broadcast(hit), "range").select("death", "k", "ahead")
    at = holding(inside, "death", "ahead").agg(F.min("death").alias("middle"))
    return totals.join(F.broadcast(at)).select("dying", (F.col("n") - F.col("dying")).alias("surviving"), "mean_final", "mean_retention", F.when(2 * F.col("dying") >= F.col("n"), F.col("middle")).alias("median_death"))
