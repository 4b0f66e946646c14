"""Writes and keyed reads of records as DataFrame operators: appends with turn numbers, keyed merges, ordered lookups, depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEPTHS = {0: ("id", "node_type", "node_role", "frontmatter", "keywords", "last_event", "activation_count"), 1: ("lang", "source"), 2: ("summary",), 3: ("content",)}


def ingest(conversations: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) of conversations(conv_id, messages array<struct<role, text>>), turns from 0."""
    return conversations.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def append(messages: DataFrame, new: DataFrame) -> DataFrame:
    """new(conv_id, seq, role, text) with the turns that follow each conversation's last; seq orders the new ones."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("last"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq"))
    return new.withColumn("place", place).join(last, "conv_id", "left").select("conv_id", (F.coalesce("last", F.lit(-1)) + F.col("place")).alias("turn"), "role", "text")


def merge_latest(rows: DataFrame, updates: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """Keyed upsert: of all rows with equal keys the one of the greatest version stays (a partial maximum, one shuffle)."""
    rest = [c for c in rows.columns if c not in keys]
    both = rows.unionByName(updates)
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("best"))
    return best.select(*keys, "best.*")


def update_fields(rows: DataFrame, updates: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Bulk update by key: columns of updates(key, *columns) that are not null replace those of rows."""
    new = updates.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = rows.join(new, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*rows.columns)


def get_by_ids(spark: SparkSession, rows: DataFrame, ids: list[int]) -> DataFrame:
    """Rows by a given list of ids, with their place in it; unknown ids are left out. The list is the caller's parameter."""
    wanted = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, place int")
    return rows.join(wanted, "id")


def at_depth(nodes: DataFrame, depth: int) -> DataFrame:
    """The columns of a depth from 0 (reference) to 3 (all)."""
    return nodes.select(*(c for d, own in DEPTHS.items() if d <= depth for c in own))


def stale(rows: DataFrame, embeddings: DataFrame, key: str = "id") -> DataFrame:
    """(key, stale): rows whose text hash is not that of embeddings(key, hash); a row without one is stale."""
    known = embeddings.select(key, "hash").distinct()
    return rows.select(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("own")).join(known, key, "left").select(key, (~F.coalesce(F.col("own") == F.col("hash"), F.lit(False))).alias("stale"))


def evolve_identity(traits: DataFrame, updates: DataFrame, most: float = 0.1) -> DataFrame:
    """(agent_id, axis, value, changed) of traits(agent_id, axis, value) after updates of the same columns.

    A known axis moves towards its new value by at most `most` and stays within -1 and 1; moves up to 0.001 are left out; an
    unknown axis is added as it is.
    """
    joined = traits.join(updates.withColumnRenamed("value", "new"), ["agent_id", "axis"], "full_outer")
    wanted = F.col("new") - F.col("value")
    shift = F.when(wanted.isNotNull(), F.greatest(F.lit(-most), F.least(F.lit(most), wanted)))
    moves = F.coalesce(F.abs(shift) > 0.001, F.lit(False))
    moved = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") + shift))
    return joined.select("agent_id", "axis", F.when(F.col("value").isNull(), F.col("new")).when(moves, moved).otherwise(F.col("value")).alias("value"), (F.col("value").isNull() | moves).alias("changed"))


def identity_history(traits: DataFrame, updates: DataFrame, principles: DataFrame, versions: DataFrame, trigger: str, most: float = 0.1, evidence: int = 3) -> DataFrame:
    """(agent_id, version, change, triggered_by) of one cycle of evolution: each axis that moves or is new, and each new principle that rests on
    at least `evidence` sources; the version is that of versions(agent_id, version) plus one. Agents without a change, and unknown ones, have no row.

    traits(agent_id, axis, value), updates of the same columns, principles(agent_id, principle, sources array).
    """
    fixed = lambda c: F.format_string("%.2f", c)
    moved = evolve_identity(traits, updates, most).where("changed").join(traits.select("agent_id", "axis", F.col("value").alias("old")), ["agent_id", "axis"], "left")
    told = F.when(F.col("old").isNull(), F.concat("axis", F.lit(": new axis ("), fixed(F.col("value")), F.lit(")"))).otherwise(F.concat("axis", F.lit(": "), fixed(F.col("old")), F.lit(" → "), fixed(F.col("value"))))
    based = principles.where(F.size("sources") >= evidence).select("agent_id", F.concat(F.lit('new principle: "'), "principle", F.lit('"')).alias("change"))
    return moved.select("agent_id", told.alias("change")).union(based).join(versions, "agent_id").select("agent_id", (F.col("version") + 1).alias("version"), "change", F.lit(trigger).alias("triggered_by"))


def context_text(items: DataFrame, most: int = 15, chars: int = 4000, style: str = "markdown") -> DataFrame:
    """One row (text): the best items(id, score, content) in order, as many as fit into `chars`.

    Items are a bounded result list: they are cut to `most` before they meet in one row.
    """
    escaped = F.col("content")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    line = {"markdown": F.concat(F.lit("- "), "content"), "plain": F.col("content"), "xml": F.concat(F.lit('<memory id="'), F.col("id").cast("string"), F.lit('">'), escaped, F.lit("</memory>"))}[style]
    top = items.orderBy(F.col("score").desc(), "id").limit(most)
    own = top.select("id", "score", line.alias("line"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("score").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    fits = own.withColumn("place", F.row_number().over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("length", F.sum(F.length("line") + 1).over(order)).where(F.col("length") - 1 <= chars)
    return fits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n").alias("text"))
