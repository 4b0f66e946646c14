"""Concepts of conversations: greedy merging over names and aliases, edges between related ones, links from facts, persistence.

A conversation's concepts are those of one answer. They are cut to a bounded number before they meet in one row, where a fold over
that list merges them; everything between conversations and known concepts is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import round_to


def names(name: Column, aliases: Column) -> Column:
    """The lower-cased name and aliases, the name first."""
    return F.transform(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), F.lower)


def _without_repeats(every: Column, name: Column) -> Column:
    """Each text once, case aside, as it stands first, without the name."""
    return F.transform(F.array(F.transform(every, F.lower)), lambda low: F.filter(every, lambda a, i: (F.array_position(low, F.lower(a)) == i + 1) & (F.lower(a) != F.lower(name))))[0]


def _merged(sorted_: Column) -> Column:
    """The fold: each concept joins the first one kept so far that owns one of its names, its own name being asked first, or is kept.

    What a kept concept owns stays as it came; the aliases that it takes over widen its list of aliases only.
    """
    empty = F.slice(F.transform(sorted_, lambda c: F.struct(c["place"], c["name"], c["relevance"], c["aliases"], c["related"], names(c["name"], c["aliases"]).alias("own"))), 1, 0)

    def step(kept: Column, c: Column) -> Column:
        asked = names(c["name"], c["aliases"])
        owner = lambda n: F.array_position(F.transform(kept, lambda k: F.array_contains(k["own"], n)), F.lit(True))
        hit = F.coalesce(F.get(F.filter(F.transform(asked, owner), lambda p: p > 0), F.lit(0)), F.lit(0))
        new = F.concat(kept, F.array(F.struct(c["place"], c["name"], c["relevance"], c["aliases"], c["related"], asked.alias("own"))))
        both = lambda k: F.struct(k["place"], k["name"], k["relevance"], _without_repeats(F.concat(k["aliases"], c["aliases"], F.array(c["name"])), k["name"]).alias("aliases"), F.array_union(k["related"], c["related"]).alias("related"), k["own"])
        wider = lambda h: F.concat(F.slice(kept, F.lit(1), h - 1), F.array(both(F.element_at(kept, h))), F.slice(kept, h + 1, F.size(kept)))
        # A list of one, so that the hit is worked out once.
        return F.transform(F.array(hit.cast("int")), lambda h: F.when(h == 0, new).otherwise(wider(F.greatest(h, F.lit(1)))))[0]

    return F.aggregate(sorted_, empty, step)


def extract_concepts(found: DataFrame, known: DataFrame, least: float = 0.4, most: int = 20) -> DataFrame:
    """(conv_id, place, name, relevance, aliases, related) of found(conv_id, name, relevance[, place, aliases, related]): without irrelevant ones,
    the best `most` of a conversation, without those that known(name[, aliases]) has by name or alias, merged by name and alias.

    `place` is the place in the answer, which decides between equal relevances (the name where there is none).
    """
    texts = F.array().cast("array<string>")
    column = lambda df, c: F.coalesce(F.col(c), texts) if c in df.columns else texts
    order = Window.partitionBy("conv_id").orderBy(F.col("relevance").desc(), "place" if "place" in found.columns else F.lower(F.trim("name")), "name")
    top = found.where(F.col("relevance") >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    top = top.select("conv_id", "place", F.trim("name").alias("name"), F.col("relevance").cast("double").alias("relevance"), column(found, "aliases").alias("aliases"), column(found, "related").alias("related"))
    taken = known.select(F.explode(names(F.trim("name"), column(known, "aliases"))).alias("key")).distinct()
    old = top.select("conv_id", "place", F.explode(names(F.col("name"), F.col("aliases"))).alias("key")).join(taken, "key", "left_semi").select("conv_id", "place").distinct()
    novel = top.join(old, ["conv_id", "place"], "left_anti")
    each = novel.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "name", "relevance", "aliases", "related"))).alias("c"))
    return each.select("conv_id", F.inline(_merged(F.col("c")))).drop("own")


def concept_keys(kept: DataFrame) -> DataFrame:
    """(conv_id, key, place): which concept of its conversation a name or alias stands for, the last that bears it."""
    return kept.select("conv_id", "place", F.explode(names(F.col("name"), F.col("aliases"))).alias("key")).groupBy("conv_id", "key").agg(F.max("place").alias("place"))


def concept_edges(kept: DataFrame) -> DataFrame:
    """(conv_id, source, target, weight): one edge for each pair of concepts of a conversation of which one relates to the other, by the
    first mention. The weight is the mean relevance where the mention is a name, half the source's relevance where it is an alias."""
    keys = concept_keys(kept)
    source = kept.select("conv_id", F.col("place").alias("at"), F.lower("name").alias("key"), "relevance", "related").join(keys, ["conv_id", "key"]).withColumnRenamed("place", "source")
    mentioned = source.select("conv_id", "at", "source", "relevance", F.posexplode("related").alias("turn", "mention")).withColumn("key", F.lower("mention"))
    by_name = kept.select("conv_id", F.lower("name").alias("key"), F.struct("place", "relevance").alias("own")).groupBy("conv_id", "key").agg(F.min("own")["relevance"].alias("other"))
    linked = mentioned.join(keys.withColumnRenamed("place", "target"), ["conv_id", "key"]).where("source <> target").join(by_name, ["conv_id", "key"], "left")
    weight = F.when(F.col("other").isNull(), F.col("relevance") * 0.5).otherwise((F.col("relevance") + F.col("other")) / 2)
    first = linked.groupBy("conv_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.min(F.struct("at", "turn", "source", "target", round_to(weight, 2).alias("weight"))).alias("f"))
    return first.select("conv_id", "f.source", "f.target", "f.weight")


def fact_concept_edges(kept: DataFrame, facts: DataFrame, weight: float = 0.6) -> DataFrame:
    """(conv_id, fact_id, place, weight) of facts(conv_id, fact_id, entities): an edge to each concept of the conversation that an entity names."""
    mentioned = facts.select("conv_id", "fact_id", F.explode("entities").alias("entity")).select("conv_id", "fact_id", F.lower("entity").alias("key"))
    return mentioned.join(concept_keys(kept), ["conv_id", "key"]).select("conv_id", "fact_id", "place").distinct().withColumn("weight", F.lit(weight))


def persist_concepts(concepts: DataFrame, kept: DataFrame) -> DataFrame:
    """concepts(id, name, relevance, aliases, sources, metadata) with kept(conv_id, name, relevance, aliases, metadata) written to it.

    A concept of that name, case aside, takes over the aliases, the conversation and the greater relevance; its name and metadata stay. A new
    name makes a concept (id: a hash of it), of which the first conversation gives the name and later ones add as if one by one; their
    metadata is merged key by key, the last one's winning.
    """
    key = F.lower("name")
    sorted_ = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "name", value.alias("v")))), lambda s: s["v"])
    new = kept.groupBy(key.alias("key")).agg(
        F.min(F.struct("conv_id", "name"))["name"].alias("_name"), F.max("relevance").alias("_relevance"), F.array_distinct(F.flatten(sorted_(F.col("aliases")))).alias("_aliases"),
        F.array_sort(F.collect_set("conv_id")).alias("_sources"), F.aggregate(sorted_(F.map_entries("metadata")), F.create_map().cast("map<string,string>"), lambda a, m: _map_merge(a, F.map_from_entries(m))).alias("_metadata"),
    )
    both = concepts.withColumn("key", key).join(new, "key", "full_outer")
    there, texts = F.col("name").isNotNull(), F.array().cast("array<string>")
    return both.select(
        F.coalesce("id", F.xxhash64("key")).alias("id"), F.coalesce("name", "_name").alias("name"), F.greatest("relevance", "_relevance").alias("relevance"),
        F.array_union(F.coalesce("aliases", texts), F.coalesce("_aliases", texts)).alias("aliases"), F.when(F.col("_sources").isNull(), F.col("sources")).otherwise(F.array_union(F.coalesce("sources", F.array().cast(concepts.schema["sources"].dataType)), F.col("_sources"))).alias("sources"),
        F.when(there, F.col("metadata")).otherwise(F.col("_metadata")).alias("metadata"),
    )


def update_concepts(concepts: DataFrame, updates: DataFrame) -> DataFrame:
    """concepts after updates(id, relevance, aliases, source, metadata), one for an id: given values replace, lists are united, metadata is
    merged key by key with the update's values winning; nulls leave things alone."""
    texts = F.array().cast("array<string>")
    both = concepts.join(updates.select("id", *(F.col(c).alias(f"_{c}") for c in ("relevance", "aliases", "source", "metadata"))), "id", "left")
    out = both.withColumn("relevance", F.coalesce("_relevance", "relevance")).withColumn("aliases", F.array_union(F.coalesce("aliases", texts), F.coalesce("_aliases", texts)))
    out = out.withColumn("sources", F.when(F.col("_source").isNull() | F.array_contains("sources", F.col("_source")), F.col("sources")).otherwise(F.array_append("sources", F.col("_source"))))
    return out.withColumn("metadata", F.when(F.col("_metadata").isNull(), F.col("metadata")).otherwise(_map_merge(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.col("_metadata")))).select(*concepts.columns)


def _map_merge(old: Column, new: Column) -> Column:
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(new.isNull(), old).otherwise(F.map_concat(kept, new))
