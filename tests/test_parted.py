"""A task groups the keys of a bounded number of rows, however few partitions the session gives, with the results of the plain form."""

from pyspark.sql import functions as F

from mnemoflow.operators import weights as W
from mnemoflow.plans import catalog, upkeep  # noqa: F401  register the queries
from mnemoflow.sources import views as V

ROWS = 250


def both_forms(name, spark, sf_dir, monkeypatch):
    """The most rows of one partition, the rows of the form in parts, and those of the plain form."""
    monkeypatch.setattr(V, "PART", 1 << 40, raising=False)
    plain = sorted(map(tuple, catalog.QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(V, "PART", ROWS)
    out = catalog.QUERIES[name](spark, sf_dir).withColumn("_in", F.spark_partition_id()).collect()
    sizes = {}
    for r in out:
        sizes[r["_in"]] = sizes.get(r["_in"], 0) + 1
    return max(sizes.values()), sorted(tuple(r)[:-1] for r in out), plain


def test_simulated_edges_lie_in_parts_that_do_not_grow(spark, sf_dir, monkeypatch):
    most, parted, plain = both_forms("decay_simulation_events", spark, sf_dir, monkeypatch)
    assert most <= 2 * ROWS and parted == plain


def test_reinforced_edges_lie_in_parts_that_do_not_grow(spark, sf_dir, monkeypatch):
    most, parted, plain = both_forms("edge_reinforce_batch", spark, sf_dir, monkeypatch)
    assert most <= 2 * ROWS and parted == plain


def test_pairs_lie_in_parts_that_do_not_grow(spark, sf_dir, monkeypatch):
    most, parted, plain = both_forms("coret_pairs", spark, sf_dir, monkeypatch)
    assert most <= 4 * ROWS and parted == plain


def test_a_pair_of_every_event_is_summed_within_shards(spark):
    events = spark.range(1000).select(F.col("id").alias("event_id"), F.array(F.lit(7), F.lit(3), F.col("id") + 10).alias("nodes"), (F.col("id") % 32).alias("shard"))
    plain, parted = (sorted(map(tuple, W.pair_counts(df, parts=n).collect())) for df, n in ((events, 0), (events.repartition(2, "shard"), 2)))
    assert plain == parted and (3, 7, 1000, 0, 999) in parted
