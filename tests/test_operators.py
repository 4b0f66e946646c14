"""Cases of single operators that the tables don't hold, by hand or against a plain fold."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

import mnemoflow.plans.more  # noqa: F401  registers its queries
from mnemoflow.functions import scalars as S
from mnemoflow.operators import entities, extract, graph, records, retrieval, weights
from mnemoflow.plans.catalog import QUERIES
from mnemoflow.sources import views as V
from mnemoflow.streaming import events


def test_rate_limit_equals_a_fold_per_key(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), start + dt.timedelta(seconds=rng.randrange(600))) for i in range(400)]
    got = {r["event_id"]: (r["allowed"], r["remaining"]) for r in events.rate_limit(spark.createDataFrame(rows, "event_id long, key long, ts timestamp"), 5, 60).collect()}
    want, state = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        reset, n = state.get(k, (t, 0))
        if n == 0 or t >= reset:
            reset, n = t + dt.timedelta(seconds=60), 0
        state[k] = reset, n + 1
        want[i] = (n + 1 <= 5, max(0, 4 - n))
    assert got == want


def test_sessions_of_a_stream_carry_over_micro_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    for k, minutes in enumerate(((0, 10), (20, 60), (61, 200))):
        spark.createDataFrame([(1, start + dt.timedelta(minutes=m)) for m in minutes], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    out = events.merged_sessions(events.run_to_end(events.session_parts(events.event_stream(spark, str(tmp_path), files_per_trigger=1), 1800), "t"), 1800)
    got = sorted((r["n"], (r["last_us"] - r["started_us"]) // 60_000_000, r["ended"]) for r in out.collect())
    assert got == [(1, 0, False), (2, 1, True), (3, 20, True)]


def test_session_stream_does_not_depend_on_the_order_of_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    start, every = dt.datetime(2024, 1, 1), {}
    for _ in range(20):
        rows = [(int(u), int(m)) for u, m in zip(rng.integers(0, 3, 12), rng.integers(0, 30_000, 12), strict=True)]
        for u, m in rows:
            every.setdefault(u, []).append(m)
        spark.createDataFrame([(u, start + dt.timedelta(minutes=m)) for u, m in rows], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    want = []
    for u, times in every.items():
        times.sort()
        cuts = [0, *(i for i in range(1, len(times)) if times[i] - times[i - 1] >= 360), len(times)]
        want += [(u, times[b - 1] - times[a], b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    got = [(r.user_id, (r.last_us - r.started_us) // 60_000_000, r.n) for r in QUERIES["session_stream"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_facts_are_read_leniently(spark):
    rows = [
        (0, 'So:\n```json\n{"facts": [{"content": " a ", "category": "DECISION", "confidence": 3, "entities": [" x ", ""]}]}\n```'),
        (1, 'text [{"content": "b"}, {"content": "  "}] end'), (2, ""), (3, None), (4, "nothing"), (5, '{"facts": 3}'),
    ]
    got = {r["i"]: r["f"] for r in spark.createDataFrame(rows, "i int, raw string").select("i", extract.facts(F.col("raw")).alias("f")).collect()}
    assert [tuple(x[:3]) + (x[3],) for x in got[0]] == [("a", "decision", 1.0, ["x"])]
    assert [tuple(x[:3]) for x in got[1]] == [("b", "other", 0.5)]
    assert got[2] == [] and got[3] == [] and got[4] is None and not got[5]


def test_fixed_points_of_decay(spark):
    row = spark.range(1).select(
        S.effective_shield(F.lit(10.0), F.lit(0.3)).alias("a"), S.effective_shield(F.lit(50.0), F.lit(200.0)).alias("b"), S.temporal_proximity(F.lit(7 * 86400.0)).alias("c"),
        S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0))).alias("d"), S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("e"),
    ).first()
    assert [round(x, 6) for x in row] == [9.85, 0, 0.5, 0, 0]


def test_decay_of_every_edge_equals_brute_force(spark, sf_dir):
    edges = V.weighted_edges(spark, sf_dir).select("source_id", "target_id", "weight", "shield", "decay_rate").collect()
    want = {}
    for e in edges:
        for t in range(11):
            shield = e.shield if e.decay_rate <= 0 else max(e.shield - 0.5 * t, 0)
            weight = e.weight if t == 0 or e.decay_rate <= 0 else max(e.weight - max(t * e.decay_rate - max(e.shield - 0.5 * t, 0), 0), 0)
            want[e.source_id, e.target_id, t] = weight, shield
    out = QUERIES["decay_simulate_all"](spark, sf_dir).collect()
    assert len(out) == len(want) == 11 * len(edges)
    assert all(abs(a - b) < 1e-4 for r in out for a, b in zip((r.weight, r.shield), want[r.source_id, r.target_id, r.step], strict=True))


def test_forecast_reaches_the_target(spark):
    row = spark.range(1).select(S.edge_decay(F.lit(0.9), S.seconds_to(F.lit(0.9), F.lit(0.02), F.lit(3)), F.lit(0.02), F.lit(3)).alias("w")).first()
    assert abs(row["w"] - 0.05) < 1e-9


def test_batch_top_k_equals_brute_force_over_many_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)] if i % 11 else None) for i in range(200)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("factor", F.lit(1.0))
    got = sorted(tuple(r) for r in retrieval.batch_top_k(table, table.where("id < 3").withColumnRenamed("id", "query_id"), 5, block=16).collect())
    norm = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v] if v else [0] * 4
    want = []
    for q, v in rows[:3]:
        near = sorted(((-int(max(0, sum(x * y for x, y in zip(norm(v), norm(u), strict=True))) * 1e4 + 0.5) / 1e4, i) for i, u in rows))[:5]
        want += [(q, i, -s) for s, i in near]
    assert [(q, i, round(s, 4)) for q, i, s in got] == sorted((q, i, round(s, 4)) for q, i, s in want)


def test_directed_traversal_expands_a_node_by_its_first_product(spark):
    edges = spark.createDataFrame([(1, 3, 0.2), (2, 3, 0.9), (3, 4, 1.0), (4, 1, 1.0)], "source_id long, target_id long, weight double")
    got = {r["id"]: (r["score"], r["hops"]) for r in graph.traverse_directed(edges, spark.createDataFrame([(1, 1.0), (2, 1.0)], "id long, score double")).collect()}
    assert got == {3: (0.9, 1), 4: (0.2, 2)}


def test_overflow_goes_to_the_shield(spark):
    edges = spark.createDataFrame([(1, 2, 90.0, 49.0, 0), (1, 3, 0.0, 5.0, 0)], "source_id long, target_id long, weight double, shield double, activation_count int")
    got = {r["target_id"]: (r["weight"], r["shield"]) for r in weights.reinforce_once(edges, 1.2).collect()}
    assert got == {2: (100.0, 50.0), 3: (100.0, 26.0)}


def test_keyed_merges_keep_the_newest(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "k int, v string, version int")
    new = spark.createDataFrame([(1, None, 2), (3, "c", 1)], "k int, v string, version int")
    assert sorted((r["k"], r["v"]) for r in records.merge_latest(rows, new, ("k",), "version").collect()) == [(1, None), (2, None), (3, "c")]


def test_entities_of_null_and_mixed_texts(spark):
    rows = [(0, None), (1, "Ask 'Blue Sky' about Node.js, GraphDb and the storage of graphdb graphs")]
    e, t = entities.extract_entities(F.col("text"))
    got = {r["i"]: (r["e"], r["t"]) for r in spark.createDataFrame(rows, "i int, text string").select("i", e.alias("e"), t.alias("t")).collect()}
    assert got[0] == ([], [])
    assert got[1] == (["Blue Sky", "Node.js", "GraphDb", "Ask", "Node"], ["storage", "graphs"])
