"""Sessions as state: over several micro-batches, against a loop."""

import datetime as dt
import random

from pyspark.sql import functions as F

from mnemoflow.streaming import events as T
from mnemoflow.streaming import lifecycle as L

START = dt.datetime(2024, 1, 1)


def run(spark, path, batches, timeout, ttl):
    for rows in batches:
        spark.createDataFrame([(k, START + dt.timedelta(seconds=s), kind) for k, s, kind in rows], "key long, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    stream = T.event_stream(spark, str(path), files_per_trigger=1).select("key", "ts", "kind")
    out = T.run_to_end(L.ended_sessions(stream, timeout, ttl, 0), "t")
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp())
    return sorted((r["key"], r["started_us"] // 1_000_000 - base, r["last_us"] // 1_000_000 - base, r["n"], r["reason"], r["ended_us"] // 1_000_000 - base) for r in out.collect())


def test_timers_end_sessions_across_micro_batches(spark, tmp_path):
    batches = [[(1, 0, "start"), (2, 0, "start"), (3, 5, "touch")], [(1, 50, "touch"), (3, 60, "end"), (3, 61, None)], [(1, 100, "touch"), (4, 155, "end")], [(1, 140, "touch"), (9, 300, "touch")], [(9, 301, "touch")]]
    assert run(spark, tmp_path, batches, 100, 130) == [(1, 0, 100, 3, "ttl_expired", 130), (1, 140, 140, 1, "timeout", 240), (2, 0, 0, 1, "timeout", 100), (3, 5, 60, 2, "explicit", 60), (3, 61, 61, 1, "timeout", 161)]


def test_sessions_equal_a_loop(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted({(s, k): kind for s, k, kind in ((rng.randrange(3000), rng.randrange(4), rng.choice(("touch", "touch", "touch", "start", "end"))) for _ in range(250))}.items())
    every = [(k, s, kind) for (s, k), kind in rows] + [(99, 9_000, "touch")]
    # Times of one file may meet those of the next, never lie before its newest.
    cuts = [0, 60, 61, 140, len(every) - 1, len(every)]
    got = run(spark, tmp_path, [rng.sample(every[a:b], b - a) for a, b in zip(cuts, cuts[1:], strict=False)], 60, 200)
    want, state = [], {}
    for k, s, kind in every:
        state[k], ended = L.step(state.get(k), s * 1_000_000, kind, 60_000_000, 200_000_000)
        want += [(k, e[0] // 1_000_000, e[1] // 1_000_000, e[2], e[3], e[4] // 1_000_000) for e in ended]
    for k, held in state.items():
        if held and k != 99:
            end, reason = L.deadline(held[0], held[1], 60_000_000, 200_000_000)
            want.append((k, held[0] // 1_000_000, held[1] // 1_000_000, held[2], reason, end // 1_000_000))
    assert got == sorted(want) and {r[4] for r in got} == {"timeout", "ttl_expired", "explicit"}


def test_rows_without_key_or_time_are_left_out(spark, tmp_path):
    spark.createDataFrame([(None, START, "start"), (1, None, "start"), (1, START, "start"), (2, START + dt.timedelta(seconds=500), "start")], "key long, ts timestamp, kind string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    stream = T.event_stream(spark, str(tmp_path)).select("key", "ts", "kind")
    assert T.run_to_end(L.ended_sessions(stream, 100, None, 0), "t").select(F.col("key")).collect() == [(1,)]
