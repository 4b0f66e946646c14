"""Repeated ids and rows, empty tables, very long texts and clashing columns, operator by operator."""

import random

import numpy as np

from mnemoflow.llm import substring_dedup, topk, warc
from mnemoflow.llm.common import with_least


def test_warc_rows_that_share_a_page_id(spark, tmp_path):
    a, b = "a" * 1500, "b" * 1500
    rows = [(1, "u", a, "x"), (1, "u", b, "x"), (2, "u", a, "x"), (3, "u", b[:999], "x"), (3, "u", b[:999], "x"), (4, "u", "c" * 3_000_000, "x"), (None, "u", a, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    planned = {(r.page_id, bytes(r.payload).decode()[:1], r.refers_to) for r in warc.plan_revisits(pages).collect()}
    assert planned == {(1, "a", 2), (1, "b", None), (2, "a", None), (3, "b", None), (4, "c", None), (None, "a", None)}
    path = f"file://{tmp_path}/w"
    assert warc.write_archives(warc.plan_revisits(pages), path) == 7
    back = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, len(r.payload)) for r in warc.read_archives(spark, path, 4_096).collect())
    assert back == sorted([(1, "revisit", 2, 0), (1, "response", 0, 1500), (2, "response", 0, 1500), (3, "response", 0, 999), (3, "response", 0, 999), (4, "response", 0, 3_000_000), (0, "response", 0, 1500)])


def test_warc_of_an_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    assert warc.write_archives(warc.plan_revisits(pages), path) == 0
    assert warc.read_archives(spark, path).collect() == []


def test_top_k_of_repeated_ids_and_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 40, rng.integers(-3, 4, 4).astype(float).tolist(), "x", 1) for i in range(90)]
    rows += [rows[0], rows[0]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, part int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(table, table.where("vec_id % 20 = 0"), 5).collect())
    want = []
    for i, v, *_ in rows:
        if i % 20 == 0:
            best = sorted((-int(np.dot(v, u)) << 20, j) for j, u, *_ in rows if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(table.limit(0), table.limit(0)).collect() == [] and topk.top_k(table, table.limit(0)).collect() == []


def test_packed_hashes_are_read_as_written():
    rng = np.random.default_rng(1)
    for top in (1 << 20, 1 << 62):
        for n in (1, 2, 500):
            own = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            second = rng.integers(0, 1 << 16, len(own), dtype=np.uint16)
            a, b = substring_dedup._unpack(np.frombuffer(substring_dedup._pack(own, second), np.uint8))
            assert np.array_equal(a, own) and np.array_equal(b, second)


def test_windows_of_one_hash_but_another_second_one_stay(spark, monkeypatch):
    """With a first hash that makes all windows equal across groups, the second one decides."""
    true = substring_dedup.window_hashes
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 100)
    assert true(np.arange(40, dtype=np.uint64), 35, 3)[0] != true(np.arange(40, dtype=np.uint64), 35, 5)[0]
    texts = [" ".join(f"{k}{i}" for i in range(60)) for k in "abc"]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, part string")
    assert sorted(r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()) == [0, 0, 60, 60]


def test_substring_dedup_of_empty_tables_and_very_long_texts(spark):
    rng = random.Random(1)
    long = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[:50])), (3, "x" * 2_000_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == {1: (120_000, 50), 2: (50, 50), 3: (1, 0)}
    assert substring_dedup.dedup_substrings(docs.limit(0)).collect() == []


def test_least_of_hot_and_cold_keys(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 700}", 1_000 + i) for i in range(1_400)] + [(None, 1)]
    df = spark.createDataFrame(rows, "key string, value long")
    got = sorted((r.key, r.value, r.least) for r in with_least(df, "key", "value", "least").collect())
    low = {}
    for k, v in rows:
        low[k] = min(v, low.get(k, v))
    assert got == sorted((k, v, low[k]) for k, v in rows if k)
