"""Open bins of all shards meet again; the search against best fit decreasing; very long texts."""

import numpy as np
import pytest

from mnemoflow.llm import packing


def pieces(spark, sizes):
    return spark.createDataFrame([(i, 0, 0, int(n), 7, "c") for i, n in enumerate(sizes)], "doc_id long, piece long, start long, length long, ids_crc32 long, color string")


def bins_of(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_many_shards_leave_hardly_more_bins_than_one(spark, monkeypatch):
    sizes = np.random.default_rng(1).integers(20, 700, 1_500)
    least = -(-int(sizes.sum()) // 2048)
    monkeypatch.setattr(packing, "SHARD", 100)
    rows = packing.pack(pieces(spark, sizes)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1_500)) and {r.color for r in rows} == {"c"}
    assert bins_of(rows) <= least + 2
    large = packing.pack(pieces(spark, [1_500] * 400)).collect()
    assert bins_of(large) == 400


def test_the_search_gains_on_best_fit_decreasing():
    rng = np.random.default_rng(2)
    gain = 0
    for seed in range(4):
        # Triples that fill a bin to the last token, for which best fit decreasing needs more bins.
        a, b = rng.integers(500, 800, 60), rng.integers(500, 800, 60)
        sizes = [*a.tolist(), *b.tolist(), *(2048 - a - b).tolist()]
        bins, room = [], []
        packing.best_fit(sorted(range(180), key=lambda i: (-sizes[i], i)), sizes, 2048, bins, room)
        best = packing.evolve(sizes, 2048, seed, [], 300)[0]
        assert sorted(i for x in best[1] for i in x) == list(range(180)) and len(best[1]) <= len(bins)
        gain += len(bins) - len(best[1])
    assert gain >= 2


def test_a_very_long_text(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "word " * 300_000), (2, "y")], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    own = sorted((r.start, r.length) for r in rows if r.doc_id == 1)
    assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and all(n == 2048 for _, n in own[1:])
    assert bins_of(rows) == -(-sum(r.length for r in rows) // 2048)
