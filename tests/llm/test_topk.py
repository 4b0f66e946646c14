"""Top-k keeps vectors with components of any finite size, with exact scores."""

import numpy as np
import pytest

from mnemoflow.llm.topk import top_k


@pytest.mark.parametrize("size", [1.0, 5e3, 1e5, 1e8, 1e300])
def test_large_components_take_part(spark, size):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=5) * size).tolist()) for i in range(120)]
    rows += [(200, [float("inf")] * 5), (201, [float("nan")] * 5), (202, [None] * 5), (203, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [n * 1024 // d for n, d in map(float.as_integer_ratio, v)] for i, v in rows[:120]}
    want = set()
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[i], strict=True)), i) for i in ints if i != q)[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    got = {(r.query_id, r["rank"], r.vec_id, int(r.score)) for r in top_k(df, df.where("vec_id % 50 = 0")).collect()}
    assert got == want
