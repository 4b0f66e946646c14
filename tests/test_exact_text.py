"""Contexts that equal their statements to the character: rounding of scores, and texts that are cut."""

import duckdb
from pyspark.sql import functions as F

from mnemoflow.functions import scalars as S
from mnemoflow.plans import bounded, catalog  # noqa: F401  registers the contexts


def test_fixed_rounds_the_exact_value_half_to_even(spark):
    xs = [0.0625, 0.1875, 0.1235, 0.0005, 1.0005, -0.0004, -2.5005, 0.5, 123456.7895, 3e12, *(i / 10000 for i in range(5, 10000, 10))]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.fixed(F.col("x"), 3).alias("three"), S.fixed(F.col("x"), 0).alias("none")).collect()
    assert [(r.three, r.none) for r in rows] == [(f"{r.x:.3f}", f"{r.x:.0f}") for r in rows]


def test_contexts_that_are_cut_equal_their_statements(spark, tmp_path):
    docs = [(i, f"the licensed {'long ' * 90} line {i}", "en", f"src{i % 3}", 480) for i in range(1, 41)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(i, [float(i % 5 + 1), float(i % 3), 1.0], i % 10) for i in range(41)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("context_adaptive", "context_nodes"):
        row = catalog.QUERIES[name](spark, str(tmp_path)).first()
        assert row["truncated"] and [tuple(row)] == con.execute(catalog.ORACLES[name]).fetchall(), name
