"""Costly rows of a table of one file go to all cores."""

from pyspark.sql import functions as F

from mnemoflow.operators import extract as X
from mnemoflow.plans import answers, catalog, more  # noqa: F401  register the parsers


def test_answers_of_one_file_are_parsed_by_all_cores(spark, sf_dir):
    for name in ("parse_nodes", "parse_episodes", "json_parse_facts"):
        assert catalog.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def test_kinds_of_values(spark):
    raw = ['{"a":{"b":[1]}}', "[1]", '"[1]"', '"{}"', "null", "1", "x", None]
    rows = spark.createDataFrame([(r,) for r in raw], "raw string").select(F.try_parse_json("raw").alias("v")).select(X.is_object(F.col("v")).alias("o"), X.each(F.col("v")).isNotNull().alias("e"), X.text(F.col("v")).alias("t"))
    assert [tuple(r) for r in rows.collect()] == [(True, False, None), (False, True, None), (False, False, "[1]"), (False, False, "{}"), *[(False, False, None)] * 4]
