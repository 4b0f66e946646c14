"""Engine tables over the given tables, as DataFrames and as DuckDB SQL for the oracles.

A scan names its columns, so that Parquet reads those alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalize_keywords

NODE_TYPES = ("semantic", "episodic", "procedural", "prospective", "emotional")
#: A node's frontmatter is its first sentence.
FIRST = "^[^.]*"
#: Rows of a table that one task groups.
PART = 250_000
EDGE_TYPES = ("about", "related", "caused", "precedes", "refines", "contradicts")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores: a table of few files would keep most of them idle where its rows are costly."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def parts(df: DataFrame) -> int:
    """In how many parts of about PART rows a table is grouped; 0 where the cores' shares are no larger anyhow."""
    n = -(-df.count() // PART)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else 0


def parted(df: DataFrame, *keys: str) -> DataFrame:
    """A table dealt by its keys before it is grouped by them, so that a task holds the keys of about PART rows, however large the table is.

    Without it a task holds those of its whole split, and of all partitions that were joined to 64 MB of compressed rows.
    """
    n = parts(df)
    return df.repartition(n, *keys) if n else df


def memory_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, NODE_TYPES), F.lit(None)), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"), kind.alias("node_type"), F.when(F.col("doc_id") % 20 == 0, "hub").otherwise("leaf").alias("node_role"), F.regexp_extract("text", FIRST, 0).alias("frontmatter"),
        normalize_keywords(F.concat_ws(" ", "lang", "source")).alias("keywords"), F.col("text").alias("summary"), F.col("text").alias("content"), "lang", "source",
        (F.col("doc_id") % 200).cast("double").alias("last_event"), (F.col("n_chars") % 50).alias("activation_count"),
    )


def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed, weights up to 100."""
    lines = read(spark, sf_dir, "lineitem").withColumnsRenamed({"l_partkey": "source_id", "l_suppkey": "target_id"})
    edges = parted(lines, "source_id", "target_id").groupBy("source_id", "target_id")
    kind = F.element_at(F.array(*map(F.lit, EDGE_TYPES)), ((F.col("source_id") + F.col("target_id")) % 6 + 1).cast("int"))
    own = edges.agg((F.max("l_quantity") * 2).alias("weight"), (F.max("l_discount") * 100).alias("shield"), F.max("l_tax").alias("decay_rate"), (F.min("l_orderkey") % 200).cast("double").alias("last_event"), F.count("*").alias("activation_count"))
    return own.withColumn("edge_type", kind)


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", ((F.col("label") + 1) / 10.0).alias("current_weight"), (F.col("vec_id") % 90 * 86400).cast("double").alias("idle_seconds"))


def co_retrieval_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's distinct parts in line order: the items that were retrieved together. Events of a `shard` lie in one partition, sixteen shards or so in each."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("node_id"), F.col("l_linenumber").alias("line"))
    n = parts(lines)
    lines = lines.withColumn("shard", F.pmod(F.xxhash64("event_id"), F.lit(16 * max(n, 1))))
    first = (lines.repartition(n, "shard") if n else lines).groupBy("shard", "event_id", "node_id").agg(F.min("line").alias("line"))
    return first.groupBy("shard", "event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "node_id"))), lambda s: s["node_id"]).alias("nodes"))


_TYPES = ", ".join(f"'{t}'" for t in NODE_TYPES)
_KINDS = ", ".join(f"'{t}'" for t in EDGE_TYPES)
#: DuckDB SQL of the same tables, as the body of a WITH entry.
SQL = {
    "nodes": f"""nodes AS (SELECT doc_id AS id, [{_TYPES}, NULL][doc_id % 6 + 1] AS node_type, CASE WHEN doc_id % 20 = 0 THEN 'hub' ELSE 'leaf' END AS node_role, regexp_extract(text, '{FIRST}') AS frontmatter,
      array_to_string(list_sort(list_distinct([lang, source])), ' ') AS keywords, text AS summary, text AS content, lang, source, CAST(doc_id % 200 AS DOUBLE) AS last_event, n_chars % 50 AS activation_count FROM documents)""",
    "edges": f"""edges AS (SELECT *, [{_KINDS}][(source_id + target_id) % 6 + 1] AS edge_type FROM (SELECT l_partkey AS source_id, l_suppkey AS target_id, max(l_quantity) * 2 AS weight, max(l_discount) * 100 AS shield,
      max(l_tax) AS decay_rate, CAST(min(l_orderkey) % 200 AS DOUBLE) AS last_event, count(*) AS activation_count FROM lineitem GROUP BY ALL))""",
    "anchors": "anchors AS (SELECT vec_id AS id, embedding, label, (label + 1) / 10.0 AS current_weight, CAST(vec_id % 90 * 86400 AS DOUBLE) AS idle_seconds FROM embeddings)",
    "co": "co AS (SELECT event_id, list(node_id ORDER BY line, node_id) AS nodes FROM (SELECT l_orderkey AS event_id, l_partkey AS node_id, min(l_linenumber) AS line FROM lineitem GROUP BY ALL) GROUP BY 1)",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """The head of a statement that defines these tables."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)


# Facts, episodes and concepts over the given tables, and their SQL.
_CATEGORIES = ("preference", "technical", "requirement", "decision", "context", "instruction", "knowledge", "relationship", "other")
_EPISODES = ("action", "decision", "event", "discovery")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, old = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("gone")).distinct()
    kind = F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("doc_id") % 9 + 1).cast("int"))
    return d.join(old, "doc_id", "left").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100).alias("conv_id"), (F.col("doc_id") % 8).alias("turn"), kind.alias("category"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("summary"), F.coalesce("gone", F.lit(False)).alias("superseded"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns of a conversation each; ids are negative."""
    kind = F.element_at(F.array(*map(F.lit, _EPISODES)), (F.col("conv_id") % 4 + 1).cast("int"))
    half = F.floor(F.col("turn") / 2)
    return read(spark, sf_dir, "conversations").groupBy("conv_id", half.alias("half")).agg(F.min("turn").alias("start_turn"), F.max("turn").alias("end_turn"), F.min("text").alias("content")).select((-(F.col("conv_id") * 1000 + F.col("half") + 1)).alias("id"), "conv_id", kind.alias("type"), "start_turn", "end_turn", "content")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000)).alias("relevance"), F.array_distinct(F.array(F.col("c_nationkey"), F.col("c_custkey") % 7)).alias("sources"), F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_name")).alias("content"))


SQL |= {
    "facts": f"""facts AS (SELECT doc_id AS id, doc_id % 100 AS conv_id, doc_id % 8 AS turn, [{", ".join(f"'{c}'" for c in _CATEGORIES)}][doc_id % 9 + 1] AS category, text AS content, CASE WHEN doc_id % 3 <> 0 THEN source END AS summary,
      doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL) AS superseded FROM documents)""",
    "episodes": f"""episodes AS (SELECT -(conv_id * 1000 + half + 1) AS id, conv_id, [{", ".join(f"'{c}'" for c in _EPISODES)}][conv_id % 4 + 1] AS type, start_turn, end_turn, content FROM (SELECT conv_id, turn // 2 AS half, min(turn) AS start_turn, max(turn) AS end_turn, min(text) AS content FROM conversations GROUP BY 1, 2))""",
    "concepts": "concepts AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, greatest(0.0, least(1.0, c_acctbal / 10000)) AS relevance, CASE WHEN c_nationkey = c_custkey % 7 THEN [c_nationkey] ELSE [c_nationkey, c_custkey % 7] END AS sources, c_mktsegment || ' ' || c_name AS content FROM customer)",
}
