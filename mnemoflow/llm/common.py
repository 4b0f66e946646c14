"""Helpers that the training-data operators share: the shared folder, written tables, hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, in one process alone, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _own_dir()).rstrip("/")


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='mnemoflow-')}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/mnemoflow/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """The maximal runs of bytes other than \\x20 and \\x09-\\x0D (bytes.split cuts at exactly these)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every output bit depends on every input bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash by word; remembers a bounded number of words."""

    def __init__(self, seed: int = 0, most: int = 300_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def window_hashes(hashes: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Rabin-Karp hashes sum(h[i + k] * base ** (size - 1 - k)) modulo 2 ** 64 of every window of `size` words.

    Windows of a power of two are built by doubling, H2m[i] = Hm[i] * base ** m + Hm[i + m], and joined to `size`.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, level, length = None, 0, hashes, 1
    left = size
    while left:
        if left & 1:
            part = level[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, length, 1 << 64)) + part
            done += length
        left >>= 1
        if left:
            level = level[:-length] * np.uint64(pow(base, length, 1 << 64)) + level[length:]
            length *= 2
    return out


def next_power(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def with_least(rows: DataFrame, key: str, value: str, name: str, pick=F.min) -> DataFrame:
    """rows with the least (or what pick takes) `value` of their key as column `name`; rows whose key is null are left out.

    Keys that hold a thousandth of all rows or more, of which there are a thousand at most, are broadcast, so that no hot key's
    rows meet in one task; keys of one row are their own; only the others are joined by a shuffle.
    """
    rows = rows.where(F.col(key).isNotNull())
    least = save(rows.groupBy(key).agg(pick(value).alias(name), F.count("*").alias("_n")).where("_n > 1"), "least")
    total = rows.count()
    hot = F.broadcast(least.where(F.col("_n") * 1_000 >= F.lit(total)).limit(1_001).drop("_n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(least.where(F.col("_n") * 1_000 < F.lit(total)).drop("_n"), key, "left")
    return rows.join(hot, key).unionByName(rest.withColumn(name, F.coalesce(name, value)))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each node of edges(a, b) reaches.

    Alternating large-star and small-star rounds; each round groups and joins by node and is written to the shared
    folder, so that no task and no driver holds a component. Ends when a round changes nothing.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    pairs = save(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    tally = lambda df: tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
    before = tally(pairs)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        pairs = save(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        now = tally(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots) if before[0] else spark.createDataFrame([], "node long, component long").select(F.col("node").cast(kind), F.col("component").cast(kind))
