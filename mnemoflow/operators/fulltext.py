"""Full-text ranking (BM25) over several columns of nodes: from the texts themselves, or from postings that are written once.

Both forms give the same (id, rank): rank is negative, better is less. `Scan` reads the texts for each query. `Postings` reads, of a table
sorted by term, the rows of the query's terms: one row a term and block of ids, with the counts of its documents, the greatest count
and the least length in each column. These bound what a block's documents can score, so that `best` reads the documents of the
blocks that can hold one of the k best alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fts_tokens, round_to
from ..sources.shared import written

K1, B, COLUMN_WEIGHTS = 1.2, 0.75, {"frontmatter": 2.0, "keywords": 10.0, "summary": 1.0}
COLUMNS, BLOCK = tuple(COLUMN_WEIGHTS), 64
#: Blocks of a term that stay together, and tokens of a part.
RANGE, PART = 1_024, 1 << 21


def distinct_terms(terms: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(t.lower() for t in terms))


def idf(n: int, found: int) -> float:
    """Terms that more than half of the rows hold count next to nothing."""
    x = math.log((n - found + 0.5) / (found + 0.5)) if n else 0.0
    return x if x > 0 else 1e-6


def gain(weight: float, tf: Column, length: Column, mean: float) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


@dataclass(frozen=True)
class Query:
    """Terms, whether every one must occur, the weights of the columns, and the column that the first term is looked for in (None: all)."""

    terms: list[str]
    every: bool = False
    weights: tuple[tuple[str, float], ...] = tuple(COLUMN_WEIGHTS.items())
    first_in: str | None = None

    def columns(self, i: int) -> list[tuple[str, float]]:
        return [(c, w) for c, w in self.weights if i or self.first_in in (None, c)]

    def hit(self) -> Column:
        out = F.lit(self.every)
        for i in range(len(self.terms)):
            out = out & (F.col(f"tf{i}") > 0) if self.every else out | (F.col(f"tf{i}") > 0)
        return out

    def rank(self, n: int, mean: float, found: list[int]) -> Column:
        total = F.lit(0.0)
        for i in range(len(self.terms)):
            total = total - F.when(F.col(f"tf{i}") > 0, gain(idf(n, found[i]), F.col(f"tf{i}"), F.col("length"), mean)).otherwise(0.0)
        return round_to(total, 6)


def _query(terms: Sequence[str], every: bool, weights: dict[str, float] | None, first_in: str | None) -> Query:
    return Query(distinct_terms(terms), every, tuple((weights or COLUMN_WEIGHTS).items()), first_in)


def term_counts(tokens: DataFrame, *keep: str) -> DataFrame:
    """(keep, term, tf_<column>) of rows with a list of tokens in each column: the tokens of a row are sorted, so that those of a term stand
    side by side, and counted there; nothing moves. Tokens hold no space, which sets off the number of their column."""
    tagged = lambda k: F.transform(COLUMNS[k], lambda t: F.concat(t, F.lit(f" {k}")))
    term = lambda x: F.substring_index(x, " ", 1)
    of = lambda k: F.size(F.filter("own", lambda x: x.endswith(f" {k}")))
    rows = tokens.select(*keep, F.sort_array(F.concat(*map(tagged, range(len(COLUMNS))))).alias("all"))
    first = F.transform("all", lambda x, i: F.when((i == 0) | (term(x) != term(F.get("all", i - 1))), i))
    rows = rows.select(*keep, "all", F.filter(first, lambda i: i.isNotNull()).alias("at"))
    each = F.transform("at", lambda a, j: F.slice("all", a + 1, F.coalesce(F.get("at", j + 1), F.size("all")) - a))
    rows = rows.select(*keep, F.explode(each).alias("own"))
    return rows.select(*keep, term(F.col("own")[0]).alias("term"), *(of(k).alias(f"tf_{c}") for k, c in enumerate(COLUMNS)))


def best(hits: DataFrame, k: int, by: str = "rank", descending: bool = False) -> DataFrame:
    return hits.orderBy(F.col(by).desc() if descending else F.col(by), "id").limit(k)


class Scan:
    """BM25 by reading the texts; each row's counts are worked out once and written, statistics and ranks come from there."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    def hits(self, terms: Sequence[str], every: bool = False, weights: dict[str, float] | None = None, keep: Column | None = None, first_in: str | None = None) -> DataFrame:
        """(id, rank) of the rows that hold a term (or every term). `keep` filters rows after the statistics, which stay those of all rows."""
        q = _query(terms, every, weights, first_in)
        own = self.nodes.select("id", (keep if keep is not None else F.lit(True)).alias("keep"), *(fts_tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"_{c}") for c, _ in q.weights))
        count = lambda c, t: F.size(F.filter(f"_{c}", lambda x: x == t))
        tf = [sum((w * count(c, t) for c, w in q.columns(i)), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(q.terms)]
        rows = written(own.select("id", "keep", sum((F.size(f"_{c}") for c, _ in q.weights), F.lit(0)).alias("length"), *tf), "counts")
        n, mean, *found = rows.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(0.0)), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)) for i in range(len(q.terms)))).first()
        return rows.where(q.hit() & F.col("keep")).select("id", q.rank(n, mean or 1.0, found).alias("rank"))

    def best(self, terms: Sequence[str], k: int, **how) -> DataFrame:
        return best(self.hits(terms, **how), k)


class Postings:
    """BM25 from postings(term, block, most_<column>, least_<column>, docs array<struct<id, tf_<column>, len_<column>>>), sorted by term."""

    def __init__(self, postings: DataFrame, n: int, lengths: dict[str, int], nodes: DataFrame):
        self.postings, self.n, self.lengths, self.nodes = postings, n, lengths, nodes

    @staticmethod
    def build(nodes: DataFrame, parts: int | None = None) -> Postings:
        """Tokens are counted by row and term within the row, and move once, by term and range of ids: a term of every row is dealt out too. A
        part holds some two million tokens at most on average, however large the table. Ids are whole numbers, each of one row."""
        cores = nodes.sparkSession.sparkContext.defaultParallelism
        # A table of few files would keep most cores idle.
        source = nodes if nodes.rdd.getNumPartitions() >= cores else nodes.select("id", *COLUMNS).repartition(cores)
        lens = [f"len_{c}" for c in COLUMNS]
        tokens = source.select("id", *(fts_tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in COLUMNS))
        sized = tokens.select("*", *(F.size(c).alias(f"len_{c}") for c in COLUMNS))
        n, *total = sized.agg(F.count("*"), *(F.sum(c) for c in lens)).first()
        block = F.floor(F.col("id") / BLOCK)
        counted = term_counts(sized, "id", *lens).select("*", block.alias("block"), F.floor(block / RANGE).alias("range"))
        parts = parts or max(1, cores // 2, -(-sum(x or 0 for x in total) // PART))
        own = F.sort_array(F.collect_list(F.struct("id", *(f"tf_{c}" for c in COLUMNS), *lens))).alias("docs")
        most, least = (F.max(f"tf_{c}").alias(f"most_{c}") for c in COLUMNS), (F.min(f"len_{c}").alias(f"least_{c}") for c in COLUMNS)
        rows = counted.repartition(parts, "term", "range").groupBy("term", "range", "block").agg(*most, *least, own).drop("range")
        return Postings(written(rows.sortWithinPartitions("term", "block"), "postings"), n, {c: x or 0 for c, x in zip(COLUMNS, total, strict=True)}, nodes)

    def _of(self, q: Query) -> DataFrame:
        return self.postings.where(F.col("term").isin(q.terms))

    def _tf(self, q: Query, i: int, of) -> Column:
        return sum((w * of(c) for c, w in q.columns(i)), F.lit(0.0))

    def _statistics(self, q: Query) -> tuple[float, list[int], int]:
        """Mean length in the query's columns, for each term how many rows hold it there, and how many blocks there are to read; one row a term
        reaches the driver."""
        held = lambda i: F.size(F.filter("docs", lambda d: self._tf(q, i, lambda c: d[f"tf_{c}"]) > 0))
        holds = {t: held(i) for i, t in enumerate(q.terms)}
        size = F.coalesce(*(F.when(F.col("term") == t, x) for t, x in holds.items())) if holds else F.lit(0)
        found = {r[0]: (r[1], r[2]) for r in self._of(q).groupBy("term").agg(F.sum(size), F.count("*")).collect()} if q.terms else {}
        return sum(self.lengths[c] for c, _ in q.weights) / max(1, self.n) or 1.0, [found.get(t, (0, 0))[0] for t in q.terms], sum(n for _, n in found.values())

    def _hits(self, q: Query, rows: DataFrame, mean: float, found: list[int], keep: Column | None) -> DataFrame:
        own = rows.select("term", F.inline("docs"))
        length = sum((F.col(f"len_{c}") for c, _ in q.weights), F.lit(0))
        each = own.groupBy("id").agg(F.first(length).alias("length"), *(F.coalesce(F.max(F.when(F.col("term") == t, self._tf(q, i, lambda c: F.col(f"tf_{c}")))), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(q.terms)))
        hits = each.where(q.hit()).select("id", q.rank(self.n, mean, found).alias("rank"))
        return hits if keep is None else hits.join(self.nodes.where(keep).select("id"), "id", "left_semi")

    def hits(self, terms: Sequence[str], every: bool = False, weights: dict[str, float] | None = None, keep: Column | None = None, first_in: str | None = None) -> DataFrame:
        q = _query(terms, every, weights, first_in)
        return self._hits(q, self._of(q), *self._statistics(q)[:2], keep)

    def bounds(self, q: Query, mean: float, found: list[int]) -> DataFrame:
        """(block, bound): no document of the block has a better rank than -bound."""
        length = sum((F.col(f"least_{c}") for c, _ in q.weights), F.lit(0))
        own = F.lit(0.0)
        for i, t in enumerate(q.terms):
            own = F.when((F.col("term") == t) & (self._tf(q, i, lambda c: F.col(f"most_{c}")) > 0), gain(idf(self.n, found[i]), self._tf(q, i, lambda c: F.col(f"most_{c}")), length, mean)).otherwise(own)
        return self._of(q).groupBy("block").agg(F.sum(own).alias("bound"))

    def best(self, terms: Sequence[str], k: int, every: bool = False, weights: dict[str, float] | None = None, keep: Column | None = None, first_in: str | None = None) -> DataFrame:
        """The k best hits: the k blocks of the highest bounds are read first; their k-th rank leaves out the blocks that cannot reach it."""
        q = _query(terms, every, weights, first_in)
        mean, found, blocks = self._statistics(q)
        if blocks <= 2 * k:
            # The first step would read most of them.
            return best(self._hits(q, self._of(q), mean, found, keep), k)
        bounds = self.bounds(q, mean, found)
        first = bounds.orderBy(F.col("bound").desc(), "block").limit(k)
        seen = best(self._hits(q, self._of(q).join(first, "block", "left_semi"), mean, found, keep), k)
        n, worst = seen.agg(F.count("*"), F.max("rank")).first()
        if n < k:
            return best(self._hits(q, self._of(q), mean, found, keep), k)
        # Ranks are rounded to six places.
        can = bounds.where(F.col("bound") >= -worst - 2e-6)
        return best(self._hits(q, self._of(q).join(can, "block", "left_semi"), mean, found, keep), k)
