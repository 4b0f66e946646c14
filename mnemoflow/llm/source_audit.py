"""Source divergence audit: how the words of each source of a language differ from its other sources and from the language.

Terms are integers. Map tasks count terms by language and source and hand on sums; one exchange by ranges of (language, term)
then brings all counts of a term, and the terms next to it, into one task. There a language's kept terms of the range form a sorted
array, searchsorted turns terms into ids and bincount turns counts into one dense vector a source: ranges follow UTF-8 order,
so do arrays and ids, and ids break ties. Ranges are cut into chunks of about CELLS cells (terms times sources; an Arrow batch more at most), which
are written; once the sizes of languages (V) and groups (N) are known, each chunk yields its part of the sums over all kept terms, dense
vector against dense vector, and its ten best terms for each group.

For a count c of a group with N kept occurrences in a language of V kept terms, p = 1 + floor(10 ** 9 * (c + 2) / (N + 2 * V)), and
the divergence of p and q is floor((p - q) ** 2 / (p + q)). All of it is integers: 64 bits while 10 ** 9 * (c + 2) fits, else Python's.

Part `pair`: item is each other source of the language, value the sum over all kept terms, zero counts included; part `term`: item is
each kept term that the group has and that weighs more in it than in the language, value its divergence, the 10 highest. Ranks go by
value descending, then by item in UTF-8 order.

Defined cases: null text, lang and source count as ''; a language without kept terms has pairs of value 0 and no terms; a language of one
source has no pairs; repeated rows count as documents each; texts of any length are counted whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, table

LEAST_DOCS, BEST, SCALE = 10, 10, 10**9
#: Distinct (language, source, term) that a task counts before it hands them on; cells of a chunk's vectors.
HELD, CELLS = 400_000, 1 << 20
#: A-Z to a-z; what parts terms to a space. Bytes from 0x80 on belong to terms, as all characters that are not ASCII do.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def count_terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed up within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        d: dict[tuple[str, str], Counter] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (l, s), counts in n.items():
                names, own = list(counts), d[l, s]
                for a in range(0, len(names), 20_000):
                    part = names[a : a + 20_000]
                    same = lambda v: pa.array([v], pa.string()).take(pa.array(np.zeros(len(part), np.int32)))  # noqa: B023, E731
                    many = lambda c: pa.array(list(map(c.__getitem__, part)), pa.int64())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(l), same(s), pa.array(part, pa.binary()), many(counts), many(own)], ["lang", "source", "term", "n", "docs"])
            n.clear()
            d.clear()

        for batch in batches:
            for l, s, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = terms(value.as_py() or b"")
                counts, own = n.setdefault((l, s), Counter()), d.setdefault((l, s), Counter())
                held -= len(counts)
                # Lists and sets are counted without a step in Python for each term.
                counts.update(found)
                own.update(set(found))
                held += len(counts)
                if held > HELD:
                    yield from out()
                    held = 0
        yield from out()

    rows = docs.select(F.coalesce(lang, F.lit("")), F.coalesce(source, F.lit("")), F.col(text).cast("binary"))
    counted = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


CHUNK = "lang string, chunk string, terms array<binary>, source string, counts array<bigint>"


def chunks(counts: DataFrame, parts: int) -> DataFrame:
    """CHUNK rows of counts: for each chunk of a language's kept terms one with its sorted terms and their counts in the language (source
    null), and one for each source that has some, with its counts in the order of the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, rows, sources, distinct = None, [], set(), 0

        def close() -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            term, source, n, docs = (np.concatenate(c) for c in zip(*rows, strict=True))
            every = np.unique(term)
            ids = np.searchsorted(every, term)
            kept = every[np.bincount(ids, docs, len(every)) >= LEAST_DOCS]
            if not len(kept):
                return
            ids = np.minimum(np.searchsorted(kept, term), len(kept) - 1)
            live = kept[ids] == term
            ids, n, source = ids[live], n[live], source[live]
            name = f"{lang}\x00".encode() + kept[0]
            chunk = hashlib.sha256(name).hexdigest()
            names, group = np.unique(source, return_inverse=True)
            dense = np.bincount(group * len(kept) + ids, n, len(names) * len(kept)).astype(np.int64).reshape(len(names), len(kept))
            made = [(lang, chunk, kept.tolist(), None, dense.sum(0).tolist()), *((lang, chunk, None, s, c.tolist()) for s, c in zip(names.tolist(), dense, strict=True))]
            for row in made:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.list_(pa.binary()), pa.string(), pa.list_(pa.int64())), strict=True)], ["lang", "chunk", "terms", "source", "counts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            langs, term = np.array(batch.column("lang").to_pylist(), object), np.array(batch.column("term").to_pylist(), object)
            source, n, docs = np.array(batch.column("source").to_pylist(), object), batch.column("n").to_numpy(), batch.column("docs").to_numpy()
            begins = np.r_[True, langs[1:] != langs[:-1]]
            new = begins | np.r_[True, term[1:] != term[:-1]]
            cuts = [*np.flatnonzero(begins).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if langs[a] != lang:
                    yield from close()
                    lang, rows, sources, distinct = langs[a], [], set(), 0
                distinct += int(new[a:b].sum())
                sources |= set(source[a:b].tolist())
                # A full chunk ends before the last term that begins here: more counts of that one may follow.
                last = a + int(np.flatnonzero(new[a:b])[-1])
                if distinct * len(sources) > CELLS and last > a:
                    rows.append((term[a:last], source[a:last], n[a:last], docs[a:last]))
                    yield from close()
                    a, rows, sources, distinct = last, [], set(source[last:b].tolist()), 1
                rows.append((term[a:b], source[a:b], n[a:b], docs[a:b]))
        yield from close()

    # Equal keys share a range, so that a chunk has all counts of its terms.
    return counts.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, CHUNK)


def weights(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """p of each count."""
    if counts.max(initial=0) + 2 >= (1 << 62) // SCALE:
        return np.array([1 + SCALE * (int(c) + 2) // (n + 2 * v) for c in counts], np.int64)
    return 1 + SCALE * (counts + 2) // (n + 2 * v)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """p and q are at most 10 ** 9 + 1, their squares fit."""
    return (p - q) ** 2 // (p + q)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups of docs."""
    spark = docs.sparkSession
    counts = save(count_terms(docs, text, lang, source), "counts")
    groups = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    parts = max(1, -(-counts.count() // 100_000), spark.sparkContext.defaultParallelism)
    cut = save(chunks(counts, parts), "chunks")

    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    sums = cut.select("lang", "source", total.alias("n"), F.size("counts").alias("v"))
    of_lang = sums.where("source is null").groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("v"))
    of_group = sums.where("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sized = save(groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"), F.coalesce("v", F.lit(0)).alias("v")), "groups")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            dense = {s: c.values.to_numpy() for s, c in zip(left.column("source").to_pylist(), left.column("counts"), strict=True)}
            every = next(t for t in left.column("terms").to_pylist() if t is not None)
            own = right.to_pylist()
            lang, v, whole = (own[0][c] for c in ("lang", "v", "lang_n"))
            pair, best = np.zeros((len(own), len(own)), np.int64), [[] for _ in own]
            step = max(1, CELLS // len(own))
            for a in range(0, len(every), step):
                part = slice(a, a + step)
                q = weights(dense[None][part], whole, v)
                none = np.zeros(len(q), np.int64)
                p = [weights(dense[g["source"]][part] if g["source"] in dense else none, g["n"], v) for g in own]
                for i, g in enumerate(own):
                    pair[i, :i] += np.array([divergence(p[i], p[j]).sum() for j in range(i)], np.int64)
                    if g["source"] in dense:
                        at = np.flatnonzero((dense[g["source"]][part] > 0) & (p[i] > q))
                        value = divergence(p[i][at], q[at])
                        # Ids are in the order of terms.
                        best[i] += [(-int(value[k]), a + int(at[k])) for k in np.lexsort((at, -value))[:BEST]]
            for i, g in enumerate(own):
                out += [(lang, g["source"], own[j]["source"], None, int(pair[i, j])) for j in range(i)]
                out += [(lang, g["source"], None, every[k], -x) for x, k in sorted(best[i])[:BEST]]
        columns = zip(*out, strict=True) if out else [()] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "source", "other", "term", "value"])

    at_chunk = cut.where("source is null").select(F.col("lang").alias("of"), F.col("chunk").alias("at")).join(sized, F.col("of") == F.col("lang"))
    found = save(cut.groupBy("lang", "chunk").cogroup(at_chunk.groupBy("of", "at")).applyInArrow(run, "lang string, source string, other string, term binary, value long"), "divergence")

    ranked = lambda item: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), item))
    one = found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = one.union(one.select("lang", "other", "source", "value"))
    # Pairs of languages without kept terms have no chunk.
    empty = sized.where("v = 0").select("lang", "source")
    zero = empty.join(empty.select("lang", F.col("source").alias("other")), "lang").where("source <> other").select("lang", "source", "other", F.lit(0).cast("long").alias("value"))
    pairs = both.union(zero).withColumnRenamed("other", "item").withColumn("rank", ranked("item")).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    best = found.where("term is not null").withColumn("rank", ranked("term")).where(F.col("rank") <= BEST)
    return pairs.union(best.select("lang", "source", F.lit("term"), F.col("term").cast("string"), "value", "rank"))


def op13_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT r, lang, source, unnest(ts) AS t FROM d),
k AS (SELECT lang, t FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
o AS (SELECT lang, source, t, count(*) AS c FROM w JOIN k USING (lang, t) GROUP BY 1, 2, 3),
n AS (SELECT lang, source, sum(c) AS n FROM o GROUP BY 1, 2),
l AS (SELECT lang, t, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS n FROM o GROUP BY 1, 2),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (SELECT g.lang, g.source, k.t, coalesce(o.c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * CAST(coalesce(o.c, 0) + 2 AS HUGEINT) // CAST(coalesce(n.n, 0) + 2 * v.v AS HUGEINT) AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.t = k.t LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
pr AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.t = y.t AND x.source <> y.source GROUP BY 1, 2, 3),
pa AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(pr.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
q AS (SELECT l.lang, l.t, 1 + CAST(1000000000 AS HUGEINT) * CAST(l.c + 2 AS HUGEINT) // CAST(l.n + 2 * v.v AS HUGEINT) AS q FROM l JOIN v USING (lang)),
te AS (SELECT p.lang, p.source, p.t AS item, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) AS value FROM p JOIN q ON p.lang = q.lang AND p.t = q.t WHERE p.c > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM te)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pa
UNION ALL SELECT lang, source, 'term', item, value, rank FROM r WHERE rank <= 10
"""
