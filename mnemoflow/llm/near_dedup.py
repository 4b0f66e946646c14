"""Near-duplicate documents: one-permutation MinHash, banded buckets and star-shaped candidate edges, confirmed on full sets.

Texts with the same shingle set form a class at once (128-bit hash of the sorted set); one document stands for it from
there on, so that thousands of copies cost as much as one. Each class gets SKETCHES one-permutation sketches of BANDS bins
with optimal densification (an empty bin takes the value of a full bin drawn by its own fixed permutation); band j joins
bin j of every sketch. At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 6) ** 48 = 5e-7.

In a bucket all members are paired with one centre only, the smallest (a star), and the confirmed links are merged into
components. What stars cannot settle is settled exactly: in a bucket that holds several components, each member outside the
largest of them is compared with all of that one and with the bucket's other members, in blocks of about BLOCK documents,
through an inverted index of the block's shingles; no pairs are emitted but the links found. Every link is confirmed on whole shingle sets.

Defined cases: null or empty text, or one without words: no shingles, linked with nothing; fewer words than the shingle
length: the whole sequence is the one shingle; rows that share a doc_id are one node; a null doc_id is linked with
nothing, has a null component and is kept. Columns other than doc_id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix, save, table, window_hashes, with_least, WordHashes, words

SKETCHES, BANDS, BLOCK = 6, 48, 4_000
_rng = np.random.default_rng(20_10)
_SEEDS = _rng.integers(1, 1 << 63, SKETCHES, dtype=np.uint64)[:, None]
_FILL = np.array([_rng.permutation(BANDS) for _ in range(BANDS)])
_ROW = np.arange(SKETCHES)[:, None] * BANDS
_BAND = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased."""
    found = words(text.translate(_LOWER) if text else text)
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < size:
        return mix(window_hashes(hashes.of(found), len(found)) + np.uint64(len(found)))
    return np.unique(mix(window_hashes(hashes.of(found), size)))


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band from SKETCHES densified one-permutation sketches."""
    x = mix(shingles[None, :] ^ _SEEDS)
    bins = ((x >> np.uint64(40)) * np.uint64(BANDS)) >> np.uint64(24)
    low = np.full(SKETCHES * BANDS, _EMPTY)
    np.minimum.at(low, (bins.astype(np.int64) + _ROW).ravel(), x.ravel())
    low = low.reshape(SKETCHES, BANDS)
    full = low != _EMPTY
    if not full.all():
        first = full[:, _FILL].argmax(2)
        low = np.where(full, low, np.take_along_axis(low, _FILL[np.arange(BANDS)[None, :], first], 1))
    return mix((mix(low) * (_SEEDS | np.uint64(1))).sum(0, dtype=np.uint64) ^ _BAND)


def sketches(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(doc_id, n_shingles, class_key, bands) of each row; class_key and bands are null without shingles."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n, key, bands = [], [], []
            for value in texts:
                s = shingle_set(value.as_py(), size, hashes)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "class_key", "bands"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, class_key binary, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A & B| >= percent * |A | B| on their full shingle sets."""

    def run(batches):
        hashes, known = WordHashes(), {}

        def of(i, text):
            if i not in known:
                if len(known) > 256:
                    known.clear()
                known[i] = shingle_set(text, size, hashes)
            return known[i]

        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep = []
            for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                p, q = of(x, ta[i].as_py()), of(y, tb[i].as_py())
                both = np.intersect1d(p, q, assume_unique=True).size
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    full = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def block_links(need: DataFrame, held: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the documents of need(rep, own, grp) and those of the groups, held(node, component, grp, members).

    `own` and `component` are the components of rep and node; links within a component are not looked for. Groups are dealt
    into blocks of about BLOCK members, large ones into several; a document goes once to each block that needs it.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, a, b = WordHashes(), [], []
        by: dict[int, list] = {}
        for node, component, groups, text in zip(*(left.column(c).to_pylist() for c in ("node", "component", "groups", "text")), strict=True):
            item = (node, component, shingle_set(text, size, hashes))
            for g in groups:
                by.setdefault(g, []).append(item)
        index = {}
        for rep, own_component, groups, text in zip(*(right.column(c).to_pylist() for c in ("rep", "own", "groups", "own_text")), strict=True):
            own = shingle_set(text, size, hashes)
            for g in groups:
                if g not in by:
                    continue
                if g not in index:
                    every = np.concatenate([x for _, _, x in by[g]])
                    place = np.repeat(np.arange(len(by[g])), [len(x) for _, _, x in by[g]])
                    order = np.argsort(every, kind="stable")
                    index[g] = every[order], place[order], np.array([len(x) for _, _, x in by[g]]), np.array([c for _, c, _ in by[g]])
                every, place, sizes, kinds = index[g]
                lo, n = np.searchsorted(every, own), np.searchsorted(every, own, "right")
                n -= lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(place[at], minlength=len(sizes))
                hit = np.flatnonzero((100 * both >= percent * (sizes + len(own) - both)) & (kinds != own_component))
                for h in hit[np.unique(kinds[hit], return_index=True)[1]]:
                    a.append(rep)
                    b.append(by[g][h][0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # A group of m members has chunks 0 .. (m - 1) // BLOCK; chunk c of group g goes to block hash(g, c).
    blocks = max(1, -(-held.count() // BLOCK))
    block = lambda group, chunk: F.pmod(F.xxhash64(group, chunk), F.lit(blocks)).alias("block")
    parts = F.floor((F.col("members") - 1) / BLOCK + 1)
    left = held.select("node", "component", "grp", block(F.col("grp"), F.pmod(F.xxhash64("node"), parts))).groupBy("block", "node", "component").agg(F.collect_set("grp").alias("groups"))
    left = left.join(texts, F.col("node") == F.col("rep")).drop("rep")
    wide = need.join(held.select("grp", parts.alias("parts")).distinct(), "grp")
    chunks = wide.select("rep", "own", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("chunk"))
    right = chunks.select("rep", "own", "grp", block(F.col("grp"), F.col("chunk"))).groupBy("rep", "own", "block").agg(F.collect_set("grp").alias("groups")).join(texts.withColumnRenamed("text", "own_text"), "rep")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    drawn = save(sketches(docs, text, size), "sketches")
    some = drawn.where("class_key is not null and doc_id is not null")
    member = save(with_least(some.select("doc_id", "class_key", "n_shingles"), "class_key", "doc_id", "rep").select("doc_id", "rep", "n_shingles"), "members")

    reps = member.where("doc_id = rep").groupBy("rep").agg(F.max("n_shingles").alias("n"), F.min("n_shingles").alias("n_min"))
    bands = save(some.join(reps, some["doc_id"] == reps["rep"]).select("rep", "n", "n_min", F.explode("bands").alias("key")).distinct(), "bands")

    # Buckets of at least two classes, with their centre; the texts of their members, written once for all comparisons.
    busy = bands.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre <> last")
    rows = save(bands.join(busy, "key").select("key", "rep", "n", "n_min", "centre"), "buckets")
    inside = rows.select(F.col("rep").alias("id")).distinct()
    texts = save(docs.select(F.col("doc_id").alias("rep"), F.col(text).alias("text")).join(inside.hint("merge"), F.col("rep") == F.col("id"), "left_semi"), "texts")
    sizes = reps.select(F.col("rep").alias("centre"), F.col("n").alias("n_b"), F.col("n_min").alias("m_b"))
    near = f"100 * least(n, n_b) >= {percent} * greatest(n_min, m_b)"
    star = rows.where("rep <> centre").select("rep", "centre", "n", "n_min").distinct().join(sizes, "centre").where(near)
    pairs = save(star.select(F.col("centre").alias("a"), F.col("rep").alias("b")), "pairs")

    # Rows that share a doc_id are one node, so their classes are linked.
    many = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).where("a <> top")
    same_id = member.join(many, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    links = save(confirm(pairs, texts, size, percent).union(same_id), "links")
    joined = components(links)

    # Buckets whose members are not all in one component: their largest component is a group, and what else they hold is one.
    own = save(rows.select("key", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "rows")
    groups = own.select("rep", "component").distinct()
    members = save(groups.join(groups.groupBy("component").agg(F.count("*").alias("members")), "component").select(F.col("rep").alias("node"), "component", "members"), "groups")
    kinds = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    sized = own.join(kinds, "key").join(members.withColumnRenamed("node", "rep"), ["rep", "component"])
    first = sized.groupBy("key").agg(F.max(F.col("members")).alias("most")).withColumnRenamed("key", "k")
    main = sized.join(first, F.col("key") == F.col("k")).where("members = most").groupBy("key").agg(F.min("component").alias("main"))
    lesser = save(sized.join(main, "key").where("component <> main").select("key", "rep", "component", "main"), "lesser")
    if not lesser.isEmpty():
        of_main, of_key = F.xxhash64(F.lit("component"), "main"), F.xxhash64(F.lit("key"), "key")
        need = lesser.select("rep", F.col("component").alias("own"), F.explode(F.array(of_main, of_key)).alias("grp")).distinct()
        whole = members.join(lesser.select("main").distinct(), F.col("component") == F.col("main")).select("node", "component", of_main.alias("grp"), "members")
        beside = lesser.join(lesser.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key").select(F.col("rep").alias("node"), "component", of_key.alias("grp"), "members")
        held = save(whole.union(beside), "held")
        links = save(links.union(block_links(need, held, texts, size, percent)), "links")
        joined = components(links)

    of_rep = member.join(joined, member["rep"] == joined["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    of_id = of_rep.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = drawn.select("doc_id", "n_shingles").join(of_id, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
       ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 80 * (u.n + v.n - k)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, c.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS c FROM r GROUP BY 1) c ON c.node = d.doc_id
"""
