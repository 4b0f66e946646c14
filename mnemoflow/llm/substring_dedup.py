"""Exact substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt into groups of about GROUP_BYTES of text by a hash. Each group hashes all of its windows (64 bits),
and sends every distinct hash once to the bucket that its top bits name, with 16 bits of a second hash of another base; a bucket
counts over all groups and answers each group with one bit per hash: seen in another group or not. The group, grouped again
with its answers, marks the windows that are repeated within it or elsewhere and merges them into maximal intervals. Hashes are
packed in order, as differences of six bytes, so that a window costs eight bytes of shuffle, and a passage that a third of all
rows share sends one hash per group.

Two different windows of different groups are taken for equal with a chance of about 2 ** -80 a pair, and within a group of
about a million windows, where one hash decides, of 2 ** -64.

Defined cases: null or empty texts and those of fewer words than the window have nothing removed; repeated rows are
documents of their own, so their windows repeat; a null doc_id is kept as such; columns other than doc_id and the text are
ignored; a text of which all is removed becomes the empty text (kept_sha256 of zero bytes).
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, next_power, table, text_bytes, window_hashes, WordHashes, words

GROUP_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20


def _windows(table: pa.Table, size: int, twice: bool = False):
    """Of a group, in a fixed order of rows: row order, words of each row, hashes of each row's windows and of all windows in row order,
    and, if wanted, second hashes of the latter."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
    hashes = WordHashes()
    found = [words(texts[i]) for i in order]
    own = [hashes.of(w) for w in found]
    each = [mix(window_hashes(h, size)) for h in own]
    others = [mix(window_hashes(h, size, 0xD1342543DE82EF95)) for h in own] if twice else []
    return order, found, each, np.concatenate([*each, np.empty(0, np.uint64)]), np.concatenate([*others, np.empty(0, np.uint64)])


def _pack(own: np.ndarray, second: np.ndarray) -> bytes:
    """Ascending hashes with their second ones: the first, then differences of six bytes where all fit, else of eight; then the second."""
    steps = np.diff(own)
    wide = 8 if len(steps) and steps.max() >> np.uint64(48) else 6
    return bytes([wide]) + own[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :wide].tobytes() + second.tobytes()


def _unpack(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = int(data[0])
    n = (len(data) - 9 - 2) // (wide + 2)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :wide] = data[9 : 9 + n * wide].reshape(n, wide)
    own = np.cumsum(np.r_[data[1:9].copy().view(np.uint64), steps.view(np.uint64).ravel()], dtype=np.uint64)
    return own, data[9 + n * wide :].copy().view(np.uint16)


def intervals(marks: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal word intervals [start, end) covered by the windows that start at the marked positions."""
    at = np.flatnonzero(marks)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > size)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + size).tolist(), strict=True))


def dedup_substrings(docs: DataFrame, text: str = "text", size: int = 35, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns `keep`, n_words, removed (intervals of words, end exclusive), n_removed, kept (text)."""
    total = text_bytes(docs, text)
    groups, buckets = max(1, -(-total // GROUP_BYTES)), min(1 << 20, next_power(total / BUCKET_BYTES))
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    carried = [F.col(c).alias(f"keep_{c}") for c in keep]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), *carried).withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    fields = [(f.name, f.dataType.simpleString()) for f in dealt.schema.fields if f.name.startswith("keep_")]

    def send(table: pa.Table) -> pa.Table:
        _, _, _, every, others = _windows(table, size, True)
        own, first = np.unique(every, return_index=True)
        second = (others[first] >> np.uint64(48)).astype(np.uint16)
        cuts = np.searchsorted(own >> shift, np.arange(buckets + 1, dtype=np.uint64)) if buckets > 1 else np.array([0, len(own)])
        full = np.flatnonzero(np.diff(cuts))
        part = table.column("part")[0].as_py()
        packed = [_pack(own[cuts[b] : cuts[b + 1]], second[cuts[b] : cuts[b + 1]]) for b in full]
        return pa.table({"bucket": pa.array(full, pa.int64()), "part": pa.array([part] * len(full), pa.int64()), "hashes": pa.array(packed, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        both = [_unpack(np.frombuffer(x.as_buffer(), np.uint8)) for x in table.column("hashes")]
        each, second = [x for x, _ in both], np.concatenate([y for _, y in both])
        every = np.concatenate(each)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        same = ordered[1:] == ordered[:-1]
        # Of the hashes that occur again, those whose second hash does too.
        at = order[np.r_[same, False] | np.r_[False, same]]
        _, kind, n = np.unique(np.stack([every[at], second[at].astype(np.uint64)], 1), axis=0, return_inverse=True, return_counts=True)
        again = np.zeros(len(every), bool)
        again[at] = n[kind.ravel()] > 1
        bits = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum([len(x) for x in each])[:-1])]
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary()), "n": pa.array([len(x) for x in each], pa.int64())})

    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        order, found, each, every, _ = _windows(table, size)
        own, n = np.unique(every, return_counts=True)
        answers = answers.sort_by("bucket")
        seen = [np.unpackbits(np.frombuffer(b.as_buffer(), np.uint8), count=k.as_py()) for b, k in zip(answers.column("bits"), answers.column("n"), strict=True)]
        repeated = own[(n > 1) | (np.concatenate(seen).astype(bool) if seen else np.zeros(len(own), bool))]
        marks = np.isin(every, repeated)
        out, at = {"n_words": [], "removed": [], "n_removed": [], "kept": []}, 0
        for w, h in zip(found, each, strict=True):
            spans = intervals(marks[at : at + len(h)], size)
            at += len(h)
            kept, end = [], 0
            for a, b in spans:
                kept += w[end:a]
                end = b
            out["n_words"].append(len(w))
            out["removed"].append([{"start": a, "end": b} for a, b in spans])
            out["n_removed"].append(sum(b - a for a, b in spans))
            out["kept"].append(b" ".join(kept + w[end:]).decode("utf-8", "surrogatepass"))
        result = pa.table(out, pa.schema([("n_words", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("n_removed", pa.int64()), ("kept", pa.string())]))
        table = table.take(order)
        for i, (name, _) in enumerate(fields):
            result = result.add_column(i, name, table.column(name))
        return result

    sent = dealt.groupBy("part").applyInArrow(send, "bucket long, part long, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "part long, bucket long, bits binary, n long")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in fields) + ", n_words long, removed array<struct<start:long,end:long>>, n_removed long, kept string"
    out = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(mark, schema)
    return out.withColumnsRenamed({f"keep_{c}": c for c in keep})


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
k AS (SELECT w.doc_id, x.j, ws[x.j] AS word FROM w, unnest(range(1, len(ws) + 1)) AS x(j) ANTI JOIN c ON c.doc_id = w.doc_id AND c.j = x.j),
a AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM k GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY 1) USING (doc_id)
"""
