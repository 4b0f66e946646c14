"""Byte-level BPE: ranked merges folded over the bytes of distinct words by a rank map, and decoding by pieces.

There are two forms with equal results. `transcode` (the query's) folds in Arrow batches: each Python worker folds a
frequent word once, remembers a bounded number of words from task to task, and decodes by concatenating the pieces of the ids. `encode` and `decode` are the
form in Spark's higher-order functions; its folds of rare words cost several times the time that the task's limits leave
(figures in the README), so that the query takes the other form.

The form in higher-order functions. A text is cut into words by the tokenizer's pattern. Distinct words are counted, and those of the HEAD most frequent counts
are encoded once by the fold and go back to the tasks as a literal map; words outside it, rarer, are folded where they stand.
Words of more than LONG bytes, for which a fold would take the square of their length, are encoded by `tiktoken` with the
same ranks, as is the rest of a text that holds one, in an Arrow function that only such texts reach.

The fold starts from the bytes of a word as an array of binaries and joins, at most length - 1 times, the leftmost adjacent
pair whose concatenation has the least rank. The rank map is a literal: an array of SHARDS maps, the shard of a binary being
its crc32 modulo SHARDS, since Spark searches a map entry by entry.

Decoding looks up the bytes of every id in a literal array and concatenates the pieces (in hexadecimal, so that the time
grows with the length and not its square).

Defined cases: null and empty texts have no ids and decode to no bytes; repeated rows are encoded alike; other columns are
ignored. A null doc_id is kept as such.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, table

HEAD, SHARDS, WORD_SHARDS, LONG, NONE = 1 << 17, 1 << 14, 1 << 15, 48, 1 << 30


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _literal(values, kind: str) -> Column:
    """A literal of a nested type; from_json of a constant is folded to one by the optimizer."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


def _shard(b: Column, n: int) -> Column:
    return (F.crc32(b) % n + 1).cast("int")


def rank_map(ranks: dict[bytes, int]) -> Column:
    """array<map<string, int>> by shard; keys are hexadecimal."""
    shards: list[dict[str, int]] = [{} for _ in range(SHARDS)]
    for token, rank in ranks.items():
        shards[zlib.crc32(token) % SHARDS][token.hex().upper()] = rank
    return _literal(shards, "array<map<string,int>>")


def rank_of(b: Column, ranks: Column) -> Column:
    return F.element_at(F.element_at(ranks, _shard(b, SHARDS)), F.hex(b))


def encode_word(word: Column, ranks: Column) -> Column:
    """ids (array<int>) of one word, by the fold of ranked merges."""
    data = word.cast("binary")
    parts = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substring(data, i, F.lit(1)))

    def step(state: Column, _: Column) -> Column:
        p = state["parts"]

        def merged(near: Column) -> Column:
            low = F.coalesce(F.array_min(near), F.lit(NONE))
            at = F.array_position(near, low).cast("int")
            joined = F.concat(F.slice(p, 1, at - 1), F.array(F.concat(F.element_at(p, at), F.element_at(p, at + 1))), F.slice(p, at + 2, F.size(p)))
            return F.when(low == NONE, F.struct(p.alias("parts"), F.lit(True).alias("done"))).otherwise(F.struct(joined.alias("parts"), (F.size(p) <= 2).alias("done")))

        near = F.transform(F.slice(p, 1, F.size(p) - 1), lambda x, i: F.coalesce(rank_of(F.concat(x, F.element_at(p, i + 2)), ranks), F.lit(NONE)))
        # The ranks are computed once: a one-element array binds them for `merged`.
        return F.when(state["done"], state).otherwise(F.element_at(F.transform(F.array(near), merged), 1))

    start = F.struct(parts.alias("parts"), (F.octet_length(word) < 2).alias("done"))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(word) - 1)), start, step, lambda s: s["parts"])
    whole = rank_of(data, ranks)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, lambda b: rank_of(b, ranks)))


def split_words(text: Column, pattern: str) -> Column:
    """The matches of the pattern in order; (?U) gives \\s its Unicode meaning."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def head_words(docs: DataFrame, text: str, pattern: str, ranks: Column) -> Column:
    """A literal array<map<string, array<int>>> of the most frequent words, at most HEAD, with their ids."""
    each = docs.select(F.explode(F.array_distinct(split_words(F.col(text), pattern))).alias("word"))
    counts = each.where(F.octet_length("word") <= LONG).groupBy("word").count()
    counts = save(counts.where("count > 1"), "words")
    # The least count of which all words fit into HEAD.
    sizes = counts.groupBy(F.least("count", F.lit(1_000_000)).alias("count")).agg(F.count("*").alias("n")).orderBy(F.col("count").desc()).collect()
    total, least = 0, None
    for r in sizes:
        total += r["n"]
        if total > HEAD:
            break
        least = r["count"]
    shards: list[dict[str, list[int]]] = [{} for _ in range(WORD_SHARDS)]
    if least is not None:
        for r in counts.where(F.col("count") >= least).select("word", encode_word(F.col("word"), ranks).alias("ids")).toLocalIterator():
            shards[zlib.crc32(r["word"].encode()) % WORD_SHARDS][r["word"]] = r["ids"]
    return _literal(shards, "array<map<string,array<int>>>")


def encode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and ids (array<int>) of every row."""
    ranks = rank_map(read_ranks(rank_path))
    head = head_words(docs, text, pattern, ranks)
    found = docs.select(*keep, split_words(F.col(text), pattern).alias("_words"))
    long_words = F.filter("_words", lambda w: F.octet_length(w) > LONG)
    ids = F.transform("_words", lambda w: F.coalesce(F.element_at(F.element_at(head, _shard(w.cast("binary"), WORD_SHARDS)), w), encode_word(w, ranks)))
    plain = found.where(F.size(long_words) == 0).select(*keep, F.flatten(ids).alias("ids"))

    def run(batches):
        import tiktoken

        quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(rank_path), special_tokens={})
        for batch in batches:
            out = [[i for w in row.as_py() for i in quick.encode_ordinary(w)] for row in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(out, pa.list_(pa.int32()))], [*keep, "ids"])

    rest = found.where(F.size(long_words) > 0)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields[:-1])
    return plain.union(rest.mapInArrow(run, f"{kinds}, ids array<int>"))


def decode(ids: Column, rank_path: str) -> Column:
    """The bytes (binary) of an array of ids."""
    ranks = read_ranks(rank_path)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex().upper()
    by_id = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(by_id, i + 1)), ""))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """ids of one word: the leftmost adjacent pair of least rank is joined until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) <= 24:
        # Ends of the parts; near[i] is the rank of parts i and i + 1 as one.
        get, ends = ranks.get, list(range(len(word) + 1))
        near = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while near and (low := min(near)) != NONE:
            at = near.index(low)
            del ends[at + 1], near[at]
            if at:
                near[at - 1] = get(word[ends[at - 1] : ends[at + 1]], NONE)
            if at < len(near):
                near[at] = get(word[ends[at] : ends[at + 2]], NONE)
        return [ranks[word[i:j]] for i, j in zip(ends, ends[1:], strict=False)]
    # Long words: a heap of pairs over a linked list, in n log n.
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heappush(heap, (r, k, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Words(dict):
    """(ids as decimal text, decoded bytes) by word; remembers a bounded number of words.

    When `most` are known they become the older ones, in place of those before; a word that is met again moves to the newer
    ones, so that frequent words are folded once however many rare ones pass. Longer words than `longest` are not remembered.
    """

    longest = 256

    def __init__(self, ranks: dict[bytes, int], most: int = 150_000):
        super().__init__()
        self.ranks, self.most, self.older = ranks, most, {}
        self.pieces = {r: t for t, r in ranks.items()}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            ids = merge(word.encode("utf-8", "surrogatepass"), self.ranks)
            value = " ".join(map(str, ids)), self.decode(ids)
        if len(word) > self.longest:
            return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@cache
def words_of(path: str) -> Words:
    """The words that a Python worker knows; its tasks share them."""
    return Words(read_ranks(path))


def transcode(docs: DataFrame, rank_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """The columns `keep`, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256 and, if wanted, ids and decoded (binary)."""
    base = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        import regex

        known, cut = words_of(rank_path), regex.compile(pattern)
        for batch in batches:
            n, digests, ids, decoded = [], ([], []), [], []
            for t in batch.column(len(keep)):
                found = list(map(known.__getitem__, cut.findall(t.as_py() or "")))
                listed = " ".join([w[0] for w in found])
                n.append(listed.count(" ") + 1 if found else 0)
                digests[0].append(sha256(listed.encode()).hexdigest())
                data = b"".join([w[1] for w in found])
                digests[1].append(sha256(data).hexdigest())
                if with_ids:
                    ids.append(list(map(int, listed.split())))
                    decoded.append(data)
            columns = [pa.array(n, pa.int64()), *(pa.array(d, pa.string()) for d in digests), *([pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return transcode(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=False)
