"""Exact duplicates through a cuckoo-filter index of live digests, each shard with the contents it answers for.

An index shard holds a cuckoo filter (buckets of four 16-bit fingerprints, partial-key hashing) and the contents of its live
digests, laid into the buckets of the filter. A digest that the filter does not know is new at once; a hit is verified against
the contents of its bucket, byte by byte, so that neither a shared fingerprint nor a shared digest makes two texts equal. A
digest that goes is deleted from the filter; one that finds no place makes the filter double, built again from the stored keys.

`duplicates` uses it twice. In each input task an index of bounded size folds the equal texts that the task meets into one
record (content and ids; the longest held ones are evicted, their digests deleted), so that a text with any number of copies
leaves a task about once. The records then go to shards by digest, where they stream through the index one by one: a shard's
memory is that of its distinct texts, about SHARD_BYTES, however many records a text has. Classes and their records meet in
a join on the digest. `build`, `change` and `known` keep an index as a table, for corpora that come and go in batches.

Defined cases: a null text counts as empty, and empty texts are equal; only A-Z are lower-cased; of equal texts the row with the
largest doc_id stays, null being less than any id; rows that share text and the largest id are one document, kept alike;
rows without an id form classes like others (keep_id null and kept where no row of the class has one); an empty table gives no
rows; a text of any length is one value of one task; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, table, text_bytes

SLOTS, KICKS = 4, 200
#: Bytes of content that an index holds in one task, and ids that one record carries.
SHARD_BYTES, IDS, OUT_BYTES = 32 << 20, 20_000, 4 << 20


class CuckooFilter:
    """Fingerprints of 64-bit keys; `has` may be wrong for keys that are not in, never for those that are."""

    def __init__(self, buckets: int):
        self.mask, self.size = buckets - 1, 0
        self.table = array("H", bytes(2 * SLOTS * buckets))

    @staticmethod
    def fingerprint(key: int) -> int:
        return key >> 48 or 1

    def places(self, key: int) -> tuple[int, int]:
        first = key & self.mask
        return first, self.other(first, self.fingerprint(key))

    def other(self, bucket: int, fp: int) -> int:
        return bucket ^ (fp * 0x9E3779B1 & self.mask)

    def _put(self, bucket: int, old: int, new: int) -> bool:
        """Replaces one `old` of a bucket (0: a free slot) by `new`."""
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.table[at] == old:
                self.table[at] = new
                return True
        return False

    def has(self, key: int) -> bool:
        fp = self.fingerprint(key)
        return any(fp in self.table[b * SLOTS : b * SLOTS + SLOTS] for b in self.places(key))

    def insert(self, key: int) -> bool:
        """False if no place was found; the filter is then to be built again, as another key has lost its own."""
        fp = self.fingerprint(key)
        first, second = self.places(key)
        self.size += 1
        if self._put(first, 0, fp) or self._put(second, 0, fp):
            return True
        bucket = second
        for kick in range(KICKS):
            at = bucket * SLOTS + (kick * 7 + fp) % SLOTS
            fp, self.table[at] = self.table[at], fp
            bucket = self.other(bucket, fp)
            if self._put(bucket, 0, fp):
                return True
        return False

    def delete(self, key: int) -> None:
        fp = self.fingerprint(key)
        self.size -= any(self._put(b, fp, 0) for b in self.places(key))


class Entry:
    """A live digest: its content, and what its user keeps of its documents."""

    __slots__ = ("digest", "content", "ids", "keep", "n", "order")

    def __init__(self, digest: bytes, content: bytes, order: int = 0):
        self.digest, self.content, self.ids, self.keep, self.n, self.order = digest, content, [], None, 0, order


class Index:
    """A cuckoo filter over live digests and, by filter bucket, the entries behind them."""

    def __init__(self, buckets: int = 64):
        self.filter, self.held, self.bytes = CuckooFilter(buckets), {}, 0

    @staticmethod
    def key(digest: bytes) -> int:
        return int.from_bytes(digest[:8].ljust(8, b"\0"), "big")

    def entries(self) -> Iterator[Entry]:
        return (e for bucket in self.held.values() for e in bucket)

    def _bucket(self, key: int) -> int:
        return min(self.filter.places(key))

    def of_digest(self, digest: bytes) -> list[Entry]:
        key = self.key(digest)
        return [e for e in self.held.get(self._bucket(key), ()) if e.digest == digest] if self.filter.has(key) else []

    def find(self, digest: bytes, content: bytes) -> Entry | None:
        return next((e for e in self.of_digest(digest) if e.content == content), None)

    def add(self, digest: bytes, content: bytes) -> Entry:
        entry, key = Entry(digest, content, len(self.of_digest(digest))), self.key(digest)
        fresh = not any(self.key(e.digest) == key for e in self.held.get(self._bucket(key), ()))
        self.held.setdefault(self._bucket(key), []).append(entry)
        self.bytes += len(content) + 200
        if fresh and not self.filter.insert(key):
            self.resize()
        return entry

    def remove(self, entry: Entry) -> None:
        key = self.key(entry.digest)
        bucket = self.held[self._bucket(key)]
        bucket.remove(entry)
        if not bucket:
            del self.held[self._bucket(key)]
        self.bytes -= len(entry.content) + 200
        if not any(self.key(e.digest) == key for e in bucket):
            self.filter.delete(key)

    def resize(self) -> None:
        """A filter of twice the size, or more where that does not do, from the keys of the entries; they move to its buckets."""
        every, buckets = list(self.entries()), len(self.filter.table) // SLOTS
        keys = {self.key(e.digest) for e in every}
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            if all(map(self.filter.insert, keys)):
                break
        self.held = {}
        for e in every:
            self.held.setdefault(self._bucket(self.key(e.digest)), []).append(e)


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


class Rows:
    """Rows for Arrow batches of about OUT_BYTES."""

    def __init__(self, *fields: tuple[str, pa.DataType]):
        self.schema, self.rows, self.bytes = pa.schema(fields), [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.bytes += size + 64

    def full(self) -> bool:
        return self.bytes >= OUT_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [()] * len(self.schema)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return made


def fold(docs: DataFrame, doc_id: str, text: str, digest: Callable[[bytes], bytes]) -> DataFrame:
    """(digest, content, ids): the equal texts of a task's rows folded while its index holds them."""

    def run(batches):
        index, out = Index(), Rows(("digest", pa.binary()), ("content", pa.binary()), ("ids", pa.list_(pa.int64())))
        oldest: dict[int, Entry] = {}

        def emit(e: Entry) -> None:
            out.add((e.digest, e.content, e.ids), len(e.content) + 8 * len(e.ids))
            e.ids = []

        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = (value.as_py() or b"").lower()
                d = digest(content)
                e = index.find(d, content)
                if e is None:
                    e = index.add(d, content)
                    oldest[id(e)] = e
                e.ids.append(i)
                if len(e.ids) >= IDS:
                    emit(e)
                while index.bytes > SHARD_BYTES:
                    gone = oldest.pop(next(iter(oldest)))
                    index.remove(gone)
                    if gone.ids:
                        emit(gone)
                    if out.full():
                        yield out.batch()
                if out.full():
                    yield out.batch()
        for e in oldest.values():
            if e.ids:
                emit(e)
            if out.full():
                yield out.batch()
        yield out.batch()

    # bytes.lower() lower-cases A-Z alone.
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(run, "digest binary, content binary, ids array<long>")


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest (binary, of the normalised text)."""
    shards = max(1, -(-text_bytes(docs, text) // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, out = Index(), Rows(("digest", pa.binary()), ("class", pa.int32()), ("ids", pa.list_(pa.int64())), ("keep_id", pa.int64()), ("n", pa.int64()))
        for batch in batches:
            for d, content, ids in zip(*(batch.column(c) for c in ("digest", "content", "ids")), strict=True):
                d, content, ids = d.as_py(), content.as_py(), ids.as_py()
                e = index.find(d, content) or index.add(d, content)
                e.n += len(ids)
                e.keep = max((i for i in (e.keep, *ids) if i is not None), default=None)
                out.add((d, e.order, ids, None, None), 8 * len(ids))
                if out.full():
                    yield out.batch()
        for e in index.entries():
            out.add((e.digest, e.order, None, e.keep, e.n), 0)
            if out.full():
                yield out.batch()
        yield out.batch()

    # Names of the types: how applyInArrow tells the streaming form.
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    folded = fold(docs, doc_id, text, digest).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    records = save(folded.groupBy("shard").applyInArrow(run, "digest binary, class int, ids array<long>, keep_id long, n long"), "exact")
    classes = records.where("n is not null").select("digest", "class", "keep_id", F.col("n").alias("group_size"))
    joined = records.where("ids is not null").select("digest", "class", "ids").join(classes, ["digest", "class"])
    rows = joined.select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "digest")
    return rows.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "digest")


STATE = "shard long, digest binary, content binary, n long"


def change(index: DataFrame, inserted: DataFrame | None, deleted: DataFrame | None, shards: int, text: str = "text") -> DataFrame:
    """The index (shard, digest, content, n: live documents with that text) after the rows of `inserted` and then those of `deleted`.

    A digest whose last document goes is deleted; deletions of what is not there are ignored. The snapshot is written and read again.
    """
    spark = index.sparkSession
    none = spark.createDataFrame([], "digest binary, content binary, ids array<long>")
    counted = lambda df, sign: (none if df is None else fold(df.select(F.lit(None).cast("long").alias("_id"), text), "_id", text, sha256)).select("digest", "content", (F.size("ids") * sign).cast("long").alias("change"), F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"))

    def run(state: pa.Table, changes: pa.Table) -> pa.Table:
        own = Index(max(64, 1 << (state.num_rows // 2).bit_length()))
        for _, d, content, n in zip(*(state.column(c).to_pylist() for c in ("shard", "digest", "content", "n")), strict=True):
            own.add(d, content).n = n
        shard = (state if state.num_rows else changes).column("shard")[0].as_py()
        # Insertions first: a text may be inserted and deleted in one batch.
        for more in (True, False):
            for d, content, n in zip(*(changes.column(c).to_pylist() for c in ("digest", "content", "change")), strict=True):
                if (n > 0) != more:
                    continue
                e = own.find(d, content)
                if e is None:
                    if n <= 0:
                        continue
                    e = own.add(d, content)
                e.n += n
                if e.n <= 0:
                    own.remove(e)
        rows = [(shard, e.digest, e.content, e.n) for e in own.entries()]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)], ["shard", "digest", "content", "n"])

    both = counted(inserted, 1).union(counted(deleted, -1))
    return save(index.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(run, STATE), "index")


def build(docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """An index of docs; `shards` stays its own."""
    return change(docs.sparkSession.createDataFrame([], STATE), docs, None, shards, text)


def known(index: DataFrame, docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n) of each row of docs: how many live documents of the index have its text."""

    def run(state: pa.Table, asked: pa.Table) -> pa.Table:
        own = Index(max(64, 1 << (state.num_rows // 2).bit_length()))
        for d, content, n in zip(*(state.column(c).to_pylist() for c in ("digest", "content", "n")), strict=True):
            own.add(d, content).n = n
        found = [own.find(d, c) for d, c in zip(asked.column("digest").to_pylist(), asked.column("content").to_pylist(), strict=True)]
        return pa.table({"ids": asked.column("ids"), "n": pa.array([e.n if e else 0 for e in found], pa.int64())})

    asked = fold(docs, doc_id, text, sha256).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    found = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(run, "ids array<long>, n long")
    return found.select(F.explode("ids").alias("doc_id"), "n")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
