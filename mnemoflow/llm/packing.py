"""Best-fit packing of token pieces into fixed-length sequences by a grouping genetic algorithm on islands.

Pieces are dealt by a hash into shards of about SHARD pieces; each shard is packed by ISLANDS populations. An individual is
an assignment of pieces to bins. Crossover injects whole well-filled bins of one parent into another, removes the bins that
hold duplicates of the injected pieces, and best-fits the displaced pieces. After each round the elites of an island migrate
to the next one (a shuffle of packed assignments); at the end each shard takes its best individual. Bins that a shard leaves
with more than 1 / SLACK of their room go back: their pieces, of all shards, are dealt and packed again, until one shard is left
or most bins stay open (pieces too large to share a bin, which no other dealing helps).

Tokens: the ids of byte_bpe_50k.json. Its merges and the rank file hold the same vocabulary, so the ids come from the rank
file (3.5 times as fast here; tests compare both); texts that name the vocabulary's special token go to `tokenizers`. Each
document ends in id 0; longer ones are cut into pieces of the full length, the first piece being the shorter one.

Defined cases: null and empty texts are the one id 0; repeated rows are packed each; a null doc_id is kept as such; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, table

SHARD, ISLANDS, ROUNDS, GENERATIONS, POPULATION, ELITES, SLACK = 4_000, 2, 2, 6, 4, 2, 50


@cache
def _encoders(json_path: str, rank_path: str, pattern: str):
    import tiktoken
    from tokenizers import Tokenizer

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = Tokenizer.from_file(json_path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), whole, special


def default_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def token_ids(text: str | None, tokenizer: tuple[str, str, str]) -> np.ndarray:
    quick, whole, special = _encoders(*tokenizer)
    if not text:
        ids = []
    elif any(s in text for s in special):
        ids = whole.encode(text, add_special_tokens=False).ids
    else:
        ids = quick.encode_ordinary(text)
    return np.array([*ids, 0], "<u4")


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of full length but perhaps the first."""
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def token_pieces(docs: DataFrame, text: str = "text", length: int = 2048, tokenizer: tuple[str, str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row's tokens."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(t.as_py(), tokenizer)
                for k, (s, n) in enumerate(cuts(len(ids), length)):
                    part = ids[s : s + n]
                    rows.append((i, k, s, n, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            columns = zip(*rows, strict=True) if rows else [[]] * (5 + with_ids)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], NAMES + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, ", ".join(f"{n} long" for n in NAMES) + ", ids array<int>" * with_ids)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def best_fit(order, sizes, capacity: int, bins: list[list[int]], room: list[int]) -> None:
    """Puts each item of `order` into the bin with the least sufficient room, or into a new one; changes bins and room."""
    free = sorted((r, b) for b, r in enumerate(room) if r)
    for i in order:
        n = sizes[i]
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            r, b = free.pop(at)
        else:
            r, b = capacity, len(bins)
            bins.append([])
            room.append(capacity)
        bins[b].append(i)
        room[b] = r - n
        if r > n:
            bisect.insort(free, (r - n, b))


def fitness(room: list[int], capacity: int) -> float:
    """Fewer bins first, then fuller ones: mean square fill minus the number of bins."""
    return -len(room) + sum((1 - r / capacity) ** 2 for r in room) / max(1, len(room))


def crossover(a, b, sizes, capacity: int, rng):
    """Well-filled bins of b, whole, into a; bins of a that share pieces go and their other pieces are best-fitted."""
    bins_b, room_b = b
    full = [k for k, r in enumerate(room_b) if r <= capacity // SLACK]
    if not full:
        full = np.argsort(room_b, kind="stable")[: max(1, len(room_b) // 4)].tolist()
    picked = [k for k in full if rng.random() < 0.5] or full[:1]
    inside = {i for k in picked for i in bins_b[k]}
    bins, room, displaced = [list(bins_b[k]) for k in picked], [room_b[k] for k in picked], []
    for items, r in zip(*a, strict=True):
        if inside.isdisjoint(items):
            bins.append(list(items))
            room.append(r)
        else:
            displaced += [i for i in items if i not in inside]
    # The worst bins are dissolved as well, so that their pieces can find better places.
    for k in sorted(range(len(room)), key=room.__getitem__, reverse=True)[: max(1, len(room) // 20)]:
        displaced += bins[k]
        bins[k], room[k] = [], capacity
    keep = [k for k in range(len(bins)) if bins[k]]
    bins, room = [bins[k] for k in keep], [room[k] for k in keep]
    displaced.sort(key=lambda i: (-sizes[i], i))
    best_fit(displaced, sizes, capacity, bins, room)
    return bins, room


def evolve(sizes: list[int], capacity: int, seed: int, migrants: list[np.ndarray], generations: int = GENERATIONS):
    """The best individuals, best first, of one island's round; starts from migrants, best fit decreasing and shuffles."""
    rng = np.random.default_rng(seed)
    down = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    people = []

    def add(bins, room):
        people.append((fitness(room, capacity), bins, room))

    for m in migrants:
        bins: list[list[int]] = [[] for _ in range(int(m.max(initial=-1)) + 1)]
        for i, b in enumerate(m.tolist()):
            bins[b].append(i)
        add(bins, [capacity - sum(sizes[i] for i in x) for x in bins])
    while len(people) < POPULATION:
        order = down if not people else sorted(down, key=lambda i: -sizes[i] * (1 + 0.3 * rng.random()))
        bins, room = [], []
        best_fit(order, sizes, capacity, bins, room)
        add(bins, room)
    least = -(-sum(sizes) // capacity)
    for _ in range(generations):
        people.sort(key=lambda p: -p[0])
        if len(people[0][2]) <= least:
            break
        i, j = rng.choice(min(len(people), POPULATION), 2, replace=False)
        add(*crossover(people[i][1:], people[j][1:], sizes, capacity, rng))
        people = sorted(people, key=lambda p: -p[0])[:POPULATION]
    people.sort(key=lambda p: -p[0])
    return people[:ELITES]


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (NAMES and any other columns) with sequence_id and offset added."""
    done, level, total = [], 0, pieces.count()
    while True:
        shards = max(1, -(-total // SHARD))
        placed = pack_shards(pieces, capacity, shards, level)
        if shards > 1:
            placed = save(placed, "placed")
            full = F.col("room") * SLACK <= F.lit(capacity)
            left = placed.where(~full).count()
            if 2 * left <= total:
                done.append(placed.where(full).drop("room"))
                pieces, level, total = placed.where(~full).drop("room", "sequence_id", "offset"), level + 1, left
                continue
        done.append(placed.drop("room"))
        return reduce(DataFrame.unionByName, done)


def pack_shards(pieces: DataFrame, capacity: int, shards: int, level: int) -> DataFrame:
    """pieces with sequence_id, offset and the room that their bin has left, packed in shards by themselves."""
    extra = [f for f in pieces.schema.fields if f.name not in ("shard", "island")]
    dealt = pieces.select(*(f.name for f in extra), F.pmod(F.xxhash64(*NAMES, F.lit(level)), F.lit(shards)).alias("shard"))

    def ordered(table: pa.Table) -> pa.Table:
        return table.sort_by([(n, "ascending") for n in NAMES])

    def step(table: pa.Table, elites: pa.Table) -> pa.Table:
        names = ["shard", "island", "score", "bins"]
        if not table.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, (pa.int64(), pa.int32(), pa.float64(), pa.binary()), strict=True)})
        shard, island = table.column("shard")[0].as_py(), table.column("island")[0].as_py()
        sizes = [n for n in ordered(table).column("length").to_pylist() if n < capacity]
        known = sorted(zip(elites.column("score").to_pylist(), elites.column("bins").to_pylist(), strict=True), reverse=True)
        best = evolve(sizes, capacity, shard * 31 + island * 7 + len(known), [np.frombuffer(b, np.int32) for _, b in known])
        out = []
        for _, bins, _ in best:
            at = np.empty(len(sizes), np.int32)
            for b, items in enumerate(bins):
                at[items] = b
            out.append(at.tobytes())
        k = len(best)
        return pa.table({"shard": pa.array([shard] * k, pa.int64()), "island": pa.array([island] * k, pa.int32()), "score": pa.array([p[0] for p in best], pa.float64()), "bins": pa.array(out, pa.binary())})

    def place(table: pa.Table, best: pa.Table) -> pa.Table:
        table = ordered(table)
        length = table.column("length").to_numpy()
        bins = np.empty(table.num_rows, np.int64)
        part = length < capacity
        at = np.frombuffer(best.column("bins")[0].as_py(), np.int32)
        bins[part] = at
        bins[~part] = int(at.max(initial=-1)) + 1 + np.arange((~part).sum())
        order = np.argsort(bins, kind="stable")
        run, first = length[order], np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])
        before = np.cumsum(run) - run
        offset = np.empty(len(order), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.r_[first, len(order)]))
        room = capacity - np.bincount(bins, length).astype(np.int64)[bins]
        number = (level << 56) + (table.column("shard")[0].as_py() << 32) + bins
        return table.drop_columns(["shard"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).append_column("room", pa.array(room))

    elite = "shard long, island int, score double, bins binary"
    isles = dealt.select("shard", "length", *(n for n in NAMES if n != "length"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    elites = pieces.sparkSession.createDataFrame([], elite)
    for _ in range(ROUNDS):
        moved = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
        elites = save(isles.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island")).applyInArrow(step, elite), "elites")
    best = elites.groupBy("shard").agg(F.max_by("bins", "score").alias("bins"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)
    return dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(place, f"{kinds}, sequence_id long, offset long, room long")


def pack_documents(docs: DataFrame, text: str = "text", length: int = 2048, tokenizer: tuple[str, str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of docs with their place: NAMES, [ids,] sequence_id, offset."""
    return pack(save(token_pieces(docs, text, length, tokenizer, with_ids), "pieces"), length)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
