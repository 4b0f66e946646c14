"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A word is a run of letters (lower-cased); runs beyond PIECE letters are read as successive words of PIECE letters, whose
n-grams reach into the next one, so that text without spaces is read whole. A word is the mean of the embeddings of its
character 2- to 5-grams (with word ends marked) and of itself, hashed into BUCKETS rows of DIM numbers; a text is the mean of
its words. Embeddings and the softmax layer are trained together by stochastic gradient descent in numpy, in one task, on at
most SAMPLE labelled documents drawn by a hash of doc_id, about as many of each language. A fifth of the sample is kept apart:
on it the softmax's temperature is fitted and the rejection threshold is set to the score that REJECT of its right answers
fall below. Languages beyond the SAMPLE most frequent, for which the sample has no row, are not learned.

The model is bounded by its parameters. Texts are read as one array of code points, in blocks of about BLOCK; each different
word of a block is hashed once, in numpy. A longer text is cut into blocks, after white space where 1,000 code points hold some.

Defined cases: null texts and texts without a letter are `und` with score 0; without labelled rows every text is `und`;
rows with a null lang or doc_id are not learned from; repeated rows are predicted alike; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import pickle
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SAMPLE, BUCKETS, DIM, EPOCHS, RATE, BATCH, CHUNKS, REJECT = 4_000, 1 << 15, 16, 2, 2.0, 64, 4, 0.01
PIECE, BLOCK, SIZES = 32, 1 << 20, (2, 3, 4, 5)
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@cache
def _letters() -> np.ndarray:
    """Is it a letter, by code point."""
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), bool)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * _SPREAD) >> np.uint64(49)).astype(np.int32)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased code points of all texts with a 0 for each that is no letter, and where each text ends; a 0 parts them."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[codes], codes, 0).astype(np.uint64), np.cumsum([len(t) + 1 for t in lower])


def _ends(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of a mask whose first and last entries are false."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return edge[::2], edge[1::2]


def _sums_of_letters(c: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of n letters from starts: a sum over its letters, each weighed by its place."""
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = c[np.repeat(starts, n) + place]
    mixed = (own + place.astype(np.uint64) * np.uint64(0x110000) + np.uint64(1)) * _BASE
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _SPREAD
    total = np.r_[np.uint64(0), np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)]
    end = np.cumsum(n)
    return total[end] - total[end - n]


def subwords(c: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of code points as of _codes: pairs of arrays (bucket, word) of all subwords, by length and in order of words, and each word's start."""
    letter = c != 0
    first, last = _ends(letter)
    parts = (last - first + PIECE - 1) // PIECE
    word = np.arange(parts.sum())
    starts = np.repeat(first, parts) + (word - np.repeat(np.cumsum(parts) - parts, parts)) * PIECE
    n = np.minimum(np.repeat(last, parts) - starts, PIECE)
    of = np.zeros(len(c), np.int32)
    of[letter] = np.repeat(word, n)
    out, h, inner = [], c, None
    for size in SIZES:
        h = h[:-1] * _BASE + c[size - 1 :]
        if size == 2:
            valid = letter[:-1] | letter[1:]
        else:
            inner = valid = letter[1:-1] if size == 3 else inner[:-1] & letter[size - 2 : -1]
        sel = np.flatnonzero(valid)
        out.append((_buckets(h[sel] + np.uint64(size)), of[sel + ~letter[sel]]))
    out.append((_buckets(_sums_of_letters(c, starts, n)), word))
    return out, starts


def word_means(parts: list[tuple[np.ndarray, np.ndarray]], words: int, rows: np.ndarray) -> np.ndarray:
    """The mean row of each word's subwords; rows: a list of columns over the buckets."""
    n = sum(np.bincount(w, minlength=words) for _, w in parts)
    return np.stack([sum(np.bincount(w, column[b], words) for b, w in parts) for column in rows], 1) / np.maximum(n, 1)[:, None]


def _examples(texts: list[str], labels: list[int], rng) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """CHUNKS runs of 1 to 40 words of each text: buckets, weights and label; weights average subwords in words and words in texts."""
    out = []
    for t, y in zip(texts, labels, strict=True):
        parts, starts = subwords(_codes([t])[0])
        if not len(starts):
            continue
        bucket, word = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        bucket, size = bucket[order], np.bincount(word, minlength=len(starts))
        end = np.cumsum(size)
        for _ in range(CHUNKS):
            n = min(int(rng.integers(1, 41)), len(starts))
            a = int(rng.integers(0, len(starts) - n + 1))
            out.append((bucket[end[a] - size[a] : end[a + n - 1]], np.repeat(1 / (size[a : a + n] * n), size[a : a + n]), y))
    return out


def _flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, example and weight of every subword of a batch."""
    return np.concatenate([b for b, _, _ in batch]), np.repeat(np.arange(len(batch)), [len(b) for b, _, _ in batch]), np.concatenate([w for _, w, _ in batch])


def _sums(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of the rows by `of`, which is in ascending order."""
    return np.add.reduceat(rows, np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), axis=0)


def train(texts: list[str], langs: list[str], seed: int = 5) -> dict:
    """The fitted model: languages, embeddings, softmax layer, bias, temperature and rejection threshold."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    at = {n: i for i, n in enumerate(names)}
    order = rng.permutation(len(texts))
    cut = len(order) // 5
    fit, check = (_examples([texts[i] for i in part], [at[langs[i]] for i in part], rng) for part in (order[cut:], order[:cut]))
    emb, out, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(names))), np.zeros(len(names))
    share = np.bincount([y for *_, y in fit], minlength=len(names)) + 1.0
    balance = share.sum() / (len(names) * share)
    total, done = EPOCHS * max(1, len(fit)), 0
    while fit and done < total:
        batch = [fit[i] for i in rng.integers(0, len(fit), BATCH)]
        rate = RATE * (1 - done / total)
        done += BATCH
        ids, text, weight = _flat(batch)
        hidden = _sums(emb[ids] * weight[:, None], text)
        p = _softmax(hidden @ out + bias)
        y = np.array([b[2] for b in batch])
        p[np.arange(len(batch)), y] -= 1
        p *= balance[y][:, None] / np.sqrt(BATCH)
        back = p @ out.T
        out -= rate * hidden.T @ p
        bias -= rate * p.sum(0)
        order = np.argsort(ids, kind="stable")
        emb[np.unique(ids)] -= _sums((rate * back[text] * weight[:, None])[order], ids[order])
    model = {"names": names, "emb": emb.astype(np.float32), "out": out.astype(np.float32), "bias": bias, "temperature": 1.0, "threshold": 0.0}
    if check:
        ids, text, weight = _flat(check)
        logits, truth = _sums(emb[ids] * weight[:, None], text) @ out + bias, np.array([y for *_, y in check], int)
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model["temperature"] = float(min(np.geomspace(0.1, 10, 61), key=loss))
        p = _softmax(logits / model["temperature"])
        right = p.max(1)[p.argmax(1) == truth]
        model["threshold"] = float(np.quantile(right, REJECT)) if len(right) else 0.0
    return model


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict | None:
    """Trains on at most SAMPLE rows with a language, of each language the same number where it has as many, in one task."""
    known = docs.select(F.col("doc_id").cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    # The sample has no room for more than SAMPLE languages; the most frequent ones are drawn from.
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(SAMPLE)
    languages = sizes.count()
    if not languages:
        return None
    share = F.lit(0.9 * SAMPLE / languages) / F.col("n")
    drawn = known.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "id", "text").limit(SAMPLE)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("lang").to_pylist(), table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True))
        return pa.table({"model": pa.array([pickle.dumps(train([t for _, _, t in rows], [y for y, _, _ in rows]))], pa.binary())})

    made = drawn.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else None


def text_sums(texts: list[str], columns: np.ndarray) -> np.ndarray:
    """Of each text the sum of its words' rows, and their number; a run of letters that recurs is hashed once."""
    c, end = _codes(texts)
    first, last = _ends(c != 0)
    n = last - first
    key = _sums_of_letters(c, first, np.minimum(n, PIECE))
    long = np.flatnonzero(n > PIECE)
    key[long] = long.astype(np.uint64) * _SPREAD
    _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
    size = n[index]
    at = np.cumsum(size + 1) - size
    compact = np.zeros(len(index) + 1 + size.sum(), np.uint64)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    compact[np.repeat(at, size) + step] = c[np.repeat(first[index], size) + step]
    parts, starts = subwords(compact)
    mean = word_means(parts, len(starts), columns)
    run = np.searchsorted(at, starts, "right") - 1
    rows = [*(np.bincount(run, column, len(at)) for column in mean.T), np.bincount(run, minlength=len(at))]
    of = np.searchsorted(end, first - 1, "right")
    return np.stack([np.bincount(of, row[inverse], len(texts)) for row in rows], 1)


def _blocks(texts: list[str | None]):
    """(numbers of texts, their text) in blocks of about BLOCK code points; a longer text comes in several."""
    numbers, held, size = [], [], 0
    for i, t in enumerate(texts):
        at, t = 0, t or ""
        while at < len(t):
            end = at + BLOCK
            if end < len(t):
                end = next((k + 1 for k in range(end - 1, end - 1_001, -1) if t[k].isspace()), end)
            numbers.append(i)
            held.append(t[at:end])
            size += len(held[-1])
            at = end
            if size >= BLOCK:
                yield numbers, held
                numbers, held, size = [], [], 0
    if held:
        yield numbers, held


def predict(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Language and calibrated probability of each text."""
    # The linear layers are multiplied out where that is narrower than the embeddings.
    narrow = len(model["names"]) < DIM
    columns = np.ascontiguousarray((model["emb"] @ model["out"] if narrow else model["emb"]).T, float)
    sums = np.zeros((len(texts), len(columns) + 1))
    for numbers, held in _blocks(texts):
        np.add.at(sums, numbers, text_sums(held, columns))
    mean, n = sums[:, :-1] / np.maximum(sums[:, -1:], 1), sums[:, -1]
    p = _softmax(((mean if narrow else mean @ model["out"]) + model["bias"]) / model["temperature"])
    best = p.argmax(1)
    return [model["names"][b] if k else "und" for b, k in zip(best, n, strict=True)], np.where(n > 0, p.max(1), 0.0).tolist()


def identify(docs: DataFrame, model: dict | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred, score (calibrated probability) and rejected (score below the threshold, or `und`)."""
    base = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                names, score = predict(part.column(len(keep)).to_pylist(), model) if model else (["und"] * part.num_rows, [0.0] * part.num_rows)
                low = model["threshold"] if model else 1.0
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array([s < low or n == "und" for s, n in zip(score, names, strict=True)], pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    out = identify(docs, fit(docs.where(~held())))
    return out.select("doc_id", held().alias("held_out"), "lang_pred", "score", "rejected")
