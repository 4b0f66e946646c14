"""Toxicity: misspelled lexicon terms by Levenshtein automata over a trie, weighed by their context window.

1. Lexicon. From at most SAMPLE labelled documents the words and word beginnings (stems) that mark toxic documents are
   counted in Spark; the best LEXICON of them, by smoothed log odds less ERRORS of their standard errors, go into a trie. A stem
   matches any word that begins with it.
2. Matching. The Levenshtein automaton of a word is intersected with the trie; terms under 5 letters allow no edit, those of 12
   or more allow two. Results are remembered by word. A word of many runs of letters is read run by run, or as one word where
   it spells letters out; a run of over LONG letters is searched for terms and stems at every place.
3. Context. A window of WINDOW words around a hit tells quotation (quote marks around it, or a reporting word before it)
   from abuse. Six counts (exact, stem and fuzzy hits, each quoted or not) enter a logistic model fitted on the same
   sample by Newton steps; weights of quoted hits have a prior near zero, so that unseen quotation does not accuse.

The model is bounded (LEXICON terms, seven weights) and goes to the tasks with the function. Labels, lang, source and
doc_id are no inputs of a score.

Defined cases: a document with labels of both kinds counts as toxic; an empty table gives no rows; null and empty texts score as texts without hits; without labelled rows every score is 0.1; rows with a null
doc_id or a null label are not learned from; repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, words

SAMPLE, LEXICON, WINDOW, STEMS, RUNS, LONG = 20_000, 1_000, 4, (4, 5, 6, 7, 8), 8, 40
#: Least log odds over the sample's own, less their error, of a term and of a stem.
ODDS, ERRORS = (1.77, 2.6), 1.64
#: Words that report another's speech.
REPORTING = frozenset(b"said says say saying called calls wrote writes quoted quote quotes cited cites reported term word sagte schrieb dit dijo".split())
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = ".,;:!?()'\""
_QUOTES = ('"', "'", "“", "”", "«", "»", "„", "`")


def cores(word: bytes) -> list[str]:
    """The lower-cased letters of a word: joined where it has few runs of letters or spells letters out, else each run by itself."""
    plain = word.decode("utf-8", "replace").lower()
    inner = plain.strip(_MARKS)
    if inner.isalpha():
        return [inner]
    found = _LETTERS.findall(plain)
    joined = "".join(found)
    return [joined] if found and (len(found) < RUNS or len(joined) <= 2 * len(found)) else found


def edits(term: str) -> int:
    """How many edits of a term are forgiven."""
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


def less(word: str) -> list[str]:
    """The word, and with one letter left out."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


def parts(term: str, n: int) -> list[tuple[int, str]]:
    """n parts of a term with their places, one of which n - 1 edits leave whole."""
    cuts = [len(term) * k // n for k in range(n + 1)]
    return [(x, term[x:y]) for x, y in zip(cuts, cuts[1:])]


def places(terms: list[str], most: int) -> dict[int, list[tuple[int, int, dict[str, dict]]]]:
    """By the letters of a word: from, to, and the parts of terms that it can hold there with `most` edits, each with a trie of
    these terms. Places that hold the same terms share one."""
    found: dict = {}
    for t in terms:
        for at, x in parts(t, most + 1):
            for d in range(-most, most + 1):
                for k in range(-most, most + 1):
                    if at + k >= 0:
                        found.setdefault(len(t) + d, {}).setdefault((at + k, at + k + len(x)), {}).setdefault(x, set()).add(t)
    tries: dict = {}
    for by in found.values():
        for own in by.values():
            for x, those in own.items():
                key = frozenset(those)
                if key not in tries:
                    tries[key] = trie(sorted(key))
                own[x] = tries[key]
    return {n: [(a, b, own) for (a, b), own in by.items()] for n, by in found.items()}


def trie(terms: list[str]) -> dict:
    """Nested by letter; the empty key holds the edits that the term ending there allows."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = edits(term)
    return root


class Matcher(dict):
    """kind of hit by word (bytes): 0 none, 1 exact term, 2 stem, 3 fuzzy term, -1 if it is to be searched by `inside`; remembers a
    bounded number of words."""

    def __init__(self, terms: list[str], stems: list[str], most: int = 600_000):
        super().__init__()
        self.most, self.terms, self.stems = most, set(terms), set(stems)
        self.sizes = sorted({len(s) for s in stems})
        self.least = self.sizes[0] if stems else 0
        self.heads = {s[: self.least] for s in stems}
        self.spans = sorted({len(x) for x in (*terms, *stems) if len(x) >= 5}, reverse=True)
        self.forms = {x for t in terms if edits(t) for x in less(t)}
        self.places = {k: places([t for t in terms if edits(t) >= k], k) for k in (1, 2)}

    def fuzzy(self, word: str) -> bool:
        """Is a term within its edits of the word?

        A word n edits from a term holds one of its n + 1 parts, at most n places off; a word without any is left at once, and one
        with a part meets the terms of that part alone. One edit from a term it also shares a form with a letter left out. For the
        words that are left the Levenshtein automaton of the word, whose states are sets of (letters read, edits) held as bits, is
        intersected with the trie of these terms: it steps along the branches as long as it has a state.
        """
        tries = self.held(word, 1)
        if tries and not self.forms.isdisjoint(less(word)) and any(self.walk(word, t, 1) for t in tries):
            return True
        return any(self.walk(word, t, 2) for t in self.held(word, 2))

    def held(self, word: str, most: int) -> list[dict]:
        """The tries of the parts that the word holds where `most` edits can put them."""
        return [own[x] for a, b, own in self.places[most].get(len(word), ()) if (x := word[a:b]) in own]

    @staticmethod
    def walk(word: str, root: dict, most: int) -> bool:
        """Does the automaton of the word, of at most `most` edits, accept a term of the trie with no more edits than it allows?"""
        end, place = 1 << len(word), {}
        for i, c in enumerate(word):
            place[c] = place.get(c, 0) | 1 << i
        every = 2 * end - 1
        todo = [(root, 1, 3 & every, 7 & every if most > 1 else 0)]
        while todo:
            node, r0, r1, r2 = todo.pop()
            for c, child in node.items():
                if c == "":
                    continue
                at = place.get(c, 0)
                n0 = (r0 & at) << 1
                n1 = ((r1 & at) << 1 | r0 | r0 << 1 | n0 << 1) & every
                n2 = ((r2 & at) << 1 | r1 | r1 << 1 | n1 << 1) & every if most > 1 else 0
                allowed = child.get("", 0)
                if allowed and n1 & end or allowed > 1 and n2 & end:
                    return True
                if n1 or n2:
                    todo.append((child, n0, n1, n2))
        return False

    def kind(self, w: str) -> int:
        if w in self.terms:
            return 1
        if w[: self.least] in self.heads and any(w[:n] in self.stems for n in self.sizes):
            return 2
        return 3 if len(w) >= 4 and self.fuzzy(w) else 0

    def inside(self, word: bytes) -> list[int]:
        """Kinds of the hits in a word of many runs or of very many letters, from left to right; of a run of over LONG letters those of
        its beginning and the exact terms and stems of 5 letters or more anywhere in it."""
        out = []
        for run in cores(word):
            if len(run) <= LONG:
                out.append(self.kind(run))
                continue
            at = 0
            while at < len(run):
                n = next((n for n in self.spans if run[at : at + n] in self.terms or run[at : at + n] in self.stems), 0)
                if n:
                    out.append(1 if run[at : at + n] in self.terms else 2)
                elif at == 0 and any(run[:k] in self.stems for k in self.sizes):
                    out.append(2)
                at += n or 1
        return [k for k in out if k]

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        own = cores(word)
        if len(own) > 1 or own and len(own[0]) > LONG:
            return -1
        kind = self[word] = self.kind(own[0]) if own else 0
        return kind


def features(text: str | None, match: Matcher) -> list[int]:
    """Counts of exact, stem and fuzzy hits, then of the quoted ones."""
    found = words(text)
    out = [0] * 6
    kinds = list(map(match.__getitem__, found))
    if any(kinds):
        for i, kind in enumerate(kinds):
            if kind:
                around = found[max(0, i - WINDOW) : i + WINDOW + 1]
                here = min(i, WINDOW)
                left, right = b" ".join(around[: here + 1]).decode("utf-8", "replace"), b" ".join(around[here:]).decode("utf-8", "replace")
                quoted = any(q in left for q in _QUOTES) and any(q in right for q in _QUOTES) or any(w.strip(b".,:;!?").lower() in REPORTING for w in around[:here])
                for k in (kind,) if kind > 0 else match.inside(found[i]):
                    out[k - 1 + 3 * quoted] += 1
    return out


def _score(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.log1p(counts) @ weights[1:] + weights[0], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic") -> tuple[list[str], list[str], np.ndarray]:
    """(terms, stems, weights) learned from at most SAMPLE rows of labels (doc_id, label), drawn by a hash of doc_id."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    n = known.count()
    share = min(1.0, 0.9 * SAMPLE / max(1, n))
    drawn = known.where((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))).groupBy("id").agg(F.max("y").alias("y")).limit(SAMPLE)
    sample = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).select("text", "y")

    def tally(batches):
        every: Counter = Counter()
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = int(y > 0)
                own = {c for w in set(words(t)) for c in cores(w)}
                every.update(((0, w, y) for w in own if 3 <= len(w) <= LONG))
                every.update(((1, s, y) for s in {w[:k] for w in own for k in STEMS if len(w) > k}))
        rows = [(k, w, y, c) for (k, w, y), c in every.items()]
        for i in range(0, len(rows), 50_000):
            k, w, y, c = zip(*rows[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(w, pa.string()), pa.array(y, pa.int32()), pa.array(c, pa.int64())], ["kind", "word", "y", "n"])

    sums = sample.mapInArrow(tally, "kind int, word string, y int, n long").groupBy("kind", "word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
    whole = sample.agg(F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0)).alias("pos"), F.coalesce(F.sum((F.col("y") <= 0).cast("long")), F.lit(0)).alias("neg")).first()
    if not whole["pos"]:
        return [], [], np.array([math.log(0.1 / 0.9), 0, 0, 0, 0, 0, 0], float)
    prior = math.log((whole["pos"] + 0.5) / (whole["neg"] + 0.5))
    odds = F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5))
    sure = odds - prior - ERRORS * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    fits = (odds > 1) & (sure > F.when(F.col("kind") == 0, ODDS[0]).otherwise(ODDS[1]))
    marked = sums.where(fits).orderBy(sure.desc(), "kind", "word").limit(3 * LEXICON).collect()
    terms, stems = ([r["word"] for r in marked if r["kind"] == k][:LEXICON] for k in (0, 1))
    stems = [s for s in stems if not any(s != p and s.startswith(p) for p in stems)]

    def counts(batches):
        match = Matcher(terms, stems)
        for batch in batches:
            out = [features(t, match) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), batch.column(1)], ["counts", "y"])

    groups = sample.mapInArrow(counts, "counts array<int>, y int").groupBy("counts", F.expr("y > 0").alias("y")).count().limit(SAMPLE).collect()
    x = np.log1p(np.array([r["counts"] for r in groups], float))
    y, w = np.array([r["y"] for r in groups], float), np.array([r["count"] for r in groups], float)
    x = np.c_[np.ones(len(x)), x]
    centre, strength = np.array([prior, 4, 4, 4, 0, 0, 0], float), np.array([0.1, 0.5, 0.5, 0.5, 2, 2, 2])
    b = centre.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (p - y)) + strength * (b - centre)
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + np.diag(strength), grad)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return terms, stems, b


def score_toxicity(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of every row (the text itself may be one), its hit counts and its score between 0 and 1."""
    terms, stems, weights = model
    base = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        match = Matcher(terms, stems)
        for batch in batches:
            counts = np.array([features(t, match) for t in batch.column(len(keep)).to_pylist()], np.int64).reshape(-1, 6)
            rest = [*(batch.column(i) for i in range(len(keep))), pa.array(counts[:, :3].sum(1)), pa.array(counts[:, 3:].sum(1)), pa.array(_score(counts, weights))]
            yield pa.RecordBatch.from_arrays(rest, [*keep, "hits", "quoted_hits", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    return base.mapInArrow(run, f"{kinds}, hits long, quoted_hits long, score double")


def held_out(i):
    return F.coalesce(F.crc32(i.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
