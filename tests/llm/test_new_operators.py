"""Exact dedup, hard negatives and the source audit against brute force: nulls, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from mnemoflow.llm import exact_dedup, hard_negatives, source_audit

CLASHING = ", digest string, shard int, ids int, n int, class string, block int, key string, chunk string, term string, counts int"


def clashing(spark, rows, schema):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "c", 4, "k", "h", "t", 5) for r in rows], schema + CLASHING)


# 11
def test_filter_forgets_what_is_deleted_and_never_what_is_held():
    rng = random.Random(11)
    keys = [rng.getrandbits(64) for _ in range(900)]
    f = exact_dedup.CuckooFilter(256)
    assert all(map(f.insert, keys)) and all(map(f.has, keys))
    for k in keys[:450]:
        f.delete(k)
    assert all(map(f.has, keys[450:])) and f.size == 450
    assert sum(map(f.has, keys[:450])) <= 5
    assert sum(f.has(rng.getrandbits(64)) for _ in range(20_000)) <= 40


def test_index_grows_from_its_stored_keys():
    index = exact_dedup.Index(1)
    texts = [str(i).encode() for i in range(500)]
    entries = [index.add(exact_dedup.sha256(t), t) for t in texts]
    assert len(index.filter.table) > 500 and all(index.find(exact_dedup.sha256(t), t) is e for t, e in zip(texts, entries, strict=True))
    for e in entries[::2]:
        index.remove(e)
    assert [index.find(exact_dedup.sha256(t), t) is not None for t in texts] == [i % 2 == 1 for i in range(500)]
    assert sorted(e.content for e in index.entries()) == sorted(texts[1::2])


TEXTS = [(1, "Ab c"), (2, "aB C"), (3, "ab c "), (4, None), (5, ""), (6, "ÀB"), (7, "Àb"), (8, "àb"), (9, "x" * 300_000), (10, "X" * 300_000), (11, "y"), (11, "y"), (None, "y"), (None, "z"), (None, "z")]


def brute_force(texts):
    low = lambda t: (t or "").encode().lower()
    groups = {}
    for i, t in texts:
        groups.setdefault(low(t), []).append(i)
    key = lambda r: repr(r)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[low(t)], len(groups[low(t)]), i == keep[low(t)], hashlib.sha256(low(t)).hexdigest()) for i, t in texts), key=key)


@pytest.mark.parametrize("held", [32 << 20, 300])
def test_duplicates_equal_brute_force_and_survive_eviction(spark, monkeypatch, held):
    monkeypatch.setattr(exact_dedup, "SHARD_BYTES", held)
    monkeypatch.setattr(exact_dedup, "IDS", 2)
    rows = exact_dedup.duplicates(clashing(spark, TEXTS * 3, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in rows), key=repr) == brute_force(TEXTS * 3)


def test_texts_of_one_digest_are_told_apart_by_content(spark):
    rows = exact_dedup.duplicates(spark.createDataFrame([(i, t) for i, t in TEXTS if t is None or len(t) < 9], "doc_id long, text string"), digest=lambda b: bytes([len(b) % 2])).collect()
    want = brute_force([(i, t) for i, t in TEXTS if t is None or len(t) < 9])
    assert sorted((tuple(r)[:4] for r in rows), key=repr) == sorted((w[:4] for w in want), key=repr)


def test_duplicates_of_an_empty_table(spark):
    assert exact_dedup.duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_an_index_takes_insertions_and_deletions(spark):
    of = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = exact_dedup.build(of("a", "A", "b", None, "c"), 3)
    seen = lambda ix, *texts: [n for _, n in sorted(exact_dedup.known(ix, of(*texts), 3).collect())]
    assert seen(index, "a", "b", "", "d", "A") == [2, 1, 1, 0, 2]
    index = exact_dedup.change(index, of("d", "d"), of("a", "b", "not there"), 3)
    assert seen(index, "a", "b", "", "d", "A", "not there") == [1, 0, 1, 2, 1, 0]
    assert exact_dedup.change(index, None, of("a", "c", "", "d", "d"), 3).count() == 0


# 12
def negatives_by_brute_force(rows, scale=256, k=5):
    fine = [(i, l, [int(np.floor(scale * float(x))) if abs(x) < 1e15 else int(x) * scale for x in v]) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in fine), default=0)
    fine = [(i, l, v + [0] * (width - len(v))) for i, l, v in fine]
    out = []
    for a, l, v in fine:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), c, m) for c, m, w in fine if c != a]
        for s, p, _ in sorted(x for x in scored if x[2] == l)[:k]:
            found = sorted((t, c) for t, c, m in scored if m != l and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(a, p, r + 1, c, -s, -t) for r, (t, c) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [65_536, 40])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rng = random.Random(12)
    rows = [(i, rng.randrange(3), [round(rng.gauss(0.5, 1), rng.choice((0, 3))) for _ in range(rng.choice((11, 11, 4)))]) for i in range(420)]
    rows += [(None, 1, [1.0]), (500, None, [1.0]), (501, 1, None), (502, 1, [None, 1.0]), (503, 1, [float("nan")]), (504, 1, [float("inf")]), (600, 2, []), (700, 1, [0.0] * 11), (800, 0, [-3.0] * 11)]
    rows += [(900 + i, i % 2, [2.0] * 11) for i in range(30)] + rows[3:6]
    table = clashing(spark, rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(table, table.where("vec_id % 100 = 0")).collect())
    assert got == negatives_by_brute_force(rows) and len(got) > 50


def test_repeated_anchors_have_results_of_their_own(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (3, 2, [0.9, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(table, table.where("vec_id % 100 = 0")).collect())
    assert got == sorted([(0, 1, 1, 2, 65536, 65536), (0, 1, 2, 3, 65536, 256 * 230)] * 2)


def test_negatives_of_numbers_beyond_64_bits(spark):
    rng = random.Random(13)
    rows = [(i, rng.randrange(2), [rng.choice((1.0, 2.0, -1.0)) * 10.0 ** rng.choice((3, 30, 150)) for _ in range(3)]) for i in range(120)] + [(100, 1, [1.7e308] * 3), (121, 1, [1.6e308] * 3), (122, 0, [1.5e308] * 3)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(table, table.where("vec_id % 100 = 0")).collect())
    assert got == sorted((*x[:4], str(x[4]), str(x[5])) for x in negatives_by_brute_force(rows)) and got


def test_negatives_of_an_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(table, table).count() == 0


def test_survivors_hold_the_best_of_any_rotation():
    rng = np.random.default_rng(5)
    for _ in range(40):
        x = rng.integers(-300, 300, (200, 20))
        rotation = np.linalg.qr(rng.normal(size=(20, 20)))[0]
        block = hard_negatives.Rotated(x, rotation, 1024)
        exact = x @ x[7]
        kept = hard_negatives.survivors(block, block, 7, np.arange(200), 5, [(-np.inf, np.inf)], hard_negatives.slack(rotation))
        assert set(np.argsort(-exact, kind="stable")[:5]) <= set(kept)
        most = float(np.sort(exact)[-20]) / 1024**2
        kept = hard_negatives.survivors(block, block, 7, np.arange(200), 5, [(0.8 * most, most)], hard_negatives.slack(rotation))
        within = np.flatnonzero((exact <= most * 1024**2) & (exact >= 0.8 * most * 1024**2))
        assert set(within[np.argsort(-exact[within], kind="stable")[:5]]) <= set(kept)


# 13
def audit_by_brute_force(rows, least=10):
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    find = lambda t: "".join(c if c.isalpha() or not c.isascii() else " " for c in low(t)).split(" ")
    docs = [(l or "", s or "", [w for w in find(t) if w]) for t, l, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted((w for w, c in df.items() if c >= least), key=str.encode)
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2] if df[w] >= least) for s in {d[1] for d in own}}
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        q, ps = p(sum(counts.values(), Counter())), {s: p(c) for s, c in counts.items()}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = sorted(((-sum(f(ps[s][w], ps[t][w]) for w in kept), t.encode(), t) for t in counts if t != s))
            out += [(lang, s, "pair", t, -v, i + 1) for i, (v, _, t) in enumerate(pairs)]
            best = sorted((-f(ps[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and ps[s][w] > q[w])[:10]
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 20, 12])
def test_audit_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(source_audit, "CELLS", cells)
    monkeypatch.setattr(source_audit, "HELD", 50)
    rng = random.Random(13)
    vocabulary = [rng.choice(("", "É", "z", "日", "𝒳", "Q")) + rng.choice("abcdE") * rng.randrange(1, 4) for _ in range(40)]
    rows = [(rng.choice((" ", "-1", "\x00", "[")).join(rng.choice(vocabulary) for _ in range(rng.randrange(30))), rng.choice(("en", "de", None)), rng.choice(("a", "b", "é", "B", None))) for _ in range(150)]
    rows += [(None, "en", "a"), ("", "xx", "only"), ("rare words", "yy", "p"), ("", "yy", "q"), (None, "yy", "empty"), ("W" * 100_000, "en", "a")] + [("W" * 70_000 + " tie eit", "zz", s) for s in ("p", "q", "q") * 5]
    got = sorted(tuple(r) for r in source_audit.audit(clashing(spark, rows, "text string, lang string, source string")).collect())
    assert got == audit_by_brute_force(rows)


def test_audit_of_an_empty_table(spark):
    assert source_audit.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_weights_beyond_64_bits():
    counts = np.array([0, 1 << 40, 7])
    assert source_audit.weights(counts, 1 << 41, 3).tolist() == [1 + 10**9 * (int(c) + 2) // ((1 << 41) + 6) for c in counts]
