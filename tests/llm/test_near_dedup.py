"""Near-duplicates against brute force over all pairs, with chains, ties, repeated rows, nulls and clashing columns."""

import random

from mnemoflow.llm.near_dedup import near_duplicates


def brute(rows, size, percent):
    sets, parent = {}, {}
    for i, t in rows:
        ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        own = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if len(ws) >= size else ({tuple(ws)} if ws else set())
        sets.setdefault(i, []).append(own)
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if any(p and q and 100 * len(p & q) >= percent * len(p | q) for p in sets[a] for q in sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: root(i) for i in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 9, 40, 120]))]
        for _ in range(rng.randrange(1, 25)):
            rows.append((i := i + 7, " ".join(edited(rng, words, rng.randrange(0, 1 + len(words) // 14)))))
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        chain = edited(rng, chain, 1)
        rows.append((i := i + 7, " ".join(chain)))
    rows += [(1, None), (2, ""), (3, " \n "), (4, "One Word"), (5, "one word"), (6, "one  WORD"), (6, "one  WORD")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, "k", 1) for a, b in rows], "doc_id long, text string, key string, component long")
    got = near_duplicates(df, size=4).collect()
    want = brute(rows, 4, 80)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_large_group_with_outsiders(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    rows = [(k, " ".join(edited(rng, base, rng.randrange(0, 5)))) for k in range(1, 160)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 4, 80)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (9, "a b c d e")], "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert got[None].component_id is None and got[None].kept and got[9].component_id == 9 and got[9].kept
    assert near_duplicates(df.limit(0)).collect() == []
