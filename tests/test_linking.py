"""Concepts, hubs, anchors and the deterministic embedding against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mnemoflow.functions import scalars as S
from mnemoflow.operators import concepts as K
from mnemoflow.operators import entities as E
from mnemoflow.operators import memory as M


def embedding(text, dims):
    wrap = lambda x: (x + 2**31) % 2**32 - 2**31
    units, h, out = text.encode("utf-16-be", "surrogatepass"), 0, []
    for a, b in zip(units[::2], units[1::2], strict=True):
        h = wrap(h * 31 + a * 256 + b)
    for _ in range(dims):
        h = wrap(h * 1664525 + 1013904223)
        out.append((h & 0x7FFFFFFF) / 0x7FFFFFFF)
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm if norm else x for x in out]


def test_embedding_wraps_as_32_bits_do(spark):
    texts = ["", "a", "héllo", "日本語", "😀 x 𝒳", "word " * 500, "\x00"]
    got = [r["v"] for r in spark.createDataFrame(list(enumerate([*texts, None])), "i int, s string").select("i", S.hash_embedding(F.col("s"), 20).alias("v")).orderBy("i").collect()]
    assert got[-1] is None
    for text, v in zip(texts, got[:-1], strict=True):
        assert v == pytest.approx(embedding(text, 20), abs=1e-12)


def merged(found, known, least=0.4, most=20):
    """The greedy merge, one concept after the other: (name, lower-cased aliases)."""
    low = [k.lower() for n, a in known for k in (n, *a)]
    kept = []
    for n, r, a in sorted([x for x in found if x[1] >= least], key=lambda x: -x[1])[:most]:
        own = [x.lower() for x in (n, *a)]
        if any(x in low for x in own):
            continue
        to = next((k for x in own for k in kept if x in k["own"]), None)
        if to:
            to["aliases"] = {*to["aliases"], *own[1:], own[0]} - {to["name"].lower()}
        else:
            kept.append({"name": n, "own": set(own), "aliases": set(own[1:])})
    return sorted((k["name"], sorted(k["aliases"])) for k in kept)


def test_concepts_of_the_verdict(spark):
    found = spark.createDataFrame([(1, 0, "A", 0.9, ["x"]), (1, 1, "B", 0.8, ["X"]), (1, 2, "C", 0.7, ["Known"]), (1, 3, "D", 0.6, ["other name"])], "conv_id long, place int, name string, relevance double, aliases array<string>")
    known = spark.createDataFrame([("known", ["Other Name"])], "name string, aliases array<string>")
    assert [(r["name"], r["aliases"]) for r in K.extract_concepts(found, known).collect()] == [("A", ["x", "B"])]


def test_concepts_equal_a_loop(spark):
    rng = random.Random(3)
    pool = ["a", "B", "c", "D", "e", "F", "g", "H", "i", "J", "k", "L", "m", "N"]
    answers = {c: [(rng.choice(pool), rng.choice((0.2, 0.5, 0.5, 0.8, 1.0)), [rng.choice(pool).swapcase() for _ in range(rng.randrange(3))]) for _ in range(rng.randrange(30))] for c in range(25)}
    known = [("Q", ["a"]), ("M", [])]
    rows = [(c, p, *x) for c, found in answers.items() for p, x in enumerate(found)]
    out = K.extract_concepts(spark.createDataFrame(rows, "conv_id long, place int, name string, relevance double, aliases array<string>"), spark.createDataFrame(known, "name string, aliases array<string>")).collect()
    for c, found in answers.items():
        assert sorted((r["name"], sorted({a.lower() for a in r["aliases"]})) for r in out if r["conv_id"] == c) == merged(found, known)


def test_concepts_are_updated_in_place(spark):
    schema = "id long, name string, relevance double, aliases array<string>, sources array<long>, metadata map<string,string>"
    concepts = spark.createDataFrame([(1, "A", 0.5, ["x"], [7], {"k": "old", "l": "1"}), (2, "B", 0.5, [], [7], None)], schema)
    updates = spark.createDataFrame([(1, None, ["y", "x"], 7, {"k": "new"}), (2, 0.9, None, 8, {"m": "2"}), (3, 1.0, [], 1, {})], "id long, relevance double, aliases array<string>, source long, metadata map<string,string>")
    got = {r["id"]: (r["relevance"], r["aliases"], r["sources"], r["metadata"]) for r in K.update_concepts(concepts, updates).collect()}
    assert got == {1: (0.5, ["x", "y"], [7], {"l": "1", "k": "new"}), 2: (0.9, [], [7, 8], {"m": "2"})}


def test_anchors_of_one_label_are_one(spark):
    decided = spark.createDataFrame([(1, ([], [("N", None), ("n", 0.9), ("Old", None)])), (2, ([("5", 0.4)], [("n", None)]))], "fact_id long, decision struct<connect:array<struct<anchor_id:string,weight:double>>,create:array<struct<label:string,weight:double>>>")
    rows = M.link_anchors(decided, spark.createDataFrame([(9, "OLD"), (8, "old")], "id long, label string")).collect()
    assert sorted((r["fact_id"], r["weight"], r["is_new"]) for r in rows) == [(1, 0.5, False), (1, 0.5, True), (1, 0.9, False), (2, 0.4, False), (2, 0.5, False)]
    assert len({r["anchor_id"] for r in rows if r["label"] and r["label"].lower() == "n"}) == 1
    assert {r["anchor_id"] for r in rows if r["label"] == "Old"} == {8}


@pytest.mark.parametrize("label_first", [True, False])
def test_hubs_by_label_and_vector(spark, label_first):
    hubs = spark.createDataFrame([(1, "Alpha", [1.0, 0.0]), (2, "alpha", [0.0, 1.0]), (3, "Beta", [0.6, 0.8]), (4, "none", None)], "id long, label string, embedding array<double>")
    entities = spark.createDataFrame([(" ALPHA ", [0.0, 1.0]), ("near beta", [0.61, 0.79]), ("none", None), ("far", [-1.0, 0.0]), ("", [1.0, 0.0])], "entity string, embedding array<double>")
    got = {r["entity"]: (r["hub_id"], r["resolution"]) for r in E.resolve_hubs(entities, hubs, label_first=label_first).collect()}
    assert got.pop("far")[1] == "new-hub"
    assert got == {"alpha": (1, "exact-match") if label_first else (2, "cosine-match"), "near beta": (3, "cosine-match"), "none": (4, "exact-match")}
