"""The matcher against plain edit distances; quotation; the defined cases."""

import random

from mnemoflow.llm.toxicity import edits, Matcher, features, fit, score_toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
    return row[-1]


def test_fuzzy_is_edit_distance_one():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 8))) for _ in range(30)]
    match = Matcher(terms, [])
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(4, 9)))
        assert match.fuzzy(w) == any(len(t) >= 5 and distance(w, t) <= 1 for t in terms), w


def test_two_edits_of_long_terms():
    rng = random.Random(2)
    terms = ["".join(rng.choice("abcd") for _ in range(rng.randrange(3, 14))) for _ in range(40)]
    match = Matcher(terms, [])
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", *"abcd"])
        w = "".join(w)
        if len(w) >= 4:
            assert match.fuzzy(w) == any(distance(w, t) <= edits(t) for t in terms if edits(t)), w


def test_no_word_is_too_long_or_too_parted():
    match = Matcher(["idiotic", "nincompoopery"], ["scum"])
    assert features("i.d.i.o.t.i.c", match)[0] == features("i.d.i.o.t.i.c.", match)[0] == 1
    assert features("you/are/all/so/very/much/of/an/idiotic/lot", match)[0] == 1
    assert features("scum" + "x" * 40, match)[1] == 1
    assert features("x" * 500_000 + "idiotic" + "y" * 500_000 + "nincompoopery", match)[0] == 2
    assert features("nimcompoupery", match)[2] == 1 and features("nimconpoupery", match) == [0] * 6


def test_labels_of_both_kinds_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "plain words" if i % 2 else "plain vermin", 1.0, "a") for i in range(60)], "doc_id long, text string, score double, y string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(0, 0), (0, 1)], "doc_id long, toxic int")
    models = [fit(docs, labels.repartition(n)) for n in (1, 3)]
    assert models[0][0] == models[1][0] == ["vermin"] and (models[0][2] == models[1][2]).all()


def test_context():
    match = Matcher(["idiotic"], ["scum"])
    assert features("you idiotic scumbag, idiotlc!", match) == [1, 1, 1, 0, 0, 0]
    assert features('they said "idiotic" there', match) == [0, 0, 0, 1, 0, 0]
    assert features(None, match) == features("", match) == [0] * 6


def test_learns_and_scores(spark):
    rng = random.Random(4)
    clean = [" ".join(f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30)) for _ in range(300)]
    rows = [(i, t + " vermin" if i % 5 == 0 else t, int(i % 5 == 0)) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (1002, "such vermln here", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in score_toxicity(docs, fit(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    assert got[1000] == got[1001] < 0.5 and len(got) == 303
    none = fit(docs, labels.limit(0))
    assert abs(score_toxicity(docs, none).first().score - 0.1) < 1e-9
    assert score_toxicity(docs.limit(0), none).collect() == []
