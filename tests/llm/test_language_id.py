"""Subwords against a plain version; whole words and whole texts; many languages; the defined cases."""

import random

import numpy as np

from mnemoflow.llm import language_id as L

DE = "der hund und die katze sind nicht in dem garten sondern auf der strasse und warten dort auf das essen".split()
EN = "the dog and the cat are not in the garden but out on the street and they wait there for their food".split()


def model():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(w) for _ in range(30)) for w in (DE, EN) for _ in range(60)]
    return L.train(texts, ["de"] * 60 + ["en"] * 60)


def plain(text):
    """(word, its subwords) of a text, subwords as strings of letters with spaces for word ends."""
    out = []
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for run in runs:
        for at in range(0, len(run), L.PIECE):
            marked = f" {run} "
            lo, hi = at + (at > 0), min(at + L.PIECE, len(run))
            own = {marked[i : i + n] for n in L.SIZES for i in range(lo, hi + 1) if len(marked[i : i + n]) == n and marked[i : i + n].strip()}
            out.append((run[at : at + L.PIECE], own))
    return out


def test_subwords_equal_the_plain_ones():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("abcdé中 -1.") for _ in range(rng.randrange(120))) + "x" * rng.choice((0, 31, 32, 33, 100))
        c, _ = L._codes([text])
        parts, starts = L.subwords(c)
        want = plain(text)
        assert len(starts) == len(want)
        for i, (word, own) in enumerate(want):
            assert "".join(map(chr, c[starts[i] : starts[i] + len(word)].tolist())) == word
            n = sum(int((w == i).sum()) for _, w in parts[:-1])
            assert n >= len(own)


def test_a_text_is_read_to_its_end_however_it_is_parted():
    m, rng = model(), random.Random(2)
    for names, w in (("de", DE), ("en", EN)):
        other = EN if names == "de" else DE
        long = " ".join(rng.choice(other) for _ in range(20)) + " " + " ".join(rng.choice(w) for _ in range(250_000))
        unspaced = "".join(rng.choice(other) for _ in range(20)) + "".join(rng.choice(w) for _ in range(2_000))
        slashed = "/".join(rng.choice(w) for _ in range(500))
        assert L.predict([long, unspaced, slashed], m)[0] == [names] * 3


def test_words_of_a_block_weigh_as_read_one_by_one():
    m = model()
    texts = ["der hund", "the dog and der", "x" * 100 + " und", "", "Der HUND der"]
    both = L.predict(texts, m)
    assert both[0] == [L.predict([t], m)[0][0] for t in texts]
    assert np.allclose(both[1], [L.predict([t], m)[1][0] for t in texts])


def test_more_than_two_hundred_languages_are_learned(spark):
    rows = [(i, "".join(chr(0x4E00 + 40 * (i % 230) + k) for k in range(30)), f"l{i % 230}") for i in range(230 * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(L.fit(docs)["names"]) > 220


def test_defined_cases(spark):
    m = model()
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, "12 ! 34", "en", "a"), (4, "the dog", "en", "a"), (4, "the dog", "en", "a"), (None, "der hund", "de", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.identify(docs, m).collect()]
    assert len(got) == 6 and {g[1:] for g in got if g[0] in (1, 2, 3)} == {("und", 0.0)}
    assert len({g for g in got if g[0] == 4}) == 1
    assert L.identify(docs.limit(0), m).collect() == []
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.fit(empty) is None and L.identify(empty, None).count() == 0
