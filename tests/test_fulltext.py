"""Postings against scanned texts and a plain BM25, accents, and the bounds of blocks."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from mnemoflow.functions import scalars as S
from mnemoflow.operators import fulltext as T


def plain(s):
    s = unicodedata.normalize("NFD", s.lower())
    return re.findall(r"[^\W_]+", "".join(c for c in s if not 0x300 <= ord(c) <= 0x36F))


def ranks(rows, terms, every=False, weights=T.COLUMN_WEIGHTS, first_in=None):
    tokens = {i: {c: plain(t or "") for c, t in zip(T.COLUMNS, texts, strict=True)} for i, *texts in rows}
    length = {i: sum(len(own[c]) for c in weights) for i, own in tokens.items()}
    mean = sum(length.values()) / len(rows)
    tf = {i: [sum(w * own[c].count(t) for c, w in weights.items() if k or first_in in (None, c)) for k, t in enumerate(terms)] for i, own in tokens.items()}
    out = {}
    for i, own in tf.items():
        if (all if every else any)(x > 0 for x in own):
            found = [sum(x[k] > 0 for x in tf.values()) for k in range(len(terms))]
            out[i] = -sum(T.idf(len(rows), n) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * length[i] / mean)) for n, x in zip(found, own, strict=True) if x)
    return out


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(9)
    words = ["café", "cafe", "café", "Ångström", "b", "c", "d", "éa", "Straße", "日本", "x_y", "1a"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(i * 3, text(4), text(3) or None, text(30)) for i in range(300)] + [(9_999, "rare word", "cafe cafe cafe", ""), (-70, "rare", None, "b")]
    return rows, spark.createDataFrame([(*r, r[0] % 2) for r in rows], "id long, frontmatter string, keywords string, summary string, odd long")


@pytest.mark.parametrize("how", [{}, {"every": True}, {"weights": {"keywords": 10.0}}, {"first_in": "keywords"}])
def test_postings_and_scans_equal_the_plain_formula(nodes, how):
    rows, table = nodes
    index, scan = T.Postings.build(table, 3), T.Scan(table)
    for terms in (["cafe", "d"], ["rare"], ["nowhere"], ["angstrom", "ea", "日本"]):
        want = ranks(rows, terms, **how)
        for text in (index, scan):
            got = {r["id"]: r["rank"] for r in text.hits(terms, **how).collect()}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-6 for i in got)
        for k in (2, 7, 40):
            assert [r["id"] for r in index.best(terms, k, **how).collect()] == [r["id"] for r in scan.best(terms, k, **how).collect()]
        kept = sorted(r["id"] for r in index.best(terms, 400, keep=F.col("odd") == 1, **how).collect())
        assert kept == sorted(i for i in want if i % 2 == 1)


def test_no_document_beats_the_bound_of_its_block(nodes):
    rows, table = nodes
    index = T.Postings.build(table, 2)
    q = T.Query(["cafe", "b"])
    mean, found, _ = index._statistics(q)
    bounds = {r["block"]: r["bound"] for r in index.bounds(q, mean, found).collect()}
    want = ranks(rows, q.terms)
    assert want and all(-rank <= bounds[math.floor(i / T.BLOCK)] + 1e-9 for i, rank in want.items())


def test_an_empty_table_has_no_hits(spark):
    table = spark.createDataFrame([], "id long, frontmatter string, keywords string, summary string")
    for text in (T.Postings.build(table), T.Scan(table)):
        assert text.best(["a"], 5).count() == 0


def test_accents_part_no_tokens_and_other_scripts_stay(spark):
    rows = [(0, "Crème BRÛLÉE Ệ ộ ﬁ"), (1, "éáb й ё ά 각 ñ"), (2, None), (3, "ÀÉ-ô'ü"), (4, "İstanbul ø ß")]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, s string").select("i", S.fts_tokens(F.col("s")).alias("t")).collect()}
    assert got[0] == ["creme", "brulee", "e", "o", "ﬁ"] and got[1] == ["eab", "й", "ё", "ά", "각", "n"] and got[2] is None and got[3] == ["ae", "o", "u"]
    assert got[4] == ["istanbul", "ø", "ß"]


def test_match_expressions(spark):
    rows = [(0, ' Foo "bar" -- baz '), (1, "--- !"), (2, ""), (3, None)]
    got = [r["m"] for r in spark.createDataFrame(rows, "i int, s string").select("i", S.match_expression(F.col("s")).alias("m")).orderBy("i").collect()]
    assert got == ['"foo" OR """bar""" OR "baz"', None, None, None]


def test_parts_grow_with_the_tokens_and_a_term_of_every_row_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(T, "PART", 500)
    monkeypatch.setattr(T, "RANGE", 2)
    rows = [(i, f"the n{i % 7}", "en", f"the The text {i} thé en") for i in range(1500)]
    table = spark.createDataFrame(rows, "id long, frontmatter string, keywords string, summary string").repartition(8)
    index = T.Postings.build(table)
    files = index.postings.select("term", F.input_file_name().alias("file"))
    # 9 tokens a row in parts of 500: 27 parts at least.
    assert index.postings.where("term = 'the'").count() == 24 and files.where("term = 'the'").select("file").distinct().count() > 6
    docs = index.postings.where("term = 'the'").select(F.inline("docs")).where("id = 3").collect()
    assert [(d.tf_frontmatter, d.tf_keywords, d.tf_summary, d.len_frontmatter, d.len_keywords, d.len_summary) for d in docs] == [(1, 0, 3, 2, 1, 6)]
