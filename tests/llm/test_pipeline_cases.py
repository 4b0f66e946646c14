"""Each stage of the pipeline against a brute-force version on one table with nulls, empty and long texts, repeats and clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemoflow.llm import pii, toxicity
from mnemoflow.llm.common import table
from tests.llm.test_near_dedup import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(11)
    say = lambda n, k: " ".join(f"{k}{rng.randrange(900)}" for _ in range(n))
    base, shared = say(60, "a"), say(50, "s")
    texts = [None, "", " \n", base, base, base + " end", say(80, "b"), say(30, "c") + " " + shared + " " + say(30, "d"), shared + " " + say(25, "e"), say(40_000, "f"), "mail x.y@z.org or +49 170 1234567 " + say(20, "g")]
    return [(i, t, None if i % 3 else "en", "src", None if t is None else len(t)) for i, t in enumerate(texts)] + [(4, base, "en", "src", 1), (None, say(12, "h"), "en", "src", 1)]


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id long, text string, lang string, source string, n_chars long, component_id string, n int")


def test_near_duplicates_stage(spark, sf_dir_llm):
    data = rows()
    out = corpus_pipeline.drop_near_duplicates(spark, frame(spark, data), sf_dir_llm)
    root = brute([r[:2] for r in data if r[0] is not None], 5, 80)
    want = [r[0] for r in data if r[0] is None or root[r[0]] == r[0]]
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, want)) and tuple(out.columns) == corpus_pipeline.COLUMNS


def test_repeats_stage(spark, sf_dir_llm):
    data = rows()
    got = sorted((str(r.doc_id), r.text or "") for r in corpus_pipeline.cut_repeats(spark, frame(spark, data), sf_dir_llm).collect())
    each = [WORD.findall(r[1] or "") for r in data]
    count = {}
    for w in each:
        for a in range(len(w) - 34):
            count[tuple(w[a : a + 35])] = count.get(tuple(w[a : a + 35]), 0) + 1
    want = []
    for r, w in zip(data, each, strict=True):
        gone = {j for a in range(len(w) - 34) if count[tuple(w[a : a + 35])] > 1 for j in range(a, a + 35)}
        want.append((str(r[0]), " ".join(x for j, x in enumerate(w) if j not in gone) if gone else r[1] or ""))
    assert got == sorted(want)


def test_personal_data_and_toxicity_stages(spark, sf_dir_llm):
    data = rows()
    emit, trans = pii.train()
    out = {str(r.doc_id): r for r in corpus_pipeline.redact(spark, frame(spark, data), sf_dir_llm).collect()}
    for i, t, *_ in data:
        base, more = pii.find_all([t or ""], pii.Shapes(), emit, trans)[0]
        assert (out[str(i)].text == t) == (not base + more)
    assert "<email>" in out["10"].text and "<phone>" in out["10"].text and out["10"].n_chars == len(out["10"].text)
    docs = frame(spark, data)
    model = toxicity.fit(docs, table(spark, sf_dir_llm, "labels"))
    match = toxicity.Matcher(model[0], model[1])
    want = [str(i) for i, t, *_ in data if toxicity._score(__import__("numpy").array([toxicity.features(t, match)]), model[2])[0] < 0.5]
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir_llm)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(want)


def test_every_stage_takes_an_empty_table(spark, sf_dir_llm):
    pytest.importorskip("public_tokenizers")
    empty = frame(spark, rows()).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir_llm).collect() == [], name


def test_packing_stage_holds_every_row(spark, sf_dir_llm):
    pytest.importorskip("public_tokenizers")
    data = rows()
    out = corpus_pipeline.pack(spark, frame(spark, data), sf_dir_llm)
    assert out.where("piece = 0").count() == len(data)
    over = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n > 2048 or n <> end")
    assert over.count() == 0
