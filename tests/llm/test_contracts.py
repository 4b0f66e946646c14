"""Queries of the operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoflow.llm import language_id, packing, pii, substring_dedup, topk, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n)]


def documents(spark, texts):
    """texts as documents, with columns that clash with names used inside."""
    rows = [(i, t, "en", "s", 0, "part", "bucket", 7) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part string, bucket string, shard int")


# 1
def test_warc_round_trip_over_small_splits(spark, tmp_path):
    big = "<html>" + "x" * 2000
    pages = spark.createDataFrame([(1, "u 1", big), (2, None, big), (5, "v", "x" * 999), (6, "v", "x" * 999), (7, "w", None), (8, "w", ""), (9, "é", "é\r\n\r\nWARC/1.0\r\n" * 300)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    assert warc.write_archives(warc.plan_revisits(pages), path) == 7
    for split in (64, 333, 1 << 20):
        back = {r["page_id"]: r for r in warc.read_archives(spark, path, split).collect()}
        assert sorted(back) == [1, 2, 5, 6, 7, 8, 9]
        assert (back[1]["record_type"], back[1]["refers_to"], back[2]["record_type"]) == ("revisit", 2, "response")
        assert bytes(back[9]["payload"]).decode() == "é\r\n\r\nWARC/1.0\r\n" * 300
        assert back[1]["digest"] == hashlib.sha1(big.encode()).hexdigest()


# 2
def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = random.Random(2)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(6)]) for i in range(400)] + [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [0.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table, table.where("vec_id % 100 = 0")).collect())
    fine = [(i, np.floor(1024 * np.float32(v).astype(float)).astype(int)) for i, v in rows if v and None not in v and np.isfinite(np.array(v)).all()]
    want = []
    for i, v in fine:
        if i % 100 == 0:
            best = sorted((-int(v @ u), j) for j, u in fine if j != i)[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


# 3
def test_packing_places_every_piece_once_and_without_gaps(spark):
    pytest.importorskip("public_tokenizers")
    texts = [(i, " ".join(words(n, i))) for i, n in enumerate([5, 900, 700, 30, 400, 1100, 2, 650, 3000])] + [(20, None), (21, ""), (21, ""), (22, "a <|endoftext|> b"), (None, "x")]
    rows = packing.pack_documents(documents(spark, texts)).collect()
    from tokenizers import Tokenizer

    import public_tokenizers as P

    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, t in texts:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for k, (s, n) in enumerate(packing.cuts(len(ids), 2048)):
            want.append((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_packing_of_an_empty_table(spark):
    pytest.importorskip("public_tokenizers")
    assert packing.pack_documents(documents(spark, [])).count() == 0


# 4
def test_substring_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 400)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 500)
    shared, other = words(40, 100), words(36, 101)
    texts = [(1, " ".join(words(50, 1) + shared + words(9, 2))), (2, " ".join(shared)), (3, "\t".join(words(20, 3) + other) + "\n"), (4, " ".join(other + ["z"] + other)), (5, None), (6, ""), (7, "a " * 100), (8, " ".join(words(34, 4))), (9, " ".join(words(60, 9))), (9, " ".join(words(60, 9))), (None, "b")]
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(documents(spark, texts)).collect())
    each = [WORD.findall(t or "") for _, t in texts]
    count = {}
    for w in each:
        for a in range(len(w) - 34):
            count[tuple(w[a : a + 35])] = count.get(tuple(w[a : a + 35]), 0) + 1
    want = []
    for (i, _), w in zip(texts, each, strict=True):
        gone = {j for a in range(len(w) - 34) if count[tuple(w[a : a + 35])] > 1 for j in range(a, a + 35)}
        want.append((i or 0, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert got == sorted(want)


# 5
def test_language_id_on_held_out_documents(spark, sf_dir_llm):
    from mnemoflow.llm.common import table

    out = language_id.op5_language_id(spark, sf_dir_llm).join(table(spark, sf_dir_llm, "documents").select("doc_id", "lang", F.length("text").alias("n")), "doc_id")
    right, n = out.where("held_out and lang is not null").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 50 and right >= 0.9 * n


def test_language_id_without_letters_or_labels(spark):
    docs = documents(spark, [(1, None), (2, "12 34 !"), (3, "some words here")])
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    model = language_id.train(["der die das und", "the and of to"] * 20, ["de", "en"] * 20)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert got[1] == got[2] == "und" and got[3] in ("de", "en")


# 6
def test_toxicity_on_held_out_documents(spark, sf_dir_llm):
    from mnemoflow.llm.common import table

    out = toxicity.op6_toxicity(spark, sf_dir_llm).join(table(spark, sf_dir_llm, "labels"), "doc_id").where("held_out")
    right, n = out.agg(F.sum((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert n > 20 and right >= 0.95 * n


# 8
def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(8)
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "999.1.1.1", "1.2.3.4.5", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49", "12345678901234567890123", " ", "é", ".", "-", "%+x@a.b.", "5", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        want = [(k, *m.span()) for k, p in pii.PATTERNS.items() for m in p.finditer(text) if pii.valid(k, m.group())]
        assert pii.base_spans(text) == want, text


def test_pii_of_null_and_long_texts(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "write to a.b@c.de or bob [at] mail.org, 1.2.3.4"), (4, "9" * 200_000), (5, "a" * 200_000 + "@")])
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert got[1]["spans"] == got[2]["spans"] == got[4]["base"] == got[5]["base"] == ""
    assert got[3]["base"] == "email:9:17,ip:40:47"
    assert set(got[3]["base"].split(",")) <= set(got[3]["spans"].split(","))
