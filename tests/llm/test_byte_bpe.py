"""Both forms against the tiktoken library, on awkward texts."""

import hashlib
import random

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from mnemoflow.llm import byte_bpe
from mnemoflow.llm.byte_bpe import Words, decode, encode, merge, read_ranks, transcode

PATH = P.path("byte_bpe_50k.tiktoken")


def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(7)
    letters = "ab \n\t'sé中٣½ 　!—ßİ1\U0001f600‍\x1c\x85"
    return [None, "", "x", " ", "aaaa" * 300, "don't 'll", *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(400)), "the same", "the same"]


def test_merge_of_long_words():
    quick, rng = library(), random.Random(2)
    for n in (1, 2, 24, 25, 60, 3000):
        for _ in range(20):
            word = "".join(rng.choice("abthenio") for _ in range(n))
            assert merge(word.encode(), read_ranks(PATH)) == quick.encode_ordinary(word)


def test_forms_match_the_library(spark):
    quick = library()
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    one = {r.doc_id: r for r in transcode(df, PATH, P.PATTERN).collect()}
    two = {r.doc_id: r for r in encode(df, PATH, P.PATTERN).withColumn("decoded", decode(F.col("ids"), PATH)).collect()}
    for i, t in rows:
        ids = quick.encode_ordinary(t or "")
        assert one[i].ids == ids and one[i].n_tokens == len(ids), t
        assert two[i].ids == ids, t
        assert one[i].decoded == two[i].decoded == (t or "").encode()
        assert one[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert transcode(df.limit(0), PATH, P.PATTERN).collect() == []


def test_frequent_words_are_folded_once_while_rare_ones_pass(monkeypatch):
    folded = []
    monkeypatch.setattr(byte_bpe, "merge", lambda word, ranks: folded.append(word) or merge(word, ranks))
    known, quick = Words(read_ranks(PATH), most=10), library()
    for i in range(200):
        for word in ("frequent", f"rare{i}"):
            assert known[word][0] == " ".join(map(str, quick.encode_ordinary(word))) and len(known) + len(known.older) <= 20
    assert folded.count(b"frequent") == 1
