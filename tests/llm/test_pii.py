"""What the field adds to the patterns, on sequences of the kinds of its table but drawn anew; the defined cases."""

import numpy as np

from mnemoflow.llm import pii


def test_the_field_finds_what_the_patterns_miss():
    rng = np.random.default_rng(77)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(4, 9)))
    hidden = [lambda: ("email", f"{name()} (at) {name()} (dot) com"), lambda: ("email", f"{name()} [at] {name()}.org"), lambda: ("phone", f"({digits(3)}) {digits(3)}-{digits(4)}"), lambda: ("phone", f"{digits(3)}-{digits(3)}-{digits(4)}")]
    plain = [lambda: f"in {rng.integers(1900, 2100)}", lambda: f"version {digits(1)}.{digits(1)}", lambda: f"{digits(2)}:{digits(2)}", lambda: "$" + digits(3), lambda: "@" + name()]
    texts, want = [], []
    for i in range(400):
        left, right = " ".join(name() for _ in range(6)), " ".join(name() for _ in range(6))
        kind, part = hidden[i % 4]() if i % 2 else (None, plain[i % 5]())
        texts.append(f"{left} {part} {right}")
        want.append({(kind, len(left) + 1, len(left) + 1 + len(part))} if kind else set())
    emit, trans = pii.train()
    found = pii.find_all(texts, pii.Shapes(), emit, trans)
    assert not any(base for base, _ in found)
    got = [set(more) for _, more in found]
    right = sum(len(g & w) for g, w in zip(got, want, strict=True))
    assert right >= 0.9 * sum(map(len, want)), (right, sum(map(len, want)))
    assert right >= 0.9 * sum(map(len, got)), (right, sum(map(len, got)))


def test_empty_tables_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a@b.de", "x"), (1, "a@b.de", "x"), (None, "1.2.3.4", "x")], "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, r.base, r.spans) for r in pii.find_personal_data(docs).collect())
    assert got == [(0, "ip:0:7", "ip:0:7"), (1, "email:0:6", "email:0:6"), (1, "email:0:6", "email:0:6")]
    assert pii.find_personal_data(docs.limit(0)).collect() == []
