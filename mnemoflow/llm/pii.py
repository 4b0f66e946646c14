r"""Personal data: base patterns plus a linear-chain conditional random field over word shapes.

Base spans are those of four patterns (fixed values below), leftmost and non-overlapping per kind, with their checks. The
field labels the words of segments around triggers (a digit, an @, or a word such as `at` in an address spelled out): its
features are the shapes of a word and its neighbours, hashed into a small table; it is trained here on the labelled table
that `labelled()` builds from templates, by stochastic gradient steps on the exact log-likelihood, and decoded by Viterbi
over batches of segments of one length in numpy. A run of words with one label becomes a span when it passes the plausibility check of
its kind and overlaps no base span; base spans always stay.

Defined cases: null and empty texts have no spans; offsets are code points, end exclusive; repeated rows get the same
spans; a null doc_id is kept as such; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_FAST = {"email": re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?"), "ip": re.compile(r"[0-9]++(\.[0-9]+\.[0-9]+\.[0-9]+)?")}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]", re.I)
_DIGIT = re.compile(r"[0-9]")
TABLE, REACH = 1 << 12, 3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "email":
        return True
    digits = "".join(_DIGIT.findall(s))
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of PATTERNS that are valid. Of email and ip, whose first part is a run that no later start inside it can
    change, each run is taken once (_FAST), so that a long run costs its length and not the square of it."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += (("email", *m.span()) for m in _FAST["email"].finditer(text) if m[1])
    if _DIGIT.search(text):
        out += (("ip", *m.span()) for m in _FAST["ip"].finditer(text) if m[1] and valid("ip", m.group()))
        for kind in ("card", "phone"):
            out += ((kind, *m.span()) for m in PATTERNS[kind].finditer(text) if valid(kind, m.group()))
    return out


def shape(word: str) -> str:
    """Letters to a or A, digits to 9, runs of three or more of one class to a class and `+`; at most 16 characters."""
    s = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", word[:40])))
    s = re.sub(r"[^\x00-\x7f]", "u", s)
    return re.sub(r"(.)\1{2,}", r"\1+", s)[:16]


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) % TABLE


class Shapes(dict):
    """Rows of the feature table by word: its shape, length class, last characters and lower-cased cue words."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        n = sum(c in "0123456789" for c in word)
        cue = word.lower().strip(".,:;()[]")
        value = self[word] = tuple(_hash(x) for x in (f"s{shape(word)}", f"n{min(n, 20)}/{min(len(word), 24)}", f"c{cue if len(cue) < 8 and not n else ''}", f"p{word[:1] if not word[:1].isalnum() else ''}{'@' in word}{word.count('.')}{word.count('-')}"))
        return value


def _rows(seq: list[str], shapes: Shapes) -> np.ndarray:
    """Feature rows (words x 12): a word's own, its predecessor's and its successor's, each from a table part of its own."""
    own = np.array([shapes[w] for w in seq])
    edge = np.array([[_hash("edge")] * 4])
    return np.c_[own, np.r_[edge, own[:-1]] + TABLE, np.r_[own[1:], edge] + 2 * TABLE]


def labelled() -> list[tuple[list[str], list[int]]]:
    """The labelled table: word sequences and their labels (0 none, then KINDS), made from templates with a fixed seed."""
    rng = np.random.default_rng(8)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 10)))

    def card():
        d = digits(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def positive():
        c = card()
        ip = ".".join(str(x) for x in rng.integers(1, 256, 4))
        return [
            (1, [f"{name()}.{digits(2)}@{name()}.{name()}.com"]), (1, [name(), "(at)", name(), "(dot)", "com"]), (1, [name(), "[at]", f"{name()}.org"]),
            (2, [ip]), (2, [f"{ip}:{digits(4)}"]), (3, [c]), (3, [c[:4], c[4:8], c[8:12], c[12:]]), (3, [f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}"]),
            (4, ["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"]), (4, [f"({digits(3)})", f"{digits(3)}-{digits(4)}"]), (4, [f"{digits(3)}-{digits(3)}-{digits(4)}"]), (4, ["+" + digits(2), digits(3), digits(3), digits(4)]),
        ]

    def negative():
        return [["2." + digits(1)], ["Version", "2.0."], ["in", str(rng.integers(1900, 2100))], [digits(rng.integers(1, 6))], [f"{digits(2)}:{digits(2)}"], [f"20{digits(2)}-0{1 + rng.integers(9)}-{10 + rng.integers(18)}"], ["$" + digits(3)], ["".join(rng.choice(list("0123456789abcdef"), 32))], [f"{digits(3)}.{digits(2)}"], ["key=" + "".join(rng.choice(list("0123456789abcdefABCDEF"), 20))], ["@" + name()], [digits(12)]]

    out = []
    for _ in range(40):
        for label, seq in [*positive(), *((0, s) for s in negative())]:
            left, right = [name() for _ in range(rng.integers(0, 4))], [name() for _ in range(rng.integers(0, 4))]
            if rng.random() < 0.3 and right:
                seq = [*seq[:-1], seq[-1] + rng.choice([".", ","])]
            out.append(([*left, *seq, *right], [0] * len(left) + [label] * len(seq) + [0] * len(right)))
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


@cache
def train(epochs: int = 8, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """(emission table, transitions) by stochastic gradient ascent on the log-likelihood of labelled()."""
    k, shapes, rng = len(KINDS) + 1, Shapes(), np.random.default_rng(80)
    emit, trans = np.zeros((3 * TABLE, k)), np.zeros((k, k))
    data = [(_rows(s, shapes), np.array(y)) for s, y in labelled()]
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        for i in rng.permutation(len(data)):
            rows, y = data[i]
            e = emit[rows].sum(1)
            n = len(y)
            f, b = np.empty_like(e), np.zeros_like(e)
            f[0] = e[0]
            for t in range(1, n):
                f[t] = e[t] + _lse(f[t - 1][:, None] + trans, 0)
            for t in range(n - 2, -1, -1):
                b[t] = _lse(trans + (e[t + 1] + b[t + 1])[None, :], 1)
            z = _lse(f[-1], 0)
            grad = -np.exp(f + b - z)
            grad[np.arange(n), y] += 1
            pair = np.zeros((k, k))
            for t in range(1, n):
                pair -= np.exp(f[t - 1][:, None] + trans + (e[t] + b[t])[None, :] - z)
                pair[y[t - 1], y[t]] += 1
            np.add.at(emit, rows.ravel(), np.repeat(step * grad, rows.shape[1], 0))
            trans += step * pair
    return emit, trans


def viterbi(emissions: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label sequences of a batch of segments of one length: (batch, words, labels) to (batch, words)."""
    n, length, _ = emissions.shape
    score, back = emissions[:, 0], np.empty((n, length, trans.shape[0]), np.int8)
    for t in range(1, length):
        step = score[:, :, None] + trans[None]
        back[:, t] = step.argmax(1)
        score = step.max(1) + emissions[:, t]
    out = np.empty((n, length), np.int64)
    out[:, -1] = score.argmax(1)
    for t in range(length - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


def segments(text: str) -> list[list[tuple[str, int, int]]]:
    """Runs of words within REACH words of a trigger; the text between triggers is not cut into words."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() < out[-1][2]:
            continue
        left, right = _word_bounds(text, m.start())
        done = right
        for _ in range(REACH):
            left, right = _word_bounds(text, _skip(text, left - 1, -1))[0], _word_bounds(text, _skip(text, right, 1))[1]
        if out and left <= out[-1][1]:
            out[-1][1:] = [max(right, out[-1][1]), done]
        else:
            out.append([left, right, done])
    return [[(w.group(), *w.span()) for w in _WORD.finditer(text, a, b)] for a, b, _ in out]


_SPACE = frozenset(" \t\n\v\f\r")


def _skip(text: str, at: int, by: int) -> int:
    """The first position from `at` on that holds no white space, or the end of the text on that side."""
    while 0 <= at < len(text) and text[at] in _SPACE:
        at += by
    return min(max(at, 0), len(text))


def _word_bounds(text: str, at: int) -> tuple[int, int]:
    left = right = at
    while left > 0 and text[left - 1] not in _SPACE:
        left -= 1
    while right < len(text) and text[right] not in _SPACE:
        right += 1
    return left, right


def _plausible(kind: str, s: str) -> bool:
    digits = "".join(_DIGIT.findall(s))
    if kind == "email":
        return bool(re.search(r"@|[\[(]at[\])]", s, re.I)) and len(s) >= 6
    if kind == "ip":
        return bool(PATTERNS["ip"].fullmatch(s.split(":")[0])) and valid("ip", s.split(":")[0])
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and bool(re.search(r"[-() ]", s))


def find_all(texts: list[str], shapes: Shapes, emit: np.ndarray, trans: np.ndarray) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; segments of one length are decoded together."""
    base = [base_spans(t) for t in texts]
    by_length: dict[int, list[tuple[int, list]]] = {}
    for i, t in enumerate(texts):
        for s in segments(t) if _TRIGGER.search(t) else ():
            by_length.setdefault(len(s), []).append((i, s))
    added: list[list] = [[] for _ in texts]
    for length, group in by_length.items():
        for at in range(0, len(group), max(1, 20_000 // length)):
            part = group[at : at + max(1, 20_000 // length)]
            rows = np.stack([_rows([w for w, _, _ in s], shapes) for _, s in part])
            for (i, s), labels in zip(part, viterbi(sum(emit[rows[:, :, j]] for j in range(rows.shape[2])), trans), strict=True):
                j = 0
                while j < length:
                    k = j
                    while k + 1 < length and labels[k + 1] == labels[j]:
                        k += 1
                    if labels[j]:
                        kind, a, b = KINDS[labels[j] - 1], s[j][1], s[k][2]
                        while b > a and texts[i][b - 1] in ".,;:!?\"'":
                            b -= 1
                        if _plausible(kind, texts[i][a:b]) and not any(x < b and a < y for _, x, y in base[i]):
                            added[i].append((kind, a, b))
                    j = k + 1
    return list(zip(base, added, strict=True))


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row with base and spans (kind:start:end, comma-joined) and a redacted text."""
    emit, trans = train()
    base_df = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches):
        shapes = Shapes()
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            base, every, clean = [], [], []
            for t, (b, more) in zip(texts, find_all(texts, shapes, emit, trans), strict=True):
                base.append(_joined(b))
                every.append(_joined(b + more))
                out, end = [], 0
                for kind, x, y in sorted(b + more, key=lambda s: (s[1], -s[2])):
                    if x >= end:
                        out += [t[end:x], f"<{kind}>"]
                    end = max(end, y)
                clean.append("".join([*out, t[end:]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(base), pa.array(every), pa.array(clean)], [*keep, "base", "spans", "redacted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base_df.schema.fields[:-1])
    return base_df.mapInArrow(run, f"{kinds}, base string, spans string, redacted string")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents"))
    n = [F.regexp_count("base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *n, F.sha2("base", 256).alias("base_sha256"), "spans")
