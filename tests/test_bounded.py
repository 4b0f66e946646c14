"""Bounded graphs, updates in sequence, spans and contexts against plain loops."""

import datetime as dt
import random

import pytest

from mnemoflow.operators import context as X
from mnemoflow.operators import graph as G
from mnemoflow.operators import traces as T
from mnemoflow.operators import weights as W


def graph(seed, n=14, m=45):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)): rng.choice((0.05, 0.2, 0.5, 0.5, 0.9)) for _ in range(m)}.items())


def table(spark, edges):
    return spark.createDataFrame([(a, b, w) for (a, b), w in edges], "source_id long, target_id long, weight double")


def subgraph(edges, center, hops, most, least):
    visited, frontier, met = [center], [center], set()
    for _ in range(hops):
        if not frontier or len(visited) >= most:
            break
        following = []
        for node in frontier:
            if len(visited) >= most:
                break
            own = sorted((-w, b if a == node else a, a, b) for (a, b), w in edges if node in (a, b) and w >= least)
            for w, other, a, b in own:
                met.add((a, b, -w))
                if other not in visited:
                    visited.append(other)
                    following.append(other)
                    if len(visited) >= most:
                        break
        frontier = following
    return visited, sorted(e for e in met if e[0] in visited and e[1] in visited)


@pytest.mark.parametrize("seed", range(4))
def test_subgraphs_with_a_budget(spark, seed):
    edges = graph(seed)
    for hops, most, least in ((1, 4, 0), (2, 3, 0.1), (2, 9, 0), (3, 50, 0.3), (2, 1, 0)):
        nodes, found = G.bounded_subgraph(table(spark, edges), 3, hops, most, least)
        want = subgraph(edges, 3, hops, most, least)
        assert [r["id"] for r in nodes.orderBy("place").collect()] == want[0]
        assert sorted(tuple(r) for r in found.collect()) == want[1]


def reached(edges, seeds, leaves, hops, most, least):
    visited, scores, queue = {s for s, _ in seeds}, {}, [(s, 0, w, s) for s, w in seeds]
    while queue and len(scores) < most:
        node, depth, weight, source = queue.pop(0)
        if depth >= hops:
            continue
        for w, other in sorted((-w, b) for (a, b), w in edges if a == node and w >= least):
            score = weight * -w
            if other in scores and scores[other][0] >= score:
                continue
            if other in leaves:
                scores[other] = (score, depth + 1, source)
            if other not in visited and depth + 1 < hops:
                visited.add(other)
                queue.append((other, depth + 1, score, source))
    return {i: (round(s, 9), d, f) for i, (s, d, f) in scores.items()}


@pytest.mark.parametrize("seed", range(4))
def test_traversals_with_a_budget(spark, seed):
    edges, leaves = graph(seed, 16, 60), [i for i in range(16) if i % 3]
    ids = spark.createDataFrame([(i,) for i in leaves], "id long")
    for hops, most in ((1, 2), (2, 4), (2, 100), (2, 7)):
        seeds = [(2, 1.0), (5, 0.8)]
        got = G.traverse_bounded(table(spark, edges), spark.createDataFrame(seeds, "id long, score double"), ids, hops, 0.1, most).collect()
        assert {r["id"]: (round(r["score"], 9), r["depth"], r["source"]) for r in got} == reached(edges, seeds, leaves, hops, most, 0.1)


@pytest.mark.parametrize(("strategy", "step"), [("replace", lambda x, y: y), ("max", max), ("average", lambda x, y: (x + y) / 2), ("hebbian", lambda x, y: x + y * (1 - x))])
def test_updates_follow_one_another(spark, strategy, step):
    rng = random.Random(4)
    edges = {(i, 0): rng.random() for i in range(6)}
    updates = [(rng.randrange(4, 10), 0, rng.random(), s) for s in range(60)] + [(30, 0, 0.5, s) for s in range(1500)]
    rng.shuffle(updates)
    want = dict(edges)
    for a, b, w, _ in sorted(updates, key=lambda u: u[3]):
        want[a, b] = step(want[a, b], w) if (a, b) in want else w
    got = W.merge_updates(table(spark, sorted(edges.items())), spark.createDataFrame(updates, "source_id long, target_id long, weight double, seq long"), strategy)
    assert {(r["source_id"], r["target_id"]): pytest.approx(r["weight"], abs=6e-5) for r in got.collect()} == want


def test_spans_are_those_of_a_collector(spark):
    rng, start = random.Random(6), dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(3), i, start + dt.timedelta(milliseconds=rng.randrange(400)), rng.choice("abc"), rng.choice(("start", "start", "complete", "error", "skipped")), rng.choice((None, "a", "b"))) for i in range(300)]
    got = {(r["start_id"], r["end_id"]): (r["state"], r["duration_ms"], r["parent_id"]) for r in T.pair_spans(spark.createDataFrame(rows, "trace_id long, event_id long, ts timestamp, stage string, status string, parent_stage string")).collect()}
    want, running, order = {}, {}, sorted(rows, key=lambda r: (r[0], r[2], r[1]))
    parent = lambda t, stage: running.get((t, stage), (None,))[0]
    for t, i, ts, stage, status, up in order:
        key = t, stage
        if status == "skipped":
            want[None, i] = ("skipped", None, parent(t, up))
        elif status == "start":
            if key in running:
                old = running[key]
                want[old[0], None] = ("replaced", None, old[2])
            running[key] = (i, ts, parent(t, up), up)
        elif key in running:
            old = running.pop(key)
            # The parent is the one that the ending event names, as it was where the span began.
            want[old[0], i] = (status, (ts - old[1]).total_seconds() * 1000, old[2] if up == old[3] else ...)
        else:
            want[None, i] = ("orphan", None, parent(t, up))
    want |= {(v[0], None): ("open", None, v[2]) for v in running.values()}
    assert got.keys() == want.keys()
    for k, (state, ms, up) in want.items():
        assert got[k][:2] == (state, None if ms is None else pytest.approx(ms, abs=0.01)) and up in (..., got[k][2]), k


ITEM = "id long, score double, content string, node_type string, node_role string, frontmatter string, summary string, depth string, category string, entities array<string>, via array<string>"
ITEMS = [
    (1, 0.9, "full <one>", "semantic", "leaf", "front & one", "sum one", "L2", 'c"t', ["E"], ["Anchor"]),
    (2, 0.8, "full two", "episodic", "hub", None, None, "L1", "cat", ["E", "F"], []),
    (3, 0.7, "full three", None, "leaf", "front three", "sum three", "L0", None, None, None),
    (4, 0.6, "  ", "semantic", "leaf", "f", "s", "L2", None, None, None), (5, 0.01, "low", "semantic", "leaf", "f", "s", "L2", None, None, None),
]


def test_contexts_of_each_form(spark):
    items, anchors = spark.createDataFrame(ITEMS, ITEM), spark.createDataFrame([("B<", 0.5), ("A", 0.75)], "label string, similarity double")
    xml = X.recall_context(items, anchors, least=0.1, scores=True).first()
    assert xml["text"] == "\n".join([
        "<memory_context>", f"<preamble>{X.RECALLED['xml']}</preamble>", "<activated_anchors>", '  <anchor label="A" similarity="0.750" />', '  <anchor label="B&lt;" similarity="0.500" />', "</activated_anchors>",
        "<semantic>", '  <knowledge depth="L2" score="0.900" category="c&quot;t">', "    <text>full &lt;one&gt;</text>", "    <via_anchors>Anchor</via_anchors>", "  </knowledge>", "</semantic>",
        "<hub>", '  <hub depth="L1" score="0.800" category="cat">full two (cat; entities: E, F)</hub>', "</hub>", "<other>", '  <memory depth="L0" score="0.700">front three</memory>', "</other>", "</memory_context>",
    ])
    assert (xml["n_items"], xml["truncated"], xml["detail"]) == (3, False, "full")
    markdown = X.recall_context(items, anchors, "markdown", least=0.1, threshold=5).first()
    assert markdown["detail"] == "frontmatter" and markdown["text"].split("\n")[4:8] == ["**Activated anchors:** A, B<", "", "### Semantic Knowledge", "- front & one _(L2 | via: Anchor)_"]
    assert X.recall_context(items, None, "plain", least=0.1, threshold=20).first()["text"].split("\n")[2:] == ["[1] (Semantic/L2) sum one (via: Anchor)", "[2] (Episodic/L1) full two (cat; entities: E, F)", "[3] (Other/L0) front three"]


def test_contexts_are_cut_with_their_closing(spark):
    items = spark.createDataFrame([(1, 1.0, "x" * 5000)], "id long, score double, content string")
    for style, end in (("xml", "\n</memory_context>"), ("markdown", "\n\n*[Memory context truncated]*"), ("plain", "x")):
        row = X.recall_context(items, None, style, detail="full").first()
        assert len(row["text"]) == 4000 and row["text"].endswith(end) and row["truncated"]
    assert tuple(X.recall_context(items.limit(0)).first()) == ("", 0, False, "full")


def test_contexts_of_merged_items(spark):
    items = spark.createDataFrame(ITEMS[:3], ITEM)
    xml = X.node_context(items, metadata=True).first()["text"].split("\n")
    assert xml[3:9] == ['  <knowledge depth="L2">', "    <text>sum one</text>", "    <metadata>", "      <entities>E</entities>", '      <category>c&quot;t</category>', "    </metadata>"]
    assert X.node_context(items, "markdown", scores=True).first()["text"].split("\n")[4:8] == ["### Semantic Knowledge", "- sum one (score: 0.900) `L2`", "", "### Key Concepts (Hubs)"]
    assert X.node_context(items, "json").first()["text"] == '{"memoryContext":{"semantic":[{"content":"sum one","depthLevel":"L2","nodeType":"semantic","frontmatter":"front & one","summary":"sum one"}],"hub":[{"content":"full two — cat; entities: E, F","depthLevel":"L1","nodeType":"episodic"}],"other":[{"content":"front three","depthLevel":"L0","frontmatter":"front three"}]}}'
