"""Parsers of model answers over a table of raw texts with spoiled items, and what each must give."""

import pytest
from pyspark.sql import functions as F

from mnemoflow.operators import extract as X

FENCED = "Sure:\n```json\n%s\n```\nDone."


def show(v):
    """Rows and lists as plain values."""
    return {k: show(x) for k, x in v.asDict().items()} if hasattr(v, "asDict") else [show(x) for x in v] if isinstance(v, list) else v


def parsed(spark, parser, raws):
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    return [show(r["x"]) for r in rows.select("i", parser(F.col("raw")).alias("x")).orderBy("i").collect()]


def fact(content, category="other", confidence=0.5, entities=(), subject=None, predicate=None, object=None):  # noqa: A002
    return {"content": content, "category": category, "confidence": confidence, "entities": list(entities), "subject": subject, "predicate": predicate, "object": object}


def test_facts_beside_spoiled_items(spark):
    raws = [
        '[{"content":"a"},"str",{"content":"b"}]',
        '{"facts":[1,null,[{"content":"in a list"}],{"content":"a","confidence":"0.9","entities":"x"},true,{"content":7},{"content":" b ","category":" Technical ","confidence":9,"entities":["e",3,null," "," f "],"subject":["s"],"object":" o\\n"}]}',
        FENCED % '[{"content":"a","category":5},{}]',
        'Here [ {"content":"a"} , {"content":"\\u00a0"} ] end',
        '{"facts":{"content":"a"}}', '{"other":[{"content":"a"}]}', '[{"content":"a"', "no JSON", "", None, '```\n\n```', "[]", '"text"', '{"facts":[{"content":"a","content":"b"}]}',
    ]
    assert parsed(spark, X.facts, raws) == [
        [fact("a"), fact("b")],
        [fact("a"), fact("b", "technical", 1.0, ["e", "f"], object="o")],
        [fact("a")], [fact("a")], None, None, None, None, [], [], None, [], None, None,
    ]


def test_nodes_beside_spoiled_items(spark):
    raws = [
        '{"nodes":["x",{"summary":"s","metadata":"none","relatedEntities":["e",1]},{"frontmatter":3,"summary":" "},{"nodeType":"EPISODIC","frontmatter":"f","searchKeywords":["a",2,"b"],"metadata":{"confidence":"high","category":"","actors":["p",7],"entities":["x","x"],"salience":"1"}}]}',
        '[{"frontmatter":"f","nodeType":4,"metadata":{"subject":1,"predicate":" p ","category":"Decision","salience":-1,"entities":["x","x"]},"relatedEntities":["y","x"]}]',
    ]
    first, second = parsed(spark, X.nodes, raws)
    keys = ("node_type", "frontmatter", "summary", "keywords")
    assert [[n[k] for k in keys] for n in first] == [["semantic", "s", "s", ""], ["episodic", "f", "f", "a b"]]
    assert first[0]["metadata"]["entities"] == ["e"] and first[0]["metadata"]["confidence"] is None
    m = first[1]["metadata"]
    assert (m["confidence"], m["category"], m["actors"], m["entities"], m["salience"], m["subject"]) == (0.5, None, ["p"], ["x", "x"], None, None)
    m = second[0]["metadata"]
    assert (m["subject"], m["predicate"], m["category"], m["salience"], m["entities"]) == (None, "p", "decision", 0.0, ["x", "y"])


def episode(start, end, title="t", actors=("a",), kind="event", outcome=None):
    return {"start_turn": start, "end_turn": end, "type": kind, "title": title, "description": "d", "actors": list(actors), "outcome": outcome}


def test_episodes_beside_spoiled_items(spark):
    good = '{"type":"event","title":" t ","description":"d","startTurnIndex":%s,"endTurnIndex":%s,"actors":%s}'
    raws = [
        "[%s]" % ",".join(["3", good % (4, 5, '["a"]'), "null", good % (1, 2, '[" b ",3,""]'), good % ('"1"', 2, '["a"]'), good % (1.5, 2, '["a"]'), good % (1, 9, '["a"]'), good % (3, 2, '["a"]'), good % (0, 1, '[7]'), good % (0, 1, '"a"'), '{"type":3}', good % (1.0, 2, '["c"]')]),
        "```json\n[%s]\n```" % (good % (0, 0, '["a"]')).replace('"actors"', '"outcome":" o ","actors"'),
        '{"episodes":[]}', "text",
    ]
    got = parsed(spark, lambda c: X.episodes(c, F.lit(8), ("event", "action")), raws)
    assert got == [[episode(1, 2, actors=[" b "]), episode(1, 2, actors=["c"]), episode(4, 5)], [episode(0, 0, outcome="o")], None, None]


def test_summaries_beside_spoiled_items(spark):
    raws = ['{"summaries":[{"id":1,"summary":"x"},["id"],{"id":" a ","summary":" s "},{"id":"b","frontmatter":"f","summary":5},{"id":"c"}]}', '["a"]']
    assert parsed(spark, X.summaries, raws) == [[{"id": "a", "frontmatter": "s", "summary": "s"}, {"id": "b", "frontmatter": "f", "summary": "f"}], []]


def test_frontmatter_with_spoiled_fields(spark):
    raws = ['{"frontmatter":{"label":4,"category":["technical"],"keywords":["K",1,"k"," ","x"],"domain":" D ","importance":"HIGH"},"summary":{}}', '{"frontmatter":"none","summary":" s "}', "", '{"frontmatter":{"keywords":[%s]}}' % ",".join(f'"k{i}"' for i in range(15))]
    got = parsed(spark, lambda c: X.frontmatter(c, F.lit("content")), raws)
    assert got[0] == {"label": "content", "category": "other", "keywords": ["k", "x"], "domain": "d", "importance": "high", "summary": "content"}
    assert got[1] == {"label": "content", "category": "other", "keywords": [], "domain": None, "importance": None, "summary": "s"}
    assert got[2]["label"] == got[2]["summary"] == "content" and got[3]["keywords"] == [f"k{i}" for i in range(10)]
    assert parsed(spark, lambda c: X.frontmatter(c, F.lit("")), [""])[0]["label"] == "Untitled fact"


def test_decisions_beside_spoiled_items(spark):
    raws = [
        FENCED % '{"connect":["3",{"anchorId":3},{"anchorId":"3","weight":"1"},{"anchorId":"4","weight":7,"reason":"r"},{"anchorId":"9"}],"create":[0,{"label":"x"},{"label":" n ","description":"d","anchorType":"odd","aliases":["a",1,null],"weight":-1},{"label":"m","description":3}]}',
        '{"connect":{"anchorId":"3"},"create":null}', "text {} text", None, "[1]",
    ]
    got = parsed(spark, lambda c: X.decision(c, F.array(F.lit("3"), F.lit("4"))), raws)
    none = {"connect": [], "create": []}
    assert got == [
        {"connect": [{"anchor_id": "3", "weight": 0.5, "reason": None}, {"anchor_id": "4", "weight": 1.0, "reason": "r"}], "create": [{"label": "n", "description": "d", "anchor_type": "topic", "aliases": ["a"], "weight": 0.0}]},
        none, none, none, none,
    ]


def test_judgments_beside_spoiled_items(spark):
    raws = ['```json\n{"isolated":"no","decisions":[null,{"action":"connect","anchorId":3,"strength":"0.7"},{"action":"connect","anchorId":"3","strength":null},{"action":"create","label":12,"anchorType":"entity","strength":true},{"action":"create","label":{}},{"action":7},"connect"]}\n```', '{"decisions":{}}', "text", "[]", "3"]
    got = parsed(spark, lambda c: X.judgment(c, F.array(F.lit("3"))), raws)
    link = lambda s: {"action": "connect", "anchor_id": "3", "label": None, "anchor_type": None, "strength": s}
    assert got[0] == {"isolated": True, "decisions": [link(0.7), link(0.0), {"action": "create", "anchor_id": None, "label": "12", "anchor_type": "entity", "strength": 1.0}]}
    assert got[1:] == [{"isolated": False, "decisions": []}, None, {"isolated": False, "decisions": []}, None]


def test_rerank_scores_beside_spoiled_items(spark):
    raws = ['{"scores":[1,{"id":"a","relevance":"0.5"},{"id":"b","relevance":[]},{"id":"c","relevance":1},{"relevance":1},{"id":7,"relevance":3}]}', '{"scores":"a"}', "text"]
    got = parsed(spark, lambda c: X.rerank_scores(c, F.array(*map(F.lit, ("a", "b", "7")))), raws)
    assert got == [[{"id": "a", "relevance": 0.5}, {"id": "b", "relevance": 0.0}, {"id": "7", "relevance": 1.0}], [], None]


def test_concepts_beside_spoiled_items(spark):
    raws = ['{"concepts":["x",{"name":" n ","description":" d ","relevance":2,"category":"domain","aliases":["a",1," "],"relatedConcepts":[" m "]},{"name":"m","description":"","relevance":0.4,"category":"Domain"},{"name":"o","relevance":1},{"name":"p","description":"d","relevance":"1"}]}', '[{"name":"n"}]', None]
    got = parsed(spark, X.concepts, raws)
    assert got == [[{"name": "n", "description": "d", "aliases": ["a"], "category": "domain", "relevance": 1.0, "related": ["m"]}, {"name": "m", "description": "", "aliases": [], "category": "other", "relevance": 0.4, "related": []}], [], []]


@pytest.mark.parametrize("parser", [X.facts, X.nodes, X.summaries, X.concepts])
def test_answers_of_any_shape_raise_nothing(spark, parser):
    raws = ["{", "]", "{}", "[[[]]]", '{"a":' * 60 + "1" + "}" * 60, "1e999", "\x00", '{"facts":[{"content":"' + "x" * 100_000 + '"}]}', "```", "``` ```", "[1,2", '{"nodes":null}']
    assert len(parsed(spark, parser, raws)) == len(raws)
