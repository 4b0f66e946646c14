"""Registered queries of the parsers of model answers, over answers made from the event rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import memory as M
from ..sources import views as V
from .catalog import query

EPISODE_TYPES = ("action", "decision", "event", "discovery")

def _spoiled() -> Column:
    """Items that are no objects, by row, before, between or after the good ones of each answer."""
    return F.element_at(F.array(*map(F.lit, ('"text",', "null,", '[{"content":"in a list"}],', "7,true,", ""))), (F.col("event_id") % 5 + 1).cast("int"))


def _answers(spark, sf, *parts: Column | str):
    """event_id and an answer of literal texts and columns."""
    raw = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return V.dealt(V.read(spark, sf, "events").select("event_id", "event_type")).select("event_id", "event_type", raw.alias("raw"))



@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'episodic' ELSE 'semantic' END AS node_type, 's' || event_id AS frontmatter, 's' || event_id AS summary, 'a b' AS keywords, CAST(least(event_id % 3, 1) AS DOUBLE) AS confidence,
 'E,' || event_type AS entities, CASE WHEN event_id % 2 = 0 THEN 'p' END AS actors, CASE WHEN event_id % 2 = 1 THEN 'S' END AS subject, CAST(1 AS INTEGER) AS n FROM events""")
def parse_nodes(spark, sf):
    kind = F.when(F.col("event_id") % 2 == 0, " Episodic ").otherwise(F.col("event_type"))
    rows = _answers(spark, sf, 'Here:\n```json\n{"nodes":[', _spoiled(), '{"nodeType":"', kind, '","frontmatter":" ","summary":" s', F.col("event_id"), ' ","searchKeywords":["a"," b ",""],"relatedEntities":["', F.col("event_type"), '","E"],"metadata":{"confidence":', F.col("event_id") % 3, ',"entities":["E"],"actors":["p"," "],"subject":" S "}},', _spoiled(), '{"summary":3}]}\n```')
    n = F.col("n")[0]
    return rows.select("event_id", X.nodes(F.col("raw")).alias("n")).select("event_id", n["node_type"].alias("node_type"), n["frontmatter"].alias("frontmatter"), n["summary"].alias("summary"), n["keywords"].alias("keywords"), n["metadata"]["confidence"].alias("confidence"), F.array_join(n["metadata"]["entities"], ",").alias("entities"), F.array_join(n["metadata"]["actors"], ",").alias("actors"), n["metadata"]["subject"].alias("subject"), F.size("n").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 10 <= 5 THEN 't' || event_id || ',b' ELSE 'b' END AS titles, CASE WHEN event_id % 10 <= 5 THEN CAST(event_id % 10 AS BIGINT) ELSE 7 END AS first_turn FROM events")
def parse_episodes(spark, sf):
    rows = _answers(spark, sf, '```json\n[{"type":"event","title":"b","description":"d","startTurnIndex":7,"endTurnIndex":8,"actors":["x"]},', _spoiled(), '{"type":"action","title":" t', F.col("event_id"), ' ","description":"d","startTurnIndex":', F.col("event_id") % 10, ',"endTurnIndex":5,"actors":["", "y"]},{"type":"dream","title":"t","description":"d","startTurnIndex":1,"endTurnIndex":2,"actors":["x"]},{"type":"event","title":"u","description":"d","startTurnIndex":1.5,"endTurnIndex":2,"actors":["x"]},{"type":"event","title":"v","description":"d","startTurnIndex":1,"endTurnIndex":9,"actors":["x"]}]\n```')
    found = rows.select("event_id", X.episodes(F.col("raw"), F.lit(8), EPISODE_TYPES).alias("e"))
    return found.select("event_id", F.array_join(F.transform("e", lambda e: e["title"]), ",").alias("titles"), F.col("e")[0]["start_turn"].alias("first_turn"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'L' || event_id ELSE event_type END AS label, CASE WHEN event_id % 3 = 0 THEN 'technical' ELSE 'other' END AS category, 'k,x' AS keywords, CASE WHEN event_id % 5 = 0 THEN 'high' END AS importance, CASE WHEN event_id % 2 = 0 THEN 'sum' ELSE event_type END AS summary FROM events")
def parse_frontmatter(spark, sf):
    label = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" L"), F.col("event_id").cast("string"))).otherwise(" ")
    rows = _answers(spark, sf, 'x {"frontmatter":{"label":"', label, '","category":"', F.when(F.col("event_id") % 3 == 0, "Technical").otherwise("misc"), '","keywords":["K","k "," ","x"],"importance":"', F.when(F.col("event_id") % 5 == 0, "HIGH").otherwise("huge"), '"},"summary":"', F.when(F.col("event_id") % 2 == 0, "sum ").otherwise(""), '"} y')
    f = X.frontmatter(F.col("raw"), F.col("event_type"))
    return rows.select("event_id", f.alias("f")).select("event_id", F.col("f.label").alias("label"), F.col("f.category").alias("category"), F.array_join("f.keywords", ",").alias("keywords"), F.col("f.importance").alias("importance"), F.col("f.summary").alias("summary"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'f' ELSE 's' END AS frontmatter, CASE WHEN event_id % 2 = 0 THEN 'f' ELSE 's' END AS summary, CAST(1 AS INTEGER) AS n FROM events")
def parse_summaries(spark, sf):
    one = F.when(F.col("event_id") % 2 == 0, '"frontmatter":" f","summary":" "').otherwise('"summary":"s "')
    rows = _answers(spark, sf, '{"summaries":[', _spoiled(), '{"id":" ', F.col("event_id"), ' ",', one, '},{"id":" ","summary":"x"},{"id":"7"}]}')
    s = F.col("s")[0]
    return rows.select("event_id", X.summaries(F.col("raw")).alias("s")).select("event_id", s["id"].alias("id"), s["frontmatter"].alias("frontmatter"), s["summary"].alias("summary"), F.size("s").alias("n"))


def _decisions(spark, sf):
    rows = _answers(spark, sf, '```\n{"connect":[', _spoiled(), '{"anchorId":"3","weight":', F.col("event_id") % 4, '},{"anchorId":"8"},{"anchorId":"unknown"}],"create":[{"label":" New', F.col("event_id") % 3, ' ","description":"d","anchorType":"', F.col("event_type"), '"},', _spoiled(), '{"label":"x"}]}\n```')
    return rows.select("event_id", X.decision(F.col("raw"), F.array(F.lit("3"), F.lit("8"))).alias("decision"))


@query("SELECT event_id, '3,8' AS connected, CAST(least(1, event_id % 4) AS DOUBLE) AS weight, CAST(0.5 AS DOUBLE) AS other_weight, 'New' || (event_id % 3) AS label, 'topic' AS anchor_type FROM events")
def parse_decisions(spark, sf):
    d = F.col("decision")
    return _decisions(spark, sf).select("event_id", F.array_join(F.transform(d["connect"], lambda c: c["anchor_id"]), ",").alias("connected"), d["connect"][0]["weight"].alias("weight"), d["connect"][1]["weight"].alias("other_weight"), d["create"][0]["label"].alias("label"), d["create"][0]["anchor_type"].alias("anchor_type"))


@query("""WITH c AS (SELECT event_id, 'New' || (event_id % 3) AS label, CASE WHEN event_id % 3 = 1 THEN 77 END AS known FROM events), f AS (SELECT label, min(event_id) AS first FROM c WHERE known IS NULL GROUP BY 1)
 SELECT event_id AS fact_id, 'old' AS anchor, CAST(NULL AS VARCHAR) AS label, CAST(least(1, event_id % 4) AS DOUBLE) AS weight, FALSE AS is_new FROM events UNION ALL SELECT event_id, '8', NULL, 0.5, FALSE FROM events
 UNION ALL SELECT event_id, coalesce('NEW1', c.label), c.label, 0.5, FALSE FROM c WHERE known IS NOT NULL UNION ALL SELECT event_id, c.label, c.label, 0.5, event_id = first FROM c JOIN f ON f.label = c.label""")
def anchor_link(spark, sf):
    anchors = spark.createDataFrame([(77, "NEW1"), (78, "new1"), (3, "old")], "id long, label string")
    linked = M.link_anchors(_decisions(spark, sf).withColumnRenamed("event_id", "fact_id"), anchors)
    # Ids of new anchors are hashes: labels stand for them here.
    anchor = F.coalesce(F.element_at(F.create_map(F.lit(77), F.lit("NEW1"), F.lit(3), F.lit("old"), F.lit(8), F.lit("8")), F.col("anchor_id").try_cast("int")), F.col("label"))
    return linked.select("fact_id", anchor.alias("anchor"), "label", "weight", "is_new")


@query("SELECT event_id, event_id % 2 = 0 AS isolated, 'connect:3:0.0,create:n:0.5' AS decisions FROM events")
def parse_judgments(spark, sf):
    rows = _answers(spark, sf, '{"isolated":', (F.col("event_id") % 2 == 0), ',"decisions":[', _spoiled(), '{"action":"connect","anchorId":"3","strength":-2},{"action":"connect","anchorId":"9"},{"action":"create","label":" n ","anchorType":"odd"},{"action":"create","label":" "}]}')
    j = rows.select("event_id", X.judgment(F.col("raw"), F.array(F.lit("3"))).alias("j"))
    show = lambda d: F.concat_ws(":", d["action"], F.coalesce(d["anchor_id"], d["label"]), d["strength"].cast("string"))
    return j.select("event_id", F.col("j.isolated").alias("isolated"), F.array_join(F.transform("j.decisions", show), ",").alias("decisions"))


@query("SELECT event_id, CAST(least(1, event_id % 3 / 2) AS DOUBLE) AS first, CAST(0 AS DOUBLE) AS second, CAST(2 AS INTEGER) AS n FROM events")
def parse_rerank(spark, sf):
    rows = _answers(spark, sf, '```json\n{"scores":[', _spoiled(), '{"id":"a","relevance":', (F.col("event_id") % 3 / 2), '},{"id":"x","relevance":1},{"id":"b","relevance":"high"}]}\n```')
    s = F.col("s")
    return rows.select("event_id", X.rerank_scores(F.col("raw"), F.array(F.lit("a"), F.lit("b"))).alias("s")).select("event_id", s[0]["relevance"].alias("first"), s[1]["relevance"].alias("second"), F.size("s").alias("n"))


@query("SELECT event_id, event_id % 10 < 6 AND event_id % 4 = 0 AS isolated, CASE WHEN event_id % 10 >= 6 THEN 'connect' WHEN event_id % 4 <> 0 THEN 'create' END AS action, CASE WHEN event_id % 10 < 6 AND event_id % 4 <> 0 THEN event_type END AS label FROM events")
def heuristic_judgment(spark, sf):
    near = F.array(F.struct(F.lit(3).alias("anchor_id"), (F.col("event_id") % 10 / 10).alias("similarity")), F.struct(F.lit(4).alias("anchor_id"), F.lit(0.1).alias("similarity")))
    j = X.heuristic_judgment(near, F.when(F.col("event_id") % 4 != 0, F.col("event_type")))
    return V.read(spark, sf, "events").select("event_id", j.alias("j")).select("event_id", F.col("j.isolated").alias("isolated"), F.get("j.decisions", F.lit(0))["action"].alias("action"), F.get("j.decisions", F.lit(0))["label"].alias("label"))


@query("SELECT conv_id, turn, 's' || turn AS summary, 'episodic' AS node_type FROM conversations WHERE role = 'assistant'")
def node_extraction(spark, sf):
    """The nodes of the answer to each assistant turn."""
    raw = F.concat(F.lit('{"nodes":[{"nodeType":"episodic","summary":"s'), F.col("turn").cast("string"), F.lit('"}]}'))
    each = V.read(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.explode(X.nodes(raw)).alias("n"))
    return each.select("conv_id", "turn", F.col("n.summary").alias("summary"), F.col("n.node_type").alias("node_type"))


@query("SELECT conv_id, max(turn) AS last_turn, CAST(0 AS BIGINT) AS start_turn, max(turn) AS end_turn, 'decision' AS type FROM conversations GROUP BY 1")
def episode_batch(spark, sf):
    """The episodes of an answer to each whole conversation."""
    own = V.read(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    raw = F.concat(F.lit('[{"type":"decision","title":"t","description":"d","startTurnIndex":0,"endTurnIndex":'), F.col("last_turn").cast("string"), F.lit(',"actors":["x"]}]'))
    each = own.select("conv_id", "last_turn", F.explode(X.episodes(raw, F.col("last_turn"), EPISODE_TYPES)).alias("e"))
    return each.select("conv_id", "last_turn", F.col("e.start_turn").alias("start_turn"), F.col("e.end_turn").alias("end_turn"), F.col("e.type").alias("type"))


@query("SELECT event_id AS fact_id, 'F' || event_id AS label, 'decision' AS category, CAST(3 AS BIGINT) AS anchor_id, CAST(0.9 AS DOUBLE) AS weight FROM events")
def fact_ingest(spark, sf):
    """Facts with the label of their frontmatter answer and the anchors of their decision answer."""
    rows = _answers(spark, sf, '{"frontmatter":{"label":"F', F.col("event_id"), '","category":"decision"}}').withColumn("decision", X.decision(F.lit('{"connect":[{"anchorId":"3","weight":0.9}]}'), F.array(F.lit("3"))))
    labelled = rows.select(F.col("event_id").alias("fact_id"), X.frontmatter(F.col("raw"), F.col("event_type")).alias("f"))
    links = M.link_anchors(rows.select(F.col("event_id").alias("fact_id"), "decision"), spark.createDataFrame([(3, "old")], "id long, label string"))
    return labelled.join(links.select("fact_id", "anchor_id", "weight"), "fact_id").select("fact_id", F.col("f.label").alias("label"), F.col("f.category").alias("category"), "anchor_id", "weight")
