"""Registered queries of embeddings, concepts and hub links, over answers and entities made from the conversations' whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import concepts as K
from ..operators import entities as E
from ..operators import extract as X
from ..sources import views as V
from ..sources.shared import written
from .catalog import query, r4
from .more import _ENT, _MENTION, _mentions, _NAMED

DIMS = 32


# --- deterministic embedding -------------------------------------------------------------------------------------------
def embed_sql(text: str, dims: int) -> str:
    """The vector of a text, in DuckDB: hash over UTF-16 units, generator, length 1."""
    steps, a, c = [], 1, 0
    for _ in range(dims):
        a, c = a * S.GENERATOR_FACTOR % 2**32, (c * S.GENERATOR_FACTOR + S.GENERATOR_STEP) % 2**32
        steps.append(f"{{'a': {a}, 'c': {c}}}")
    points = f"list_transform(regexp_extract_all({text}, '(?s).'), lambda ch: unicode(ch))"
    units = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 65536 THEN [CAST(p AS HUGEINT)] ELSE [CAST(55296 + (p - 65536) // 1024 AS HUGEINT), CAST(56320 + (p - 65536) % 1024 AS HUGEINT)] END))"
    hashed = f"list_reduce(list_concat([CAST(0 AS HUGEINT)], {units}), lambda h, u: (h * 31 + u) % 4294967296)"
    raw = f"list_transform([{', '.join(steps)}], lambda s: CAST((s.a * {hashed} + s.c) % 2147483648 AS DOUBLE) / 2147483647.0)"
    return raw


def unit_sql(vector: str) -> str:
    return f"list_transform({vector}, lambda e: e / sqrt(list_sum(list_transform({vector}, lambda z: z * z))))"


@query(f"WITH v AS (SELECT conv_id, turn, {embed_sql('text', 16)} AS v FROM conversations) SELECT conv_id, turn, {r4('v[1] / sqrt(list_sum(list_transform(v, lambda z: z * z)))')} AS first, {r4('v[16] / sqrt(list_sum(list_transform(v, lambda z: z * z)))')} AS last FROM v")
def text_embedding(spark, sf):
    v = S.hash_embedding(F.col("text"), 16)
    return V.read(spark, sf, "conversations").select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", S.round_to(F.col("v")[0]).alias("first"), S.round_to(F.col("v")[15]).alias("last"))


# --- concepts of answers -----------------------------------------------------------------------------------------------
def concept_answers(spark, sf) -> DataFrame:
    """(conv_id, raw): for each message an answer whose concepts are the words of its text: short aliases make them collide, the next
    word and an alias of the one before are related; some items are spoiled."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    alias = lambda w: F.concat(F.substring(w, 1, 2), F.lit("#"))
    beside = lambda i, k, f: F.coalesce(F.filter(F.transform(F.slice("w", F.greatest(i + 1 + k, F.lit(1)), F.when(i + k < 0, 0).otherwise(1)), f), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    one = F.transform("w", lambda w, i: F.struct(w.alias("name"), F.lit("d").alias("description"), F.array(alias(w), F.substring(w, -3, 3)).alias("aliases"), (F.pmod(F.length(w) * 7 + F.ascii(w), F.lit(11)) / 10).alias("relevance"), F.concat(beside(i, 1, lambda x: x), beside(i, -1, alias)).alias("relatedConcepts")))
    rows = V.dealt(V.read(spark, sf, "conversations").select("conv_id", "turn", "text")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("conv_id"), words.alias("w"))
    raw = F.regexp_replace(F.to_json(F.struct(one.alias("concepts"))), r"^\{\"concepts\":\[", '{"concepts":["text",{"name":"no more"},')
    return rows.where(F.size("w") > 0).select("conv_id", F.concat(F.lit("```json\n"), raw, F.lit("\n```")).alias("raw"))


def _known(spark, sf) -> DataFrame:
    """Concepts that are known: the customers' segments, with two letters as aliases."""
    segments = V.read(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    return segments.select("name", F.array(F.concat(F.substring("name", 1, 2), F.lit("#"))).alias("aliases"))


def _kept(spark, sf) -> DataFrame:
    # Answers stand in a table, as they would, and are read once.
    raw = written(concept_answers(spark, sf), "answers")
    found = V.dealt(raw).select("conv_id", X.concepts(F.col("raw")).alias("c")).select("conv_id", F.posexplode("c").alias("place", "c"))
    return K.extract_concepts(written(found.select("conv_id", "place", "c.*"), "concepts"), _known(spark, sf))


_CONCEPTS = """WITH RECURSIVE w AS (SELECT conv_id * 1000 + turn AS cid, regexp_extract_all(lower(text), '[a-z]{3,}') AS ws FROM conversations),
 d AS (SELECT cid, w, row_number() OVER (PARTITION BY cid ORDER BY min(i)) AS i FROM (SELECT cid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w) GROUP BY 1, 2),
 a AS (SELECT *, [left(w, 2) || '#', right(w, 3)] AS aliases, (length(w) * 7 + unicode(w)) % 11 / 10 AS rel, lead(w) OVER o AS nxt, left(lag(w) OVER o, 2) || '#' AS prv FROM d WINDOW o AS (PARTITION BY cid ORDER BY i)),
 t AS (SELECT *, list_concat([w], aliases) AS own, row_number() OVER (PARTITION BY cid ORDER BY rel DESC, i) AS p FROM a WHERE rel >= 0.4 QUALIFY p <= 20),
 kn AS (SELECT list(DISTINCT x) AS ks FROM (SELECT unnest([lower(c_mktsegment), lower(left(c_mktsegment, 2)) || '#']) AS x FROM customer)),
 n AS (SELECT t.*, row_number() OVER (PARTITION BY cid ORDER BY p) AS q FROM t, kn WHERE NOT list_has_any(own, ks)),
 r AS (SELECT DISTINCT cid, CAST(0 AS BIGINT) AS q, CAST([] AS STRUCT(p BIGINT, own VARCHAR[])[]) AS ls, CAST(NULL AS BIGINT) AS lead FROM n
  UNION ALL SELECT cid, q, CASE WHEN hit IS NULL THEN list_append(ls, {'p': p, 'own': own}) ELSE ls END, coalesce(hit, p)
  FROM (SELECT n.cid, n.q, n.p, n.own, r.ls, list_filter(list_transform(n.own, lambda x: list_filter(r.ls, lambda l: list_contains(l.own, x))[1].p), lambda y: y IS NOT NULL)[1] AS hit FROM r JOIN n ON n.cid = r.cid AND n.q = r.q + 1)),
 m AS (SELECT n.*, r.lead FROM r JOIN n ON n.cid = r.cid AND n.q = r.q),
 k AS (SELECT m.cid AS conv_id, m.p AS place, m.w AS name, m.rel AS relevance, list_sort(list_distinct(CASE WHEN g.n > 1 THEN list_filter(g.every, lambda x: x <> m.w) ELSE m.aliases END)) AS aliases FROM m JOIN (SELECT cid, lead, list(DISTINCT x) AS every, count(DISTINCT p) AS n FROM (SELECT cid, lead, p, unnest(own) AS x FROM m) GROUP BY 1, 2) g ON g.cid = m.cid AND g.lead = m.p WHERE m.lead = m.p)"""
_EDGES = """, key AS (SELECT conv_id, x AS key, max(place) AS place FROM (SELECT conv_id, place, unnest(list_concat([name], aliases)) AS x FROM k) GROUP BY 1, 2),
 rel AS (SELECT cid AS conv_id, lead, p, z.turn AS turn, z.mention AS mention FROM (SELECT cid, lead, p, unnest([{'turn': 1, 'mention': nxt}, {'turn': 2, 'mention': prv}]) AS z FROM m) WHERE z.mention IS NOT NULL),
 rl AS (SELECT rel.conv_id, rel.p, rel.turn, rel.mention, k.place AS pl, k.relevance, sk.place AS source FROM rel JOIN k ON k.conv_id = rel.conv_id AND k.place = rel.lead JOIN key sk ON sk.conv_id = k.conv_id AND sk.key = k.name),
 e AS (SELECT rl.conv_id, rl.pl, rl.p, rl.turn, rl.source, tk.place AS target, floor((CASE WHEN n.relevance IS NULL THEN rl.relevance * 0.5 ELSE (rl.relevance + n.relevance) / 2 END) * 100 + 0.5) / 100 AS weight
  FROM rl JOIN key tk ON tk.conv_id = rl.conv_id AND tk.key = rl.mention LEFT JOIN k n ON n.conv_id = rl.conv_id AND n.name = rl.mention WHERE rl.source <> tk.place),
 f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, least(source, target), greatest(source, target) ORDER BY pl, p, turn) AS o FROM e)"""


@query(f"{_CONCEPTS} SELECT conv_id, name, relevance, array_to_string(aliases, ',') AS aliases FROM k")
def concept_answers_merged(spark, sf):
    low = F.array_sort(F.array_distinct(F.transform("aliases", F.lower)))
    return _kept(spark, sf).select("conv_id", "name", "relevance", F.array_join(low, ",").alias("aliases"))


@query(f"{_CONCEPTS}{_EDGES} SELECT conv_id, s.name AS source, t.name AS target, weight FROM f JOIN k s USING (conv_id) JOIN k t USING (conv_id) WHERE o = 1 AND s.place = source AND t.place = target")
def concept_edges(spark, sf):
    kept = _kept(spark, sf)
    source, target = (kept.select(F.col("conv_id").alias(f"{c}_conv"), F.col("place").alias(f"{c}_place"), F.col("name").alias(f"{c}_name")) for c in ("s", "t"))
    edges = K.concept_edges(kept).join(source, (F.col("conv_id") == F.col("s_conv")) & (F.col("source") == F.col("s_place"))).join(target, (F.col("conv_id") == F.col("t_conv")) & (F.col("target") == F.col("t_place")))
    return edges.select("conv_id", F.col("s_name").alias("source"), F.col("t_name").alias("target"), "weight")


@query(f"{_CONCEPTS}{_EDGES}, fa AS (SELECT DISTINCT cid AS conv_id, i AS fact_id, key FROM (SELECT cid, i, unnest([upper(w), left(w, 2) || '#']) AS key FROM a)) SELECT DISTINCT fa.conv_id, fact_id, k.name, CAST(0.6 AS DOUBLE) AS weight FROM fa JOIN key ON key.conv_id = fa.conv_id AND key.key = lower(fa.key) JOIN k ON k.conv_id = key.conv_id AND k.place = key.place")
def fact_concept_edges(spark, sf):
    """Facts are the words of each text; their entities are the word in capitals and its alias."""
    kept = _kept(spark, sf)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    facts = V.read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("conv_id"), F.posexplode(words).alias("i", "w")).select("conv_id", (F.col("i") + 1).alias("fact_id"), F.array(F.upper("w"), F.concat(F.substring("w", 1, 2), F.lit("#"))).alias("entities"))
    return K.fact_concept_edges(kept, facts).join(kept.select("conv_id", "place", "name"), ["conv_id", "place"]).select("conv_id", "fact_id", "name", "weight")


@query(f"""{_CONCEPTS}, old AS (SELECT w AS name, 0.5 AS relevance, ['old'] AS aliases, [-1] AS sources, 'old' AS tag FROM (SELECT DISTINCT w FROM d WHERE length(w) = 5)),
 new AS (SELECT name, max(relevance) AS relevance, list_distinct(flatten(list(aliases))) AS aliases, list_sort(list(DISTINCT conv_id)) AS sources, CAST(max(conv_id) AS VARCHAR) AS tag FROM k GROUP BY 1)
 SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.relevance IS NULL THEN n.relevance WHEN n.relevance IS NULL THEN o.relevance ELSE greatest(o.relevance, n.relevance) END AS relevance, len(list_distinct(list_concat(coalesce(o.aliases, []), coalesce(n.aliases, [])))) AS n_aliases,
 len(coalesce(o.sources, [])) + len(coalesce(n.sources, [])) AS n_sources, coalesce(o.tag, n.tag) AS tag FROM old o FULL JOIN new n ON n.name = o.name""")
def concept_persist(spark, sf):
    """Every word of five letters is a known concept already."""
    old = V.read(spark, sf, "conversations").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("name")).where("length(name) = 5").distinct()
    old = old.select(F.xxhash64("name").alias("id"), "name", F.lit(0.5).alias("relevance"), F.array(F.lit("old")).alias("aliases"), F.array(F.lit(-1).cast("long")).alias("sources"), F.create_map(F.lit("tag"), F.lit("old")).alias("metadata"))
    kept = _kept(spark, sf).withColumn("metadata", F.create_map(F.lit("tag"), F.col("conv_id").cast("string")))
    return K.persist_concepts(old, kept).select("name", "relevance", F.size("aliases").cast("long").alias("n_aliases"), F.size("sources").cast("long").alias("n_sources"), F.col("metadata")["tag"].alias("tag"))


# --- entities and hubs -------------------------------------------------------------------------------------------------
_LINK = f"""WITH {_ENT}, en AS (SELECT conv_id * 1000 + turn AS id, unnest(e) AS raw FROM ent), m AS (SELECT DISTINCT id, lower(trim(raw)) AS entity FROM en WHERE trim(raw) <> ''),
 ev AS (SELECT entity, {embed_sql('entity', DIMS)} AS v FROM (SELECT DISTINCT entity FROM m)), e1 AS (SELECT entity, {unit_sql('v')} AS v FROM ev),
 h AS (SELECT doc_id AS hub_id, split_part(text, ' ', 1) AS label FROM documents WHERE doc_id % 20 = 0 AND split_part(text, ' ', 1) <> ''), hv AS (SELECT hub_id, label, {embed_sql('lower(label)', DIMS)} AS v FROM h), h1 AS (SELECT hub_id, label, {unit_sql('v')} AS v FROM hv),
 bl AS (SELECT e1.entity, min(hub_id) AS hub_id FROM e1 JOIN h1 ON lower(label) = entity GROUP BY 1),
 pr AS (SELECT e1.entity, hub_id, list_sum(list_transform(range(1, {DIMS + 1}), lambda i: e1.v[i] * h1.v[i])) AS s FROM e1, h1),
 bv AS (SELECT entity, hub_id, {r4('s')} AS s FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY {r4('s')} DESC, hub_id) AS p FROM pr WHERE s >= 0.85) WHERE p = 1)"""


def _resolved_sql(first: str, second: str) -> str:
    return f""", rs AS (SELECT e1.entity, coalesce({first}.hub_id, {second}.hub_id) AS hub_id, CASE WHEN {first}.hub_id IS NOT NULL THEN '{first}' WHEN {second}.hub_id IS NOT NULL THEN '{second}' ELSE 'new' END AS way, bv.s AS s FROM e1 LEFT JOIN bl ON bl.entity = e1.entity LEFT JOIN bv ON bv.entity = e1.entity),
 re AS (SELECT rs.entity, CASE WHEN way = 'new' THEN upper(left(rs.entity, 1)) || substr(rs.entity, 2) ELSE h.label END AS hub_label, rs.hub_id, CASE way WHEN 'bl' THEN 'exact-match' WHEN 'bv' THEN 'cosine-match' ELSE 'new-hub' END AS resolution, CASE WHEN way = 'bv' THEN s END AS similarity FROM rs LEFT JOIN h ON h.hub_id = rs.hub_id)"""


def _mentioned(spark, sf) -> DataFrame:
    return V.read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.explode(E.extract_entities(F.col("text"))[0]).alias("entity"))


def _resolved(spark, sf, label_first: bool) -> tuple[DataFrame, DataFrame]:
    key = F.lower(F.trim("entity"))
    entities = _mentioned(spark, sf).select(key.alias("entity")).distinct()
    hubs = V.memory_nodes(spark, sf).where("node_role = 'hub'").select("id", F.substring_index("content", " ", 1).alias("label")).where("label <> ''")
    embedded = entities.withColumn("embedding", S.hash_embedding(F.col("entity"), DIMS))
    return embedded, E.resolve_hubs(embedded, hubs.withColumn("embedding", S.hash_embedding(F.lower("label"), DIMS)), label_first=label_first)


@query(f"{_LINK}{_resolved_sql('bl', 'bv')} SELECT entity, hub_label, CASE WHEN resolution <> 'new-hub' THEN hub_id END AS hub_id, resolution, similarity FROM re")
def entity_hub_resolve(spark, sf):
    """Label first, then the nearest hub. Ids of new hubs are hashes, which SQL doesn't know."""
    found = _resolved(spark, sf, True)[1]
    return found.select("entity", "hub_label", F.when(F.col("resolution") != "new-hub", F.col("hub_id")).alias("hub_id"), "resolution", "similarity")


@query(f"{_LINK}{_resolved_sql('bl', 'bv')} SELECT DISTINCT m.id, hub_label, CAST(50 AS DOUBLE) AS weight FROM m JOIN re ON re.entity = m.entity")
def entity_hub_links(spark, sf):
    """Edges from nodes to hubs, with weights up to 100."""
    found = _resolved(spark, sf, True)[1]
    edges = E.hub_edges(_mentioned(spark, sf), found)
    return edges.join(found.select(F.col("hub_id").alias("target_id"), "hub_label").distinct(), "target_id").select(F.col("source_id").alias("id"), "hub_label", "weight").distinct()


@query(f"{_LINK}{_resolved_sql('bv', 'bl')} SELECT DISTINCT m.id, hub_label, CAST(0.5 AS DOUBLE) AS weight, bool_or(resolution = 'new-hub') AS is_new FROM m JOIN re ON re.entity = m.entity GROUP BY 1, 2")
def hub_pipeline_links(spark, sf):
    """The vector first, then the label, else a new hub; edges from hubs to nodes, with weights up to 1."""
    entities, found = _resolved(spark, sf, False)
    made = E.new_hubs(found, entities).select(F.col("id").alias("source_id"), F.lit(True).alias("is_new"))
    edges = E.hub_edges(_mentioned(spark, sf), found, 0.5, from_hub=True).join(found.select(F.col("hub_id").alias("source_id"), "hub_label").distinct(), "source_id").join(made, "source_id", "left")
    return edges.groupBy(F.col("target_id").alias("id"), "hub_label", "weight").agg(F.bool_or(F.coalesce("is_new", F.lit(False))).alias("is_new"))


@query(f"""WITH {_MENTION}, k AS (SELECT m.entity, n, nodes, label, {_NAMED} AS named, {embed_sql('label', DIMS)} AS v FROM m JOIN l ON l.entity = m.entity WHERE length(m.entity) >= 2), k1 AS (SELECT * REPLACE ({unit_sql('v')} AS v) FROM k),
 h AS (SELECT doc_id AS hub_id, split_part(text, ' ', 1) AS hub_label FROM documents WHERE doc_id % 20 = 0 AND split_part(text, ' ', 1) <> ''), hv AS (SELECT hub_id, {embed_sql('lower(hub_label)', DIMS)} AS v FROM h), h1 AS (SELECT hub_id, {unit_sql('v')} AS v FROM hv),
 pr AS (SELECT k1.entity, k1.label, hub_id, list_sum(list_transform(range(1, {DIMS + 1}), lambda i: k1.v[i] * h1.v[i])) AS s FROM k1, h1), nr AS (SELECT entity, label, hub_id, {r4('s')} AS s FROM pr WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY {r4('s')} DESC, hub_id) = 1),
 al AS (SELECT entity, label, 'existing' AS kind, hub_id, s AS confidence FROM nr QUALIFY row_number() OVER (PARTITION BY hub_id ORDER BY s DESC, entity) = 1 UNION ALL
  SELECT entity, label, 'new', NULL, floor(least(1, 0.5 + CASE WHEN named THEN 0.2 ELSE 0 END + CASE WHEN nodes >= 3 THEN 0.15 WHEN nodes >= 2 THEN 0.1 ELSE 0 END + CASE WHEN n >= 3 THEN 0.1 ELSE 0 END) * 1e4 + 0.5) / 1e4 FROM k1 WHERE entity NOT IN (SELECT entity FROM nr)) SELECT entity, label, kind, hub_id, confidence FROM al ORDER BY confidence DESC, entity LIMIT 60""")
def hub_candidates_known(spark, sf):
    """Candidates that known hubs stand for already, and new ones."""
    found = _mentions(spark, sf).withColumn("embedding", S.hash_embedding(F.col("label"), DIMS))
    hubs = V.memory_nodes(spark, sf).where("node_role = 'hub'").select("id", F.substring_index("content", " ", 1).alias("label")).where("label <> ''").select("id", S.hash_embedding(F.lower("label"), DIMS).alias("embedding"))
    return E.known_or_new_hubs(found, hubs, 60)
