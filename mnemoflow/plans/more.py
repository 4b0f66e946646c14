"""Registered queries of entities, extraction, records, scoring, directed graphs and streams; they join those of catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import entities as E
from ..operators import extract as X
from ..operators import graph as G
from ..operators import records as K
from ..operators import retrieval as R
from ..operators import weights as W
from ..sources import views as V
from ..streaming import events as T
from .catalog import _FTS200, _HYBRID, _TOP, _UND, _bm25_sql, _hybrid, _seeds, _W, by, COS, first_vector, NOW, Q0, query, r4, TERMS, text_index, unit_edges


def _vectors(spark, sf) -> DataFrame:
    return V.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


# --- vectors -----------------------------------------------------------------------------------------------------------
_PAIR = "greatest(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])), 0)"


@query(f"SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS p FROM (SELECT u.vec_id AS query_id, v.vec_id AS id, {r4(_PAIR)} AS score FROM embeddings u, embeddings v WHERE u.vec_id % 50 = 0)) WHERE p <= 10")
def vec_batch_topk(spark, sf):
    return R.batch_top_k(_vectors(spark, sf).withColumn("factor", F.lit(1.0)), _vectors(spark, sf).where("id % 50 = 0").withColumnRenamed("id", "query_id"))


@query(f"WITH c AS (SELECT u.vec_id AS query_id, v.vec_id AS id, {_PAIR} AS near, (v.label + 1) / 10.0 AS w FROM embeddings u, embeddings v WHERE u.vec_id % 50 = 0) SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS p FROM (SELECT query_id, id, {r4('near * w')} AS score FROM c WHERE near >= 0.25)) WHERE p <= 10")
def anchor_candidates(spark, sf):
    return R.batch_top_k(V.anchors(spark, sf).withColumn("factor", F.col("current_weight")), _vectors(spark, sf).where("id % 50 = 0").withColumnRenamed("id", "query_id"), least=0.25)


@query(f"WITH {Q0}, t AS (SELECT vec_id AS id, {COS} AS near FROM embeddings, q), k AS (SELECT id, {r4('near')} AS score FROM t WHERE near >= 0.3 ORDER BY score DESC, id LIMIT 20) SELECT id, score FROM k WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def chunk_search(spark, sf):
    return R.chunk_search(_vectors(spark, sf), V.read(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("id")), first_vector(spark, sf))


_FEW = f"{_bm25_sql(TERMS, True, _W, limit=200)}, b AS (SELECT min(rank) AS lo, max(rank) AS hi, count(*) AS n FROM hits), f AS (SELECT id, {r4('CASE WHEN hi > lo THEN (hi - rank) / (hi - lo) ELSE 1.0 END')} AS fts_score FROM hits, b)"


@query(f"""{V.with_views('nodes')}, {_FEW}, {Q0}, sc AS (SELECT id, 0.3 * fts_score + 0.7 * coalesce({COS}, 0) AS score FROM f LEFT JOIN embeddings e ON e.vec_id = f.id, q UNION ALL SELECT vec_id, 0.7 * {COS} FROM embeddings, q, b WHERE b.n < 5),
 a AS (SELECT sc.id, {r4(f'max(sc.score) * pow(2, -greatest(0, {NOW} - any_value(last_event)) / 50)')} AS score FROM sc JOIN nodes ON nodes.id = sc.id GROUP BY 1) SELECT id, score FROM a WHERE score >= 0.01 ORDER BY score DESC, id LIMIT 20""")
def hybrid_fallback(spark, sf):
    return R.hybrid_or_all(text_index(spark, sf), _vectors(spark, sf), TERMS, first_vector(spark, sf), NOW, least=0.01, every=True)


_TERM_SET = "list_filter(list_distinct(string_split_regex(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9\\s\\-_]', ' ', 'g'), '\\s+')), lambda t: len(t) > 2 AND NOT list_contains([{}], t))"
_RERANK = "list_filter(list_distinct(string_split_regex(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9가-힣\\s]', ' ', 'g'), '\\s+')), lambda t: len(t) > 2 AND NOT list_contains([{}], t))"
_quoted = lambda text: ", ".join(f"'{w}'" for w in text.split())
# Literal, as the contract names them, so that a wrong list of the library shows.
_STOP = _quoted("the and for are but not you all can had her was one our out has have been from its they were will with this that what when which would there their about each make like than them then these some could other into more also back after only come made most over such just use used using does did")
_RERANK_STOP = _quoted("the is at in on and or to a an of for with that this was are has have had been will can not but from they its does how what when where which who why")
_ENTITY_STOP = _quoted("about above after again against also been before being below between both cannot could does doing down during each from further have having here into itself just more most myself once only other over same should some such than that their them then there these they this those through under until very want were what when where which while whom will with would your because how many much need the and for are but not you all any can had her was one our out has his its let may new now old see way who did got use used using like make made know tell work take come help think look")
_TRAVERSE = f"""{_UND}, l0 AS (SELECT * FROM (VALUES (1, CAST(1.0 AS DOUBLE)), (7, CAST(0.8 AS DOUBLE))) t(id, s)),
 l1 AS (SELECT dst AS id, max(s * w * 0.7) AS s FROM l0 JOIN u ON u.src = l0.id WHERE w >= 0.1 AND s * w * 0.7 >= 0.05 GROUP BY 1),
 l2 AS (SELECT dst AS id, max(s * w * 0.7) AS s FROM l1 JOIN u ON u.src = l1.id WHERE w >= 0.1 AND s * w * 0.7 >= 0.05 GROUP BY 1),
 tr AS (SELECT id, {r4('max(s)')} AS score FROM (SELECT id, s FROM l0 UNION ALL SELECT id, s FROM l1 UNION ALL SELECT id, s FROM l2) GROUP BY 1)"""


@query(f"""{V.with_views('edges')}, {Q0}, {_TRAVERSE}, i AS (SELECT vec_id AS id, {r4(COS)} AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 30),
 j AS (SELECT i.id, i.score, coalesce(tr.score / (SELECT max(score) FROM tr), 0) AS g, len(list_intersect(['license', 'northern', 'market'], {_RERANK.format("d.text", _RERANK_STOP)})) / 3.0 AS c FROM i JOIN documents d ON d.doc_id = i.id LEFT JOIN tr ON tr.id = i.id)
 SELECT id, {r4('CASE WHEN g = 0 AND c = 0 THEN score ELSE 0.5 * score + 0.35 * g + 0.15 * c END')} AS score FROM j""")
def rerank_graph_content(spark, sf):
    items = R.vector_top_k(_vectors(spark, sf), first_vector(spark, sf), 30)
    texts = V.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return R.rerank(items.join(texts, "id"), G.traverse(unit_edges(spark, sf), _seeds(spark)), "license northern market")


# --- graph -------------------------------------------------------------------------------------------------------------
@query(f"""{V.with_views('edges')}, e AS (SELECT source_id AS src, target_id AS dst, weight / 100 AS w FROM edges WHERE weight / 100 >= 0.1), l0 AS (SELECT * FROM (VALUES (1, CAST(1.0 AS DOUBLE)), (7, CAST(0.8 AS DOUBLE))) t(id, s)),
 f1 AS (SELECT dst AS id, s * w AS s, row_number() OVER (PARTITION BY dst ORDER BY l0.id, w DESC) AS p FROM l0 JOIN e ON e.src = l0.id), l1 AS (SELECT id, s FROM f1 WHERE p = 1 AND id NOT IN (SELECT id FROM l0)),
 f2 AS (SELECT dst AS id, s * w AS s FROM l1 JOIN e ON e.src = l1.id) SELECT id, {r4('max(s)')} AS score, CAST(min(h) AS INTEGER) AS hops FROM (SELECT id, s, 1 AS h FROM f1 UNION ALL SELECT id, s, 2 FROM f2) GROUP BY 1""")
def traverse_directed(spark, sf):
    return G.traverse_directed(unit_edges(spark, sf), _seeds(spark))


@query(f"{V.with_views('edges')}, {_TRAVERSE} SELECT id, {r4('score * 0.8')} AS score FROM tr WHERE id NOT IN (1, 7) AND id % 5 <> 0")
def bfs_expand(spark, sf):
    known = spark.range(0, 1).select("id").where("id < 0").union(V.weighted_edges(spark, sf).where("source_id % 5 = 0").select("source_id")).union(V.weighted_edges(spark, sf).where("target_id % 5 = 0").select("target_id"))
    return G.expand_results(unit_edges(spark, sf), _seeds(spark), known)


@query("SELECT doc_id AS id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'market') THEN 'market' ELSE 'north' END AS term FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'market') OR contains(lower(text), 'north')")
def seed_lookup(spark, sf):
    return G.seeds_by_terms(V.memory_nodes(spark, sf), ["license", "market", "north"])


@query(f"{V.with_views('edges')} SELECT source_id, target_id, weight FROM edges WHERE (source_id = 5 AND target_id = 8) OR (source_id = 8 AND target_id = 5)")
def relationship(spark, sf):
    return G.relationship(V.weighted_edges(spark, sf), 5, 8).select("source_id", "target_id", "weight")


# --- weight dynamics ---------------------------------------------------------------------------------------------------
@query(f"{V.with_views('edges')}, x AS (SELECT *, weight + 1.5 * 100 * greatest(0, (100 - weight) / 100) AS raw FROM edges) SELECT source_id, target_id, {r4('least(raw, 100)')} AS weight, {r4('CASE WHEN raw > 100 THEN least(50, shield + raw - 100 + 1) ELSE shield END')} AS shield, activation_count + 1 AS activation_count FROM x")
def edge_reinforce(spark, sf):
    return W.reinforce_once(V.weighted_edges(spark, sf), 1.5).select("source_id", "target_id", "weight", "shield", "activation_count")


_IDLE = f"greatest({NOW} - last_event, 0) * 3600"
_T = f"CASE WHEN {_IDLE} <= 0 THEN 1.0 ELSE exp(-ln(2) * ({_IDLE}) * (CASE WHEN decay_rate > 0 THEN decay_rate / 0.01 ELSE 1 END) / 2592000.0) END"
_U = "(1 - 0.5 / (1 + activation_count))"
_C = f"least(greatest(pow({_T}, 0.7) * pow({_U}, 0.3), 0), 1)"


def _idle_edges(spark, sf) -> DataFrame:
    return unit_edges(spark, sf).withColumn("idle_seconds", F.greatest(NOW - F.col("last_event"), F.lit(0.0)) * 3600)


@query(f"{V.with_views('edges')} SELECT source_id, target_id, {r4(f'greatest(0.01, least(1, weight / 100 * {_C}))')} AS new_weight, greatest(0.01, least(1, weight / 100 * {_C})) < 0.05 AS prune FROM edges")
def edge_decay_combined(spark, sf):
    return W.decay_timed(_idle_edges(spark, sf)).select("source_id", "target_id", "new_weight", "prune")


@query(f"{V.with_views('edges')} SELECT source_id, target_id, {r4(f'weight / 100 * {_T}')} AS weight FROM edges")
def edge_decay_time(spark, sf):
    return _idle_edges(spark, sf).select("source_id", "target_id", S.round_to(F.col("weight") * S.time_decay(F.col("idle_seconds"), F.col("decay_rate"))).alias("weight"))


@query(f"{V.with_views('edges')} SELECT source_id, target_id, {r4(f'weight / 100 * {_U}')} AS weight FROM edges")
def edge_decay_usage(spark, sf):
    return unit_edges(spark, sf).select("source_id", "target_id", S.round_to(F.col("weight") * S.usage_decay(F.col("activation_count"))).alias("weight"))


@query(f"{V.with_views('edges')}, x AS (SELECT source_id, target_id, weight / 100 AS w, 0.05 / (weight / 100 * pow({_U}, 0.3)) AS share, CASE WHEN decay_rate > 0 THEN decay_rate / 0.01 ELSE 1 END AS speed FROM edges) SELECT source_id, target_id, round(CASE WHEN w <= 0.05 OR share >= 1 THEN 0.0 ELSE -ln(pow(share, 1 / 0.7)) * 2592000.0 / (speed * ln(2)) END, 1) AS seconds FROM x")
def decay_forecast(spark, sf):
    return unit_edges(spark, sf).select("source_id", "target_id", F.round(S.seconds_to(F.col("weight"), F.col("decay_rate"), F.col("activation_count")), 1).alias("seconds"))


@query(f"{V.with_views('edges')}, x AS (SELECT source_id, target_id, edge_type, CASE WHEN weight <= 80 AND edge_type IN ('about', 'caused') THEN weight * 0.9 ELSE weight END AS weight FROM edges) SELECT source_id, target_id, {r4('weight')} AS weight FROM x WHERE NOT (weight <= 80 AND edge_type IN ('about', 'caused') AND weight < 30)")
def edge_decay_factor(spark, sf):
    return W.decay_factor(V.weighted_edges(spark, sf), 0.9, 80, ["about", "caused"], 30).select("source_id", "target_id", S.round_to(F.col("weight")).alias("weight"))


@query(f"{V.with_views('edges')}, act AS (SELECT l_partkey AS id, greatest(0.1, 1 - exp(-count(*) / 5.0)) AS l FROM lineitem GROUP BY 1), x AS (SELECT source_id, target_id, shield, weight AS w, 0.1 * 100.0 * u.l * v.l * ((100 - weight) / 100) AS d FROM edges JOIN act u ON u.id = source_id JOIN act v ON v.id = target_id) SELECT source_id, target_id, {r4('d')} AS delta, {r4('least(w + d, 100)')} AS weight, {r4('CASE WHEN w + d > 100 THEN least(50, shield + w + d - 100 + 1) ELSE shield END')} AS shield FROM x")
def hebbian_shield(spark, sf):
    return W.hebbian_shield(V.weighted_edges(spark, sf), V.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).count())


@query(f"{V.with_views('edges')} SELECT source_id, target_id, {r4(f'(100 - (100 - weight) * 0.9) * pow(1 - 0.01, greatest({NOW} - last_event, 0))')} AS weight FROM edges")
def reinforce_then_decay(spark, sf):
    days = F.greatest(NOW - F.col("last_event"), F.lit(0.0))
    return V.weighted_edges(spark, sf).select("source_id", "target_id", S.round_to(S.reinforce(F.col("weight"), 0.1) * F.pow(F.lit(1 - 0.01), days)).alias("weight"))


_JAC = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) * 1.0 / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


@query(f"""{V.with_views('nodes')}, n AS (SELECT id, last_event, activation_count % 7 + 1 AS k, {_TERM_SET.format('frontmatter', _STOP)} AS t, string_split(keywords, ' ') AS e FROM nodes),
 p AS (SELECT a.id AS a, b.id AS b, abs(a.last_event - b.last_event) * 86400 AS s, a.t AS ta, b.t AS tb, a.k AS ka, b.k AS kb, a.e AS ea, b.e AS eb FROM n a JOIN n b ON b.id = a.id + 1),
 x AS (SELECT a, b, 0.2 * exp(-ln(2) * s / 604800.0) + 0.4 * {_JAC('ta', 'tb')} + 0.2 * least(1, least(ka, kb) / CAST(ka + kb - least(ka, kb) AS DOUBLE)) + 0.2 * {_JAC('ea', 'eb')} AS c FROM p) SELECT a, b, least(greatest(floor(c * 1e3 + 0.5) / 1e3, 0), 1) AS score FROM x WHERE floor(c * 1e3 + 0.5) / 1e3 >= 0.1""")
def edge_score(spark, sf):
    own = V.memory_nodes(spark, sf).select("id", "last_event", (F.col("activation_count") % 7 + 1).alias("k"), S.edge_terms(F.col("frontmatter")).alias("t"), F.split("keywords", " ").alias("e"))
    other = own.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("last_event").alias("last_b"), F.col("k").alias("only_b"), F.col("t").alias("terms_b"), F.col("e").alias("entities_b"))
    pairs = own.join(other, "id").select(F.col("id").alias("a"), "b", (F.abs(F.col("last_event") - F.col("last_b")) * 86400).alias("seconds"), F.col("t").alias("terms_a"), "terms_b", F.least("k", "only_b").alias("shared"), F.col("k").alias("only_a"), "only_b", F.col("e").alias("entities_a"), "entities_b")
    return W.edge_scores(pairs)


# --- entities and extraction -------------------------------------------------------------------------------------------
_ENT = f"""c AS (SELECT conv_id, turn, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '["''][^"'']+["'']', ' ', 'g') AS y FROM conversations),
 w AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(y, '[^\\w\\s-]', ' ', 'g'), '\\s+'), lambda s: s <> '') AS ws, list_concat(list_filter(list_transform(regexp_extract_all(x, '["'']([^"'']+)["'']', 1), lambda s: trim(s)), lambda s: s <> ''),
  regexp_extract_all(y, '\\b([A-Za-z][A-Za-z0-9]*(?:\\.[A-Za-z]+|\\+\\+))\\b', 1), regexp_extract_all(y, '\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b', 1)) AS f FROM c),
 ent AS (SELECT conv_id, turn, list_distinct(list_concat(f, list_filter(ws, lambda s: regexp_full_match(s, '[A-Z][a-zA-Z0-9]+')))) AS e, ws FROM w)"""


@query(f"""WITH {_ENT} SELECT conv_id, turn, array_to_string(list_sort(e), '|') AS entities, array_to_string(list_sort(list_filter(list_distinct(list_transform(list_filter(ws, lambda s: NOT regexp_full_match(s, '[A-Z][a-zA-Z0-9]+') AND len(s) >= 4 AND NOT list_contains([{_ENTITY_STOP}], lower(s))), lambda s: lower(s))), lambda s: NOT list_contains(list_transform(e, lambda z: lower(z)), s))), '|') AS key_terms FROM ent""")
def entity_extract(spark, sf):
    entities, terms = E.extract_entities(F.col("text"))
    joined = lambda c: F.array_join(F.array_sort(c), "|")
    return V.read(spark, sf, "conversations").select("conv_id", "turn", joined(entities).alias("entities"), joined(terms).alias("key_terms"))


_MENTION = f"{_ENT}, each AS (SELECT conv_id AS id, form, regexp_replace(lower(trim(form)), '\\s+', ' ', 'g') AS entity FROM (SELECT conv_id, unnest(e) AS form FROM ent)), m AS (SELECT entity, count(*) AS n, count(DISTINCT id) AS nodes FROM each WHERE entity <> '' GROUP BY 1), l AS (SELECT entity, form AS label FROM (SELECT entity, form, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, form) AS p FROM each GROUP BY 1, 2) WHERE p = 1)"


def _mentions(spark, sf) -> DataFrame:
    return E.mentions(V.read(spark, sf, "conversations").select(F.col("conv_id").alias("id"), E.extract_entities(F.col("text"))[0].alias("entities")))


@query(f"WITH {_MENTION} SELECT m.entity, n, nodes, label FROM m JOIN l ON l.entity = m.entity")
def entity_mentions(spark, sf):
    return _mentions(spark, sf)


@query(f"WITH {_MENTION}, hb AS (SELECT regexp_replace(lower(trim(split_part(text, ' ', 1))), '\\s+', ' ', 'g') AS entity, min(doc_id) AS hub_id FROM documents WHERE doc_id % 20 = 0 GROUP BY 1) SELECT m.entity, hb.hub_id, hb.hub_id IS NULL AS is_new FROM m LEFT JOIN hb ON hb.entity = m.entity")
def hub_link(spark, sf):
    hubs = V.memory_nodes(spark, sf).where("node_role = 'hub'").select("id", F.substring_index("content", " ", 1).alias("label"))
    return E.link_hubs(_mentions(spark, sf), hubs)


_NAMED = "len(trim(label)) >= 2 AND CASE WHEN regexp_matches(label, '[가-힯]') THEN len(regexp_extract_all(label, '[가-힯]')) >= 2 ELSE regexp_matches(trim(label), '^[A-Z]') OR regexp_matches(trim(label), '[.+#]') OR contains(trim(label), ' ') END"


@query(f"""WITH {_MENTION}, k AS (SELECT m.entity, n, nodes, label, {_NAMED} AS named FROM m JOIN l ON l.entity = m.entity)
 SELECT entity, label, CASE WHEN regexp_matches(label, '(?i)\\b(20[0-9][0-9]|q[1-4]|january|february|march|april|may|june|july|august|september|october|november|december)\\b') OR regexp_matches(label, '월|년|분기|기간') THEN 'temporal' WHEN named AND regexp_matches(label, '^[A-Z][a-z]') THEN 'entity'
 WHEN regexp_matches(split_part(label, ' ', 1), '^[A-Z][a-zA-Z0-9.+#]*$') THEN 'entity' WHEN NOT regexp_matches(label, '^[가-힯]{{2,4}}$') AND contains(label, ' ') AND label = lower(label) THEN 'topic' WHEN named THEN 'entity' ELSE 'topic' END AS hub_type,
 floor(least(1, 0.5 + CASE WHEN named THEN 0.2 ELSE 0 END + CASE WHEN nodes >= 3 THEN 0.15 WHEN nodes >= 2 THEN 0.1 ELSE 0 END + CASE WHEN n >= 3 THEN 0.1 ELSE 0 END) * 1e4 + 0.5) / 1e4 AS confidence FROM k ORDER BY confidence DESC, entity LIMIT 20""")
def hub_candidates(spark, sf):
    return E.hub_candidates(_mentions(spark, sf))


@query("""WITH r AS (SELECT event_id, 'Found: ```json' || chr(10) || '{"facts":[{"content":" ' || event_type || ' ","category":"' || CASE WHEN event_id % 3 = 0 THEN 'Technical' ELSE event_type END || '","confidence":' || CAST(event_id % 20 AS VARCHAR) || '},{"content":""}]}' || chr(10) || '```' AS raw FROM events)
 SELECT event_id, CAST(1 AS INTEGER) AS n, trim(json_extract_string(regexp_extract(raw, '(?s)\\{.*\\}'), '$.facts[0].content')) AS content, CASE WHEN event_id % 3 = 0 THEN 'technical' ELSE 'other' END AS category, CAST(least(event_id % 20, 1) AS DOUBLE) AS confidence FROM r""")
def json_parse_facts(spark, sf):
    category = F.when(F.col("event_id") % 3 == 0, "Technical").otherwise(F.col("event_type"))
    raw = F.concat(F.lit('Found: ```json\n{"facts":[{"content":" '), "event_type", F.lit(' ","category":"'), category, F.lit('","confidence":'), (F.col("event_id") % 20).cast("string"), F.lit('},{"content":""}]}\n```'))
    found = V.dealt(V.read(spark, sf, "events").select("event_id", "event_type")).select("event_id", X.facts(raw).alias("f"))
    return found.select("event_id", F.size("f").alias("n"), F.col("f")[0]["content"].alias("content"), F.col("f")[0]["category"].alias("category"), F.col("f")[0]["confidence"].alias("confidence"))


# --- records -----------------------------------------------------------------------------------------------------------
@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations")
def ingest_messages(spark, sf):
    rows = V.read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return K.ingest(rows.select("conv_id", F.transform("m", lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"))).alias("messages")))


@query("SELECT c.conv_id, m + row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS turn, role, text FROM conversations c JOIN (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) x ON x.conv_id = c.conv_id WHERE c.turn < 2")
def append_messages(spark, sf):
    rows = V.read(spark, sf, "conversations")
    return K.append(rows, rows.where("turn < 2").select("conv_id", F.col("turn").alias("seq"), "role", "text"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings")
def embedding_upsert(spark, sf):
    rows = V.read(spark, sf, "embeddings").select("vec_id", "label", F.lit(1).alias("version"))
    return K.merge_latest(rows, rows.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version")), ("vec_id",), "version")


@query(V.with_views("nodes") + "SELECT n.id, CASE WHEN l.quality = 1 THEN 'reviewed' ELSE n.frontmatter END AS frontmatter, n.summary FROM nodes n LEFT JOIN labels l ON l.doc_id = n.id")
def update_summaries(spark, sf):
    new = V.read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "reviewed").alias("frontmatter"))
    return K.update_fields(V.memory_nodes(spark, sf).select("id", "frontmatter", "summary"), new, "id", ("frontmatter",))


@query(V.with_views("nodes") + "SELECT id, node_type, place FROM nodes JOIN (VALUES (9, 0), (3, 1), (123, 2), (-5, 3)) t(i, place) ON i = id")
def get_by_ids(spark, sf):
    return K.get_by_ids(spark, V.memory_nodes(spark, sf).select("id", "node_type"), [9, 3, 123, -5])


@query(V.with_views("nodes") + "SELECT id, node_type, node_role, frontmatter, keywords, last_event, activation_count, lang, source, summary FROM nodes")
def project_depth(spark, sf):
    return K.at_depth(V.memory_nodes(spark, sf), 2)


@query("SELECT doc_id AS id, doc_id % 4 <> 0 AS stale FROM documents")
def embedding_stale(spark, sf):
    docs = V.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    known = docs.where("id % 2 = 0").select("id", F.sha2(F.when(F.col("id") % 4 == 0, F.coalesce("text", F.lit(""))).otherwise("old"), 256).alias("hash"))
    return K.stale(docs, known)


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY 1")
def merge_sets(spark, sf):
    rows = V.read(spark, sf, "events")
    kinds = lambda df: df.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    out = E.merge_sets(kinds(rows.where("event_id % 2 = 0")), kinds(rows.where("event_id % 2 = 1")), "user_id", "kinds")
    return out.select("user_id", F.array_join(F.array_sort("kinds"), ",").alias("kinds"))


@query(f"WITH t AS (SELECT c_custkey AS agent_id, c_mktsegment AS axis, c_acctbal / 10000 AS value FROM customer), u AS (SELECT agent_id, CASE WHEN agent_id % 4 = 0 THEN 'NEW' ELSE axis END AS axis, -value AS new FROM t WHERE agent_id % 2 = 0), j AS (SELECT coalesce(t.agent_id, u.agent_id) AS agent_id, coalesce(t.axis, u.axis) AS axis, value, new, greatest(-0.1, least(0.1, new - value)) AS s FROM t FULL JOIN u ON t.agent_id = u.agent_id AND t.axis = u.axis) SELECT agent_id, axis, {r4('CASE WHEN value IS NULL THEN new WHEN abs(coalesce(new - value, 0)) > 0.001 THEN greatest(-1, least(1, value + s)) ELSE value END')} AS value, value IS NULL OR abs(coalesce(new - value, 0)) > 0.001 AS changed FROM j")
def identity_evolve(spark, sf):
    traits = V.read(spark, sf, "customer").select(F.col("c_custkey").alias("agent_id"), F.col("c_mktsegment").alias("axis"), (F.col("c_acctbal") / 10000).alias("value"))
    new = traits.where("agent_id % 2 = 0").select("agent_id", F.when(F.col("agent_id") % 4 == 0, "NEW").otherwise(F.col("axis")).alias("axis"), (-F.col("value")).alias("value"))
    return K.evolve_identity(traits, new).withColumn("value", S.round_to(F.col("value")))


@query(f"{V.with_views('nodes')}, {_HYBRID}, x AS (SELECT score, hy.id, '- ' || n.frontmatter AS line FROM hy JOIN nodes n ON n.id = hy.id ORDER BY score DESC, hy.id LIMIT 15), y AS (SELECT *, sum(len(line) + 1) OVER (ORDER BY score DESC, id) AS s FROM x) SELECT coalesce(string_agg(line, chr(10) ORDER BY score DESC, id), '') AS text FROM y WHERE s - 1 <= 600")
def context_text(spark, sf):
    texts = V.memory_nodes(spark, sf).select("id", F.col("frontmatter").alias("content"))
    return K.context_text(_hybrid(spark, sf).join(texts, "id"), chars=600)


_SHARE = "SELECT id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS s FROM {}"


@query(f"""{V.with_views('nodes', 'edges')}, {_HYBRID}, {_TOP}, {_UND}, h10 AS (SELECT id, score FROM hy ORDER BY score DESC, id LIMIT 10), t1 AS (SELECT u.dst AS id, max(score * w * 0.7) AS s FROM h10 JOIN u ON u.src = h10.id WHERE w >= 0.1 AND score * w * 0.7 >= 0.05 GROUP BY 1), t2 AS (SELECT u.dst AS id, max(s * w * 0.7) AS s FROM t1 JOIN u ON u.src = t1.id WHERE w >= 0.1 AND s * w * 0.7 >= 0.05 GROUP BY 1),
 tr AS (SELECT id, {r4('max(s)')} AS s FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) GROUP BY 1), rc AS (SELECT id, {r4('s * 0.8')} AS score FROM tr WHERE id NOT IN (SELECT id FROM h10) ORDER BY score DESC, id LIMIT 50), g0 AS (SELECT id, score FROM h10 UNION ALL SELECT id, score FROM rc), v AS ({_SHARE.format('vt')}), g AS ({_SHARE.format('g0')}),
 m AS (SELECT coalesce(v.id, g.id) AS id, {r4('least(greatest(CASE WHEN g.s IS NULL THEN 0.6 * v.s WHEN v.s IS NULL THEN 0.4 * g.s ELSE 0.6 * v.s + 0.4 * g.s + 0.1 END, 0), 1)')} AS score, CASE WHEN v.id IS NULL OR g.id IS NULL THEN 1 ELSE 2 END AS n_sources FROM v FULL JOIN g ON v.id = g.id),
 fi AS (SELECT *, row_number() OVER (ORDER BY score DESC, n_sources DESC, id) AS p, row_number() OVER (ORDER BY score DESC, id) AS d FROM m WHERE score >= 0.05 QUALIFY p <= 20), dp AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS d5 FROM fi) SELECT id, score, n_sources, CASE WHEN id NOT IN (SELECT id FROM nodes) THEN 'L0' WHEN d5 <= 5 THEN 'L2' ELSE 'L1' END AS depth FROM dp""")
def recall(spark, sf):
    """Both paths: similar rows, and what the graph reaches from the text's best rows."""
    return R.recall(text_index(spark, sf), _vectors(spark, sf), unit_edges(spark, sf), TERMS, first_vector(spark, sf), NOW)


# --- streams -----------------------------------------------------------------------------------------------------------
_ALL = "s AS (SELECT user_id, session, epoch_us(min(ts)) AS started_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 21600000000 THEN 1 ELSE 0 END AS cut FROM events)) GROUP BY 1, 2)"


@query(f"WITH {_ALL} SELECT user_id, started_us, last_us, n, (SELECT max(epoch_us(ts)) FROM events) - last_us >= 21600000000 AS ended FROM s")
def session_stream(spark, sf):
    return T.merged_sessions(T.run_to_end(T.session_parts(T.event_stream(spark, sf), 21_600), "sessions"), 21_600)


@query("WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), w AS (SELECT user_id, p, event_id, epoch_us(ts) AS first, 1 AS n FROM r WHERE p = 1 UNION ALL SELECT r.user_id, r.p, r.event_id, CASE WHEN epoch_us(r.ts) >= w.first + 86400000000 THEN epoch_us(r.ts) ELSE w.first END, CASE WHEN epoch_us(r.ts) >= w.first + 86400000000 THEN 1 ELSE w.n + 1 END FROM w JOIN r ON r.user_id = w.user_id AND r.p = w.p + 1) SELECT event_id, user_id AS key, n <= 2 AS allowed, CAST(greatest(0, 2 - n) AS BIGINT) AS remaining FROM w")
def rate_limit(spark, sf):
    return T.rate_limit(V.read(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), "ts"), 2, 86_400)
