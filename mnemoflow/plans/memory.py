"""Registered queries of facts, episodes, concepts, lookups, linking, summaries and jobs; they join those of catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import conversations as C
from ..operators import concepts as KC
from ..operators import entities as E
from ..operators import graph as G
from ..operators import memory as M
from ..operators import retrieval as R
from ..operators import weights as W
from ..sources import views as V
from .catalog import _bm25_sql, _EFF, _seeds, _W, by, COS, effective_weight, first_vector, Q0, query, r4, TERMS, text_index, unit_edges
from .more import _TRAVERSE, _vectors


# --- scans of conversations --------------------------------------------------------------------------------------------
@query("SELECT user_id, epoch_us(max(ts)) AS updated_us FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-15 00:00:00'")
def conversations_since(spark, sf):
    out = V.read(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return out.where(F.col("ts") >= F.to_timestamp(F.lit("2024-01-15 00:00:00"))).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_us"))


@query("SELECT id, id IN (SELECT conv_id FROM conversations) AS found FROM (VALUES (3), (42), (99999)) t(id)")
def conversation_exists(spark, sf):
    ids = spark.createDataFrame([(3,), (42,), (99999,)], "id long")
    known = V.read(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.lit(True).alias("found")).distinct()
    return ids.join(known, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


@query("SELECT turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn")
def conversation_messages(spark, sf):
    return V.read(spark, sf, "conversations").where("conv_id = 3").select("turn", "role", "text").orderBy("turn")


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id = 3 AND turn = 2")
def message_at(spark, sf):
    return V.read(spark, sf, "conversations").where("conv_id = 3 and turn = 2").select("conv_id", "turn", "text")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS query FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations WHERE role = 'user') WHERE p <= 2 GROUP BY 1")
def latest_user_query(spark, sf):
    last = C.latest(V.read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text"), 2)
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]), "\n").alias("query"))


# --- facts, episodes, concepts -----------------------------------------------------------------------------------------
_F = V.with_views("facts")


@query(f"{_F}, n AS (SELECT id + 1 AS id, category FROM facts WHERE id % 2 = 0) SELECT id, category FROM facts WHERE id % 5 <> 0 UNION ALL SELECT id, category FROM n WHERE id NOT IN (SELECT id FROM facts WHERE id % 5 <> 0)")
def facts_create(spark, sf):
    facts = V.facts(spark, sf).select("id", "category")
    return M.append_new(facts.where("id % 5 <> 0"), facts.where("id % 2 = 0").withColumn("id", F.col("id") + 1))


@query(f"{_F} SELECT id, turn, category FROM facts WHERE conv_id = 3 AND NOT superseded")
def facts_active(spark, sf):
    return V.facts(spark, sf).where("conv_id = 3 and not superseded").select("id", "turn", "category")


@query(f"{_F} SELECT id, superseded FROM facts WHERE conv_id = 3 AND turn = 3")
def facts_by_turn(spark, sf):
    return V.facts(spark, sf).where("conv_id = 3 and turn = 3").select("id", "superseded")


@query(f"{_F} SELECT id, conv_id FROM facts WHERE category = 'decision' AND NOT superseded")
def facts_by_category(spark, sf):
    return V.facts(spark, sf).where("category = 'decision' and not superseded").select("id", "conv_id")


@query(f"{_F} SELECT id, category FROM facts WHERE NOT superseded ORDER BY id DESC LIMIT 20")
def facts_recent(spark, sf):
    return by(V.facts(spark, sf).where("not superseded").select("id", "category"), "-id")


@query(f"{_F} SELECT id FROM facts WHERE summary IS NULL AND NOT superseded")
def facts_without_summary(spark, sf):
    return V.facts(spark, sf).where("summary is null and not superseded").select("id")


@query(f"{_F} SELECT id AS fact_id, 'semantic' AS node_type, 'leaf' AS node_role, regexp_extract(content, '{V.FIRST}') AS frontmatter, content AS summary FROM facts WHERE NOT superseded")
def facts_mirror(spark, sf):
    return V.facts(spark, sf).where("not superseded").select(F.col("id").alias("fact_id"), F.lit("semantic").alias("node_type"), F.lit("leaf").alias("node_role"), F.regexp_extract("content", V.FIRST, 0).alias("frontmatter"), F.col("content").alias("summary"))


_EP = V.with_views("episodes")


@query(f"{_EP} SELECT id, type, start_turn, end_turn FROM episodes WHERE conv_id = 3 ORDER BY start_turn")
def episodes_of_conversation(spark, sf):
    return V.episodes(spark, sf).where("conv_id = 3").select("id", "type", "start_turn", "end_turn").orderBy("start_turn")


@query(f"{_EP} SELECT type, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM episodes GROUP BY 1")
def episode_counts(spark, sf):
    return V.episodes(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


@query(f"{_EP} SELECT id, type FROM episodes WHERE conv_id <> 3")
def episodes_deleted(spark, sf):
    return V.episodes(spark, sf).where("conv_id <> 3").select("id", "type")


_CO = V.with_views("concepts")


@query(f"{_CO} SELECT id, name FROM concepts WHERE lower(name) = lower('CUSTOMER#000000007')")
def concept_find(spark, sf):
    return V.concepts(spark, sf).where(F.lower("name") == F.lower(F.lit("CUSTOMER#000000007"))).select("id", "name")


@query(f"{_CO} SELECT id, name, relevance FROM concepts ORDER BY relevance DESC, name LIMIT 20 OFFSET 10")
def concept_list(spark, sf):
    return V.concepts(spark, sf).select("id", "name", "relevance").orderBy(F.col("relevance").desc(), "name").offset(10).limit(20)


@query(f"{_CO} SELECT category, count(*) AS n FROM concepts GROUP BY 1")
def concept_histogram(spark, sf):
    return V.concepts(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


@query(f"{_CO} SELECT id, array_to_string(list_filter(sources, lambda s: s <> 3), ',') AS sources FROM concepts WHERE len(list_filter(sources, lambda s: s <> 3)) > 0")
def concepts_without_conversation(spark, sf):
    return M.without_source(V.concepts(spark, sf), 3).select("id", F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"))


@query("SELECT event_type AS key, count(*) + CASE WHEN event_type = 'view' THEN 100 ELSE 0 END AS value FROM events GROUP BY 1 UNION ALL SELECT 'other', 7")
def counters_increment(spark, sf):
    old = spark.createDataFrame([("view", 100), ("other", 7)], "key string, value long")
    return M.increment(old, V.read(spark, sf, "events").select(F.col("event_type").alias("key"), F.lit(1).cast("long").alias("value")))


@query("SELECT event_id, CASE WHEN event_type = 'signup' THEN props END AS input, CASE WHEN event_type IN ('purchase', 'click') THEN props END AS output, CASE WHEN event_type = 'error' THEN props END AS error FROM events")
def trace_split(spark, sf):
    status = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "click", "skipped").when(F.col("event_type") == "error", "error")
    return M.split_by_status(V.read(spark, sf, "events").select("event_id", status.alias("status"), F.col("props").alias("data"))).drop("status")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id % 2 = 0 ORDER BY event_id DESC LIMIT 25")
def trace_events_by_stage(spark, sf):
    return by(V.read(spark, sf, "events").where("event_type = 'error' and user_id % 2 = 0").select("event_id", "user_id"), "-event_id", k=25)


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def trace_by_status(spark, sf):
    return V.read(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query(f"{V.with_views('co')} SELECT event_id, len(nodes) AS n FROM co WHERE event_id % 2 = 0 UNION ALL SELECT event_id + 1000000, len(nodes) FROM co WHERE event_id % 2 = 1")
def coret_record(spark, sf):
    co = V.co_retrieval_events(spark, sf)
    both = M.append_new(co.where("event_id % 2 = 0"), co.where("event_id % 2 = 1").withColumn("event_id", F.col("event_id") + 1_000_000), "event_id")
    return both.select("event_id", F.size("nodes").cast("long").alias("n"))


@query(f"{V.with_views('anchors')} SELECT id, current_weight, {r4(f'greatest(0.01, least(1, current_weight * {_EFF}))')} AS effective_weight FROM anchors ORDER BY effective_weight DESC, id LIMIT 50")
def anchors_effective(spark, sf):
    return by(V.anchors(spark, sf).select("id", "current_weight", S.round_to(effective_weight()).alias("effective_weight")), "-effective_weight", "id", k=50)


# --- lookups and joins -------------------------------------------------------------------------------------------------
_IDS = "ids AS (SELECT unnest([1, 9, -3001, -3002, 1400, 123456789]) AS id)"
_THREE = V.with_views("facts", "episodes", "concepts")


def _ids(spark):
    return spark.createDataFrame([(i,) for i in (1, 9, -3001, -3002, 1400, 123456789)], "id long")


def _tables(spark, sf):
    return ("fact", V.facts(spark, sf)), ("episode", V.episodes(spark, sf)), ("concept", V.concepts(spark, sf))


_FIRST_OF = "CASE WHEN f.id IS NOT NULL THEN 'fact' WHEN e.id IS NOT NULL THEN 'episode' WHEN c.id IS NOT NULL THEN 'concept' END AS kind"


@query(f"{_THREE}, {_IDS} SELECT ids.id, {_FIRST_OF}, CASE WHEN f.id IS NOT NULL THEN f.content WHEN e.id IS NOT NULL THEN e.content ELSE c.content END AS content FROM ids LEFT JOIN facts f ON f.id = ids.id LEFT JOIN episodes e ON e.id = ids.id LEFT JOIN concepts c ON c.id = ids.id")
def polymorphic_lookup(spark, sf):
    return M.lookup(_ids(spark), *_tables(spark, sf))


@query(f"{_THREE}, {_IDS} SELECT ids.id, {_FIRST_OF} FROM ids LEFT JOIN facts f ON f.id = ids.id LEFT JOIN episodes e ON e.id = ids.id LEFT JOIN concepts c ON c.id = ids.id")
def leaf_types(spark, sf):
    return M.lookup(_ids(spark), *_tables(spark, sf)).select("id", "kind")


@query(f"{_THREE}, {_IDS}, k AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'concept' ELSE 'fact' END AS kind FROM ids) SELECT k.id, k.kind, CASE WHEN k.kind = 'fact' THEN f.content ELSE c.content END AS content FROM k LEFT JOIN facts f ON f.id = k.id LEFT JOIN concepts c ON c.id = k.id")
def typed_lookup(spark, sf):
    return M.typed_lookup(_ids(spark).withColumn("kind", F.when(F.col("id") % 2 == 0, "concept").otherwise("fact")), *_tables(spark, sf))


_CONTEXT = f"""{V.with_views('edges', 'facts')}, {Q0}, a AS (SELECT vec_id AS id, {r4(COS)} AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 10),
 ef AS (SELECT * FROM (SELECT e.source_id AS anchor_id, e.target_id AS fact_id, e.weight / 100 AS weight, a.score, row_number() OVER (PARTITION BY e.source_id ORDER BY e.weight DESC, e.target_id) AS p FROM edges e JOIN a ON a.id = e.source_id JOIN facts f ON f.id = e.target_id WHERE NOT superseded AND e.weight / 100 >= 0.2) WHERE p <= 5)"""


def _context(spark, sf):
    anchors = R.vector_top_k(_vectors(spark, sf), first_vector(spark, sf))
    return M.facts_of_anchors(anchors, unit_edges(spark, sf).select("source_id", "target_id", "weight"), V.facts(spark, sf), 0.2)


@query(f"{_CONTEXT} SELECT anchor_id, fact_id, weight, score FROM ef")
def edge_fact_join(spark, sf):
    return _context(spark, sf)


@query(f"{_CONTEXT} SELECT fact_id, array_to_string(list_sort(list_distinct(list(anchor_id))), ',') AS anchors, max(weight) AS weight, {r4('max(score * weight)')} AS score FROM ef GROUP BY 1")
def rerank_context(spark, sf):
    return M.rerank_context(_context(spark, sf)).withColumn("anchors", F.array_join(F.transform("anchors", lambda a: a.cast("string")), ","))


@query(f"{V.with_views('edges', 'nodes')} SELECT e.source_id, e.target_id, s.keywords AS source_label, t.keywords AS target_label FROM edges e LEFT JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes t ON t.id = e.target_id WHERE e.weight >= 90 AND (s.keywords LIKE '%en%' OR t.keywords LIKE '%en%')")
def edge_labels_like(spark, sf):
    edges = V.weighted_edges(spark, sf).where("weight >= 90").select("source_id", "target_id")
    label = lambda side: V.memory_nodes(spark, sf).select(F.col("id").alias(f"{side}_id"), F.col("keywords").alias(f"{side}_label"))
    both = edges.join(label("source"), "source_id", "left").join(label("target"), "target_id", "left")
    return both.where(F.col("source_label").contains("en") | F.col("target_label").contains("en"))


@query(f"{V.with_views('nodes')}, {_bm25_sql(TERMS, False, _W)} SELECT t.i AS id, rank FROM (VALUES (9), (3), (123), (-5)) t(i) LEFT JOIN hits ON hits.id = t.i")
def fts_match_one(spark, sf):
    ids = spark.createDataFrame([(i,) for i in (9, 3, 123, -5)], "id long")
    return ids.join(text_index(spark, sf).hits(TERMS), "id", "left")


@query(f"{V.with_views('nodes')}, {_bm25_sql(TERMS, False, _W)}, m AS (SELECT * FROM hits WHERE id % 10 = 3) SELECT id, {r4('CASE WHEN hi > lo THEN (hi - rank) / (hi - lo) ELSE 1.0 END')} AS fts_score FROM m, (SELECT min(rank) AS lo, max(rank) AS hi FROM m)")
def fts_match_batch(spark, sf):
    """Of wanted ids, those that match, by rank among themselves."""
    wanted = V.memory_nodes(spark, sf).where("id % 10 = 3").select("id")
    return R.normalized(text_index(spark, sf).hits(TERMS).join(wanted, "id", "left_semi"))


@query(f"{V.with_views('edges')}, {Q0}, {_TRAVERSE}, a AS (SELECT vec_id AS id, {r4(COS)} AS s FROM embeddings, q ORDER BY s DESC, id LIMIT 10) SELECT coalesce(a.id, tr.id) AS id, coalesce(a.s, tr.score) AS score FROM tr FULL JOIN a ON a.id = tr.id")
def graph_scores(spark, sf):
    """What the graph reaches, and anchors by their similarity, which goes first."""
    near = R.vector_top_k(_vectors(spark, sf), first_vector(spark, sf)).select("id", F.col("score").alias("near"))
    both = G.traverse(unit_edges(spark, sf), _seeds(spark)).select("id", "score").join(near, "id", "full_outer")
    return both.select("id", F.coalesce("near", "score").alias("score"))


@query(f"""{V.with_views('edges', 'nodes')}, u AS (SELECT source_id AS src, target_id AS dst, weight / 100 AS w FROM edges UNION ALL SELECT target_id, source_id, weight / 100 FROM edges), l0 AS (SELECT id, CAST(1.0 AS DOUBLE) AS s FROM nodes WHERE contains(lower(content), 'license') OR contains(lower(content), 'northern') ORDER BY id LIMIT 10),
 l1 AS (SELECT dst AS id, max(s * w * 0.7) AS s FROM l0 JOIN u ON u.src = l0.id WHERE w >= 0.1 AND s * w * 0.7 >= 0.05 GROUP BY 1), l2 AS (SELECT dst AS id, max(s * w * 0.7) AS s FROM l1 JOIN u ON u.src = l1.id WHERE w >= 0.1 AND s * w * 0.7 >= 0.05 GROUP BY 1)
 SELECT id, {r4('max(s)')} AS score FROM (SELECT id, s FROM l0 UNION ALL SELECT id, s FROM l1 UNION ALL SELECT id, s FROM l2) GROUP BY 1 ORDER BY score DESC, id LIMIT 20""")
def query_graph(spark, sf):
    """A question's terms to seed nodes, to what the graph reaches, to the best 20."""
    entities, terms = E.extract_entities(F.lit("is the license northern"))
    words = spark.range(1).select(F.concat(entities, terms).alias("t")).first()[0]
    seeds = G.seeds_by_terms(V.memory_nodes(spark, sf), words).orderBy("id").limit(10).select("id", F.lit(1.0).alias("score"))
    return by(G.traverse(unit_edges(spark, sf), seeds).select("id", "score"), "-score", "id")


# --- summaries ---------------------------------------------------------------------------------------------------------
@query(f"{V.with_views('anchors')}, f AS (SELECT current_weight AS w, {_EFF} AS f FROM anchors) SELECT count(*) AS processed, count(CASE WHEN f < 1 THEN 1 END) AS decayed, count(CASE WHEN w * f < 0.05 THEN 1 END) AS prune, {r4('coalesce(avg(f), 1)')} AS mean_factor FROM f")
def decay_summary(spark, sf):
    factor = S.combined_decay(S.time_decay(F.col("idle_seconds"), F.lit(0.02)), S.usage_decay(F.col("label")))
    return M.decay_summary(V.anchors(spark, sf).select(F.col("current_weight").alias("weight"), factor.alias("factor")))


_STEP = "greatest(weight - greatest(50 * decay_rate - greatest(shield - 25, 0), 0), 0)"


@query(f"""{V.with_views('edges')}, e AS (SELECT weight AS start, CASE WHEN decay_rate <= 0 THEN weight ELSE {_STEP} END AS final, CASE WHEN decay_rate > 0 AND weight > 0 AND g <= 1e6 THEN CAST(last_event + g AS BIGINT) END AS death FROM (SELECT *, ceil(CASE WHEN shield - 0.5 * ((weight + shield) / (decay_rate + 0.5)) > 0 THEN (weight + shield) / (decay_rate + 0.5) WHEN decay_rate > 0 THEN weight / decay_rate END - 1e-9) AS g FROM edges))
 SELECT count(death) AS dying, count(*) - count(death) AS surviving, {r4('avg(final)')} AS mean_final, floor(avg(CASE WHEN start > 0 THEN final / start * 100 ELSE 0 END) * 100 + 0.5) / 100 AS mean_retention, CASE WHEN 2 * count(death) >= count(*) THEN list_sort(list(death) FILTER (death IS NOT NULL))[count(death) // 2 + 1] END AS median_death FROM e""")
def simulation_summary(spark, sf):
    rate = F.when(F.col("decay_rate") > 0, F.col("decay_rate"))
    death = S.death_event(F.col("weight"), F.col("shield"), rate, F.col("last_event")).cast("long")
    ends = V.weighted_edges(spark, sf).select(F.col("weight").alias("start"), S.lazy_weight(F.col("weight"), F.col("shield"), F.col("decay_rate"), F.lit(50.0)).alias("final"), death.alias("death"))
    return M.simulation_summary(ends)


_ACT = "act AS (SELECT l_partkey AS id, greatest(0.1, 1 - exp(-count(*) / 5.0)) AS l FROM lineitem GROUP BY 1)"


@query(f"{V.with_views('edges')}, {_ACT}, d AS (SELECT source_id, target_id, weight / 100 AS w, 0.1 * u.l * v.l * (1 - least(1, greatest(0, weight / 100))) AS d FROM edges JOIN act u ON u.id = source_id JOIN act v ON v.id = target_id) SELECT count(*) AS n, count(CASE WHEN w = 0 THEN 1 END) AS new_edges, {r4('avg(floor(d * 1e4 + 0.5) / 1e4)')} AS mean_delta, {r4('max(d)')} AS max_delta FROM d")
def pair_batch_stats(spark, sf):
    pairs = unit_edges(spark, sf).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight")
    uses = V.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).count()
    done = W.hebbian(pairs, uses).join(pairs.withColumnRenamed("weight", "old"), ["a", "b"])
    return done.agg(F.count("*").alias("n"), F.count(F.when(F.col("old") == 0, 1)).alias("new_edges"), S.round_to(F.avg("delta")).alias("mean_delta"), S.round_to(F.max("delta")).alias("max_delta"))


@query(f"WITH c AS (SELECT u.vec_id AS a, v.vec_id AS b, {r4('greatest(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])), 0)')} AS score FROM embeddings u JOIN embeddings v ON v.vec_id <> u.vec_id WHERE u.vec_id % 50 = 0), k AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS p FROM c WHERE score >= 0.1) WHERE p <= 5) SELECT count(*) AS linked, {r4('avg(score)')} AS mean_score, max(score) AS best_score FROM k")
def scoring_batch_stats(spark, sf):
    return _scored(spark, sf).agg(F.count("*").alias("linked"), S.round_to(F.avg("score")).alias("mean_score"), F.max("score").alias("best_score"))


def _scored(spark, sf):
    """The five best partners of each anchor whose id is divisible by 50, against all."""
    vectors = _vectors(spark, sf)
    found = R.batch_top_k(vectors.withColumn("factor", F.lit(1.0)), vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id"), k=6, least=0.1)
    return M.best_connections(found.where("query_id <> id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score"))


@query(f"WITH c AS (SELECT u.vec_id AS a, v.vec_id AS b, {r4('greatest(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])), 0)')} AS score FROM embeddings u JOIN embeddings v ON v.vec_id <> u.vec_id WHERE u.vec_id % 50 = 0) SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS p FROM c WHERE score >= 0.1) WHERE p <= 5")
def best_connections(spark, sf):
    return _scored(spark, sf)


@query(f"{V.with_views('edges')} SELECT max(last_event) AS clock FROM edges")
def last_clock(spark, sf):
    return V.weighted_edges(spark, sf).agg(F.max("last_event").alias("clock"))


# --- keywords and labels -----------------------------------------------------------------------------------------------
@query("SELECT event_id, array_to_string(list_filter(string_split_regex(trim(event_type || '  ' || props), '\\s+'), lambda t: t <> ''), '|') AS tokens FROM events")
def keyword_tokens(spark, sf):
    return V.read(spark, sf, "events").select("event_id", F.array_join(S.keyword_tokens(F.concat("event_type", F.lit("  "), "props")), "|").alias("tokens"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([lower(lang), lower(source), 'en'], lambda t: t IS NOT NULL))), ' ') AS keywords FROM documents")
def keywords_merge(spark, sf):
    return V.read(spark, sf, "documents").select("doc_id", S.merge_keywords(F.col("lang"), F.col("source"), F.lit("EN ?!")).alias("keywords"))


@query("SELECT event_id, regexp_full_match(left(props, CAST(event_id % 4 AS INTEGER)), '[^\\p{L}\\p{N}]+') AS only FROM events")
def punctuation_only(spark, sf):
    return V.read(spark, sf, "events").select("event_id", S.punctuation_only(F.expr("left(props, int(event_id % 4))")).alias("only"))


@query("SELECT event_id, upper(left(event_type, 1)) || substr(event_type, 2) AS label FROM events")
def capitalize_entity(spark, sf):
    return V.read(spark, sf, "events").select("event_id", S.capitalized(F.col("event_type")).alias("label"))


# --- edge writes -------------------------------------------------------------------------------------------------------
_E = V.with_views("edges")


@query(f"{_E} SELECT source_id, target_id, least(100, greatest(0, weight * 2 - 50)) AS weight, least(greatest(shield * 20, 0), 50 + 50 * least(1, greatest(0, decay_rate * 5))) AS shield FROM edges")
def edge_create(spark, sf):
    return M.create_edges(V.weighted_edges(spark, sf).select("source_id", "target_id", (F.col("weight") * 2 - 50).alias("weight"), (F.col("shield") * 20).alias("shield"), (F.col("decay_rate") * 5).alias("importance")))


@query(f"{_E} SELECT source_id, target_id, CASE WHEN source_id % 2 = 0 THEN least(100, greatest(0, weight + 30)) ELSE weight END AS weight FROM edges")
def edge_weight_set(spark, sf):
    return V.weighted_edges(spark, sf).select("source_id", "target_id", F.when(F.col("source_id") % 2 == 0, S.clamp(F.col("weight") + 30, 0.0, 100.0)).otherwise(F.col("weight")).alias("weight"))


@query(f"{_E} SELECT source_id, target_id FROM edges WHERE source_id <> 5 AND target_id <> 5")
def edges_without_node(spark, sf):
    return V.weighted_edges(spark, sf).where("source_id <> 5 and target_id <> 5").select("source_id", "target_id")


@query(f"{V.with_views('anchors')} SELECT id, {r4('current_weight * 0.98')} AS weight FROM anchors WHERE current_weight * 0.98 >= 0.15")
def anchor_weight_decay(spark, sf):
    return V.anchors(spark, sf).withColumn("w", F.col("current_weight") * 0.98).where("w >= 0.15").select("id", S.round_to(F.col("w")).alias("weight"))


_PATHS = "CASE WHEN source_id % 10 = 3 AND target_id % 3 = 0 THEN {} ELSE {} END"


@query(f"{_E} SELECT source_id, target_id, {r4(_PATHS.format('least(1, weight / 100 + 0.1 * (1 - weight / 100))', 'weight / 100'))} AS weight, activation_count + {_PATHS.format('1', '0')} AS activation_count FROM edges")
def reinforce_unified(spark, sf):
    """Edges from matched anchors to results, on the unit scale."""
    return _reinforced(unit_edges(spark, sf), 1.0)


@query(f"{_E} SELECT source_id, target_id, {r4(_PATHS.format('least(100, weight + 0.1 * (100 - weight))', 'weight'))} AS weight, activation_count + {_PATHS.format('1', '0')} AS activation_count FROM edges")
def reinforce_dual(spark, sf):
    """The same on the scale of 100."""
    return _reinforced(V.weighted_edges(spark, sf), 100.0)


def _reinforced(edges, cap):
    ids = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"))
    out = M.reinforce_paths(edges, ids.where("id % 10 = 3"), ids.where("id % 3 = 0"), cap=cap)
    return out.select("source_id", "target_id", S.round_to(F.col("weight")).alias("weight"), "activation_count")


@query(f"{_E} SELECT source_id, target_id, {r4('CASE WHEN source_id = 5 OR target_id = 5 THEN weight + 0.1 * (100 - weight) ELSE weight END')} AS weight FROM edges")
def node_edges_reinforced(spark, sf):
    own = (F.col("source_id") == 5) | (F.col("target_id") == 5)
    return V.weighted_edges(spark, sf).select("source_id", "target_id", S.round_to(F.when(own, S.reinforce(F.col("weight"), 0.1)).otherwise(F.col("weight"))).alias("weight"))


@query(f"{V.with_views('nodes')} SELECT n.id, n.activation_count + coalesce(k, 0) AS activation_count, CASE WHEN k > 0 THEN 250.0 ELSE last_event END AS last_event FROM nodes n LEFT JOIN (SELECT l_partkey AS id, count(*) AS k FROM lineitem GROUP BY 1) u ON u.id = n.id")
def node_activations(spark, sf):
    nodes = V.memory_nodes(spark, sf).select("id", "activation_count", "last_event")
    return M.activate(nodes, V.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")), 250.0)


@query(f"{V.with_views('nodes')} SELECT id, CASE WHEN activation_count >= 40 THEN 'hub' ELSE node_role END AS node_role FROM nodes")
def promote_hubs(spark, sf):
    return V.memory_nodes(spark, sf).select("id", F.when(F.col("activation_count") >= 40, "hub").otherwise(F.col("node_role")).alias("node_role"))


# --- linking pipelines -------------------------------------------------------------------------------------------------
_HUB = "m AS (SELECT doc_id AS id, unnest([lang, source]) AS entity FROM documents), o AS (SELECT DISTINCT lower(trim(entity)) AS k, id FROM m WHERE entity IS NOT NULL AND trim(entity) <> ''), h AS (SELECT * FROM (VALUES (-1, 'EN'), (-2, 'src1')) t(id, label))"


def _made_hubs(spark, sf):
    mentioned = V.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array("lang", "source")).alias("entity")).where("entity is not null")
    return M.create_hubs(mentioned, spark.createDataFrame([(-1, "EN"), (-2, "src1")], "id long, label string"))


@query(f"WITH {_HUB} SELECT label FROM h UNION ALL SELECT DISTINCT upper(left(k, 1)) || substr(k, 2) FROM o WHERE k NOT IN (SELECT lower(label) FROM h)")
def hub_create(spark, sf):
    return _made_hubs(spark, sf)[0].select("label")


@query(f"WITH {_HUB} SELECT coalesce(h.label, upper(left(k, 1)) || substr(k, 2)) AS label, o.id AS target_id, CAST(0.5 AS DOUBLE) AS weight FROM o LEFT JOIN h ON lower(h.label) = k")
def hub_edges(spark, sf):
    hubs, edges = _made_hubs(spark, sf)
    return edges.join(hubs, F.col("source_id") == F.col("id")).select("label", "target_id", "weight")


@query(f"{_CO}, e AS (SELECT id % 20 AS conv_id, id, name, relevance FROM concepts WHERE relevance >= 0.4 AND id % 3 <> 0), t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY relevance DESC, lower(name)) AS p FROM e) SELECT conv_id, name, relevance FROM t WHERE p <= 20 AND id % 7 <> 0")
def concept_extract(spark, sf):
    c = V.concepts(spark, sf)
    found = c.where("id % 3 <> 0").select((F.col("id") % 20).alias("conv_id"), "name", "relevance", F.array("content").alias("aliases"))
    return KC.extract_concepts(found, c.where("id % 7 = 0")).select("conv_id", "name", "relevance")


# --- sessions and jobs -------------------------------------------------------------------------------------------------
_KINDS = ("episode", "concept", "decay")
_JOBS = "jobs AS (SELECT u.user_id, k.kind, CASE WHEN u.user_id % 3 = 0 THEN 'failed' WHEN u.user_id % 3 = 1 THEN 'pending' ELSE 'completed' END AS status, u.t AS created_us FROM (SELECT user_id, epoch_us(max(ts)) AS t FROM events GROUP BY 1) u, (SELECT unnest(['episode', 'concept', 'decay']) AS kind) k)"


def _jobs(spark, sf):
    """One job of each kind for every ended session."""
    status = F.when(F.col("user_id") % 3 == 0, "failed").when(F.col("user_id") % 3 == 1, "pending").otherwise("completed")
    ended = V.read(spark, sf, "events").groupBy("user_id").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("created_us"))
    return ended.select("user_id", F.explode(F.array(*map(F.lit, _KINDS))).alias("kind"), status.alias("status"), "created_us")


@query(f"WITH {_JOBS} SELECT user_id, kind, status FROM jobs")
def jobs_created(spark, sf):
    return _jobs(spark, sf).select("user_id", "kind", "status")


@query(f"WITH {_JOBS} SELECT user_id, kind, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status FROM jobs")
def jobs_retry(spark, sf):
    return _jobs(spark, sf).select("user_id", "kind", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status")).alias("status"))


@query(f"WITH {_JOBS} SELECT user_id, kind FROM jobs WHERE status = 'pending' ORDER BY created_us, user_id, kind LIMIT 10")
def jobs_pending(spark, sf):
    return by(_jobs(spark, sf).where("status = 'pending'"), "created_us", "user_id", "kind", k=10).select("user_id", "kind")


@query("SELECT user_id, count(*) AS n, CASE WHEN bool_or(event_type = 'signup') THEN 'explicit' WHEN (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) >= 1800000000 THEN 'timeout' ELSE 'open' END AS ending FROM events GROUP BY 1")
def session_end(spark, sf):
    """Ended by an own event, by the timeout, or open."""
    events = V.read(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    own = events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("us").alias("last"), F.bool_or(F.col("event_type") == "signup").alias("ended"))
    now = F.broadcast(events.agg(F.max("us").alias("now")))
    return own.join(now).select("user_id", "n", F.when(F.col("ended"), "explicit").when(F.col("now") - F.col("last") >= 1_800_000_000, "timeout").otherwise("open").alias("ending"))
