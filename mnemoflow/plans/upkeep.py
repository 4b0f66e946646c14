"""Registered queries of pages, totals, pair scores and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import records as K
from ..operators import retrieval as R
from ..operators import upkeep as U
from ..sources import views as V
from .catalog import _EFF, COS, effective_weight, first_vector, NOW, Q0, query, r4, unit_edges
from .more import _C, _IDLE, _JAC, _STOP, _T, _TERM_SET, _U, _idle_edges

_E = V.with_views("edges")


def _edges_page(order: str) -> str:
    return f"{_E} SELECT source_id, target_id, weight, last_event, (SELECT count(*) FROM x) AS total FROM x ORDER BY {order}, source_id, target_id LIMIT 30 OFFSET 10".replace("SELECT source_id, target_id, weight, last_event, (", ", x AS (SELECT source_id, target_id, weight, CASE WHEN source_id % 4 <> 0 THEN last_event END AS last_event, activation_count FROM edges WHERE edge_type = 'about') SELECT source_id, target_id, weight, last_event, (", 1)


def _page(spark, sf, order):
    edges = V.weighted_edges(spark, sf).where("edge_type = 'about'").select("source_id", "target_id", "weight", F.when(F.col("source_id") % 4 != 0, F.col("last_event")).alias("last_event"), "activation_count")
    return U.edges_page(edges, order, 10, 30).select("source_id", "target_id", "weight", "last_event", "total")


@query(_edges_page("weight DESC"))
def edges_by_weight(spark, sf):
    return _page(spark, sf, "weight_desc")


@query(_edges_page("weight"))
def edges_by_least_weight(spark, sf):
    return _page(spark, sf, "weight_asc")


@query(_edges_page("activation_count DESC"))
def edges_by_activation(spark, sf):
    return _page(spark, sf, "activation_desc")


@query(_edges_page("last_event DESC NULLS LAST"))
def edges_by_recency(spark, sf):
    return _page(spark, sf, "recent_first")


@query("WITH c AS (SELECT conv_id, conv_id * 7 % 50 AS updated_at, count(*) AS n FROM conversations WHERE conv_id % 3 = 1 GROUP BY 1) SELECT conv_id, updated_at, n, (SELECT count(*) FROM c) AS total FROM c ORDER BY updated_at DESC, conv_id LIMIT 10 OFFSET 5")
def conversations_page(spark, sf):
    """Conversations of one source (a third of them) by their last update."""
    own = V.read(spark, sf, "conversations").where("conv_id % 3 = 1").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("updated_at", F.col("conv_id") * 7 % 50)
    return U.page(own, F.col("updated_at").desc(), "conv_id", offset=5, limit=10).select("conv_id", "updated_at", "n", "total")


@query(f"{V.with_views('nodes')} SELECT 'all' AS by, '' AS value, count(*) AS n FROM nodes UNION ALL SELECT 'role', node_role, count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'type', coalesce(node_type, 'none'), count(*) FROM nodes GROUP BY 2")
def node_totals(spark, sf):
    return U.node_totals(V.memory_nodes(spark, sf).select("node_type", "node_role"))


_EFFECTIVE = f"CASE WHEN greatest({NOW} - last_event, 0) <= 0 OR decay_rate <= 0 THEN weight ELSE greatest(weight - greatest(greatest({NOW} - last_event, 0) * decay_rate - greatest(shield - 0.5 * greatest({NOW} - last_event, 0), 0), 0), 0) END"


@query(f"{_E}, x AS (SELECT edge_type, weight, shield, {_EFFECTIVE} AS eff FROM edges) SELECT edge_type, count(*) AS n, {r4('avg(weight)')} AS mean_weight, {r4('avg(eff)')} AS mean_effective, {r4('avg(shield)')} AS mean_shield, count(CASE WHEN eff <= 0 THEN 1 END) AS dead FROM x GROUP BY ROLLUP (edge_type)")
def edge_totals(spark, sf):
    return U.edge_totals(V.weighted_edges(spark, sf), NOW)


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, 1 AS created_at, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS updated_at FROM embeddings UNION ALL SELECT -vec_id - 1, label + 100, 2, 2 FROM embeddings WHERE vec_id % 5 = 0")
def embedding_upsert_kept(spark, sf):
    """The time of creation stays, that of the update does not."""
    v = V.read(spark, sf, "embeddings").select("vec_id", "label")
    old = v.withColumn("created_at", F.lit(1)).withColumn("updated_at", F.lit(1))
    again = v.where("vec_id % 3 = 0").union(v.where("vec_id % 5 = 0").select(-F.col("vec_id") - 1, "label"))
    return U.upsert_keeping(old, again.select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("created_at"), F.lit(2).alias("updated_at")), ("vec_id",))


_NODE = f"""{V.with_views('nodes')}, n AS (SELECT n.id, node_role AS role, last_event * 86400 AS s, activation_count % 7 + 1 AS k, {_TERM_SET.format('content', _STOP)} AS t, string_split(keywords, ' ') AS e, CASE WHEN n.id % 3 <> 0 THEN embedding END AS embedding FROM nodes n LEFT JOIN embeddings ON vec_id = n.id), f AS (SELECT * FROM n WHERE id = 5),
 x AS (SELECT f.id AS a, n.id AS b, CASE WHEN f.role <> n.role THEN 'about' ELSE 'related' END AS edge_type, 0.2 * exp(-ln(2) * abs(n.s - f.s) / 604800.0) + 0.4 * CASE WHEN n.embedding IS NOT NULL AND f.embedding IS NOT NULL THEN {COS.replace('embedding', 'n.embedding').replace('q AS', 'f.embedding AS')} ELSE {_JAC('f.t', 'n.t')} END
  + 0.2 * least(1, least(f.k, n.k) / CAST(f.k + n.k - least(f.k, n.k) AS DOUBLE)) + 0.2 * {_JAC('f.e', 'n.e')} AS c FROM n, f WHERE n.id <> f.id),
 sc AS (SELECT a, b, edge_type, least(greatest(floor(c * 1e3 + 0.5) / 1e3, 0), 1) AS score FROM x WHERE floor(c * 1e3 + 0.5) / 1e3 >= 0.3 ORDER BY score DESC, b LIMIT 20)"""


def _scored(spark, sf):
    vectors = V.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    nodes = V.memory_nodes(spark, sf).join(vectors, "id", "left").select("id", F.col("node_role").alias("role"), (F.col("last_event") * 86400).alias("seconds"), S.edge_terms(F.col("content")).alias("terms"), F.split("keywords", " ").alias("entities"), (F.col("activation_count") % 7 + 1).alias("uses"), F.when(F.col("id") % 3 != 0, F.col("embedding")).alias("embedding"))
    return U.score_against(nodes.where("id = 5"), nodes)


@query(f"{_NODE} SELECT a, b, score, edge_type, greatest(0.1, score) AS weight FROM sc")
def edge_score_against(spark, sf):
    """One node against all others, by vectors where both have one."""
    return _scored(spark, sf)


@query(f"{_NODE}, o AS (SELECT l_partkey AS a, l_suppkey AS b, max(l_discount) * 10 AS w FROM lineitem GROUP BY 1, 2) SELECT sc.a, sc.b, edge_type, {r4('least(1, coalesce(w, 0) + 0.1 * score * (1 - least(1, coalesce(w, 0))))')} AS weight, {r4('0.1 * score * (1 - least(1, coalesce(w, 0)))')} AS delta FROM sc LEFT JOIN o ON o.a = sc.a AND o.b = sc.b AND edge_type = 'related'")
def edge_reinforce_relevance(spark, sf):
    old = V.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id")).agg((F.max("l_discount") * 10).alias("weight")).withColumn("edge_type", F.lit("related"))
    return U.reinforce_by_relevance(old, _scored(spark, sf))


@query(f"{V.with_views('anchors')}, u AS (SELECT l_partkey AS id, count(*) AS n, max(l_orderkey) AS ua FROM lineitem GROUP BY 1) SELECT anchors.id, {r4('CASE WHEN n > 0 THEN 1 - (1 - current_weight) * pow(0.95, n) ELSE current_weight END')} AS current_weight, label + coalesce(n, 0) AS access_count, greatest(idle_seconds, ua) AS accessed_at FROM anchors LEFT JOIN u ON u.id = anchors.id")
def anchors_accessed(spark, sf):
    used = V.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").cast("double").alias("at"))
    anchors = V.anchors(spark, sf).select("id", "current_weight", F.col("label").alias("access_count"), F.col("idle_seconds").alias("accessed_at"))
    return U.access_anchors(anchors, used).withColumn("current_weight", S.round_to(F.col("current_weight")))


@query(f"""{V.with_views('anchors', 'edges')}, {Q0}, a AS (SELECT id, {r4(f'{COS} * greatest(0.01, least(1, current_weight * {_EFF}))')} AS score FROM anchors, q ORDER BY score DESC, id LIMIT 10),
 w AS (SELECT source_id, target_id, greatest(0.01, least(1, weight / 100 * {_C})) AS w FROM edges), e AS (SELECT w.*, a.score, row_number() OVER (PARTITION BY source_id ORDER BY w DESC, target_id) AS p FROM w JOIN a ON a.id = source_id WHERE w >= 0.1) SELECT target_id AS id, {r4('max(score * w)')} AS score FROM e WHERE p <= 5 GROUP BY 1 ORDER BY score DESC, id LIMIT 50""")
def anchor_expand_decayed(spark, sf):
    """Anchors by effective weight, edges by what their time and uses leave of them."""
    found = R.vector_top_k(V.anchors(spark, sf), first_vector(spark, sf), 10, 0.0, effective_weight())
    return U.expand_decayed(found, _idle_edges(spark, sf))


def _policy(factor: str) -> str:
    return f"{_E}, x AS (SELECT source_id, target_id, CASE WHEN decay_rate > 0 THEN greatest(0.01, least(1, weight / 100 * {factor})) ELSE weight / 100 END AS w, decay_rate FROM edges) SELECT source_id, target_id, {r4('w')} AS weight FROM x WHERE NOT (decay_rate > 0 AND w < 0.2)"


def _applied(spark, sf, policy):
    return U.apply_decay(_idle_edges(spark, sf), policy, 0.2).select("source_id", "target_id", S.round_to(F.col("weight")).alias("weight"))


@query(_policy(_T))
def decay_by_time(spark, sf):
    return _applied(spark, sf, "time")


@query(_policy(_U))
def decay_by_access(spark, sf):
    return _applied(spark, sf, "access")


@query(f"{_E}, x AS (SELECT source_id, target_id, decay_rate, weight / 100 AS w, CASE WHEN decay_rate > 0 THEN greatest(0.01, least(1, weight / 100 * {_C})) ELSE weight / 100 END AS n FROM edges) SELECT source_id, target_id, w AS weight, {r4('n')} AS new_weight, decay_rate > 0 AND n < 0.05 AS pruned FROM x")
def decay_dry_run(spark, sf):
    return U.apply_decay(_idle_edges(spark, sf), dry_run=True).select("source_id", "target_id", "weight", S.round_to(F.col("new_weight")).alias("new_weight"), "pruned")


@query(f"{_E}, g AS (SELECT *, CAST(unnest(range(0, 21)) * 40 AS DOUBLE) AS gap FROM edges), x AS (SELECT source_id, target_id, gap, last_event + gap AS ev, CASE WHEN gap <= 0 OR decay_rate <= 0 THEN weight ELSE greatest(weight - greatest(gap * decay_rate - greatest(shield - 0.5 * gap, 0), 0), 0) END AS w, CASE WHEN decay_rate <= 0 THEN shield ELSE greatest(shield - 0.5 * gap, 0) END AS s FROM g) SELECT source_id, target_id, {r4('arg_max(w, gap)')} AS final_weight, arg_max(w, gap) <= 0 AS dead, min(CASE WHEN w <= 0 THEN ev END) AS death_event, min(CASE WHEN s <= 0 THEN ev END) AS shield_event FROM x GROUP BY 1, 2")
def decay_simulation_events(spark, sf):
    return U.simulation_events(V.weighted_edges(spark, sf), 20, 40)


@query(V.with_views("nodes") + "SELECT id, node_type, node_role, frontmatter, keywords, last_event, activation_count, lang, source, summary, content, vec_id IS NOT NULL AS has_embedding FROM nodes LEFT JOIN embeddings ON vec_id = id")
def project_full(spark, sf):
    known = V.read(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.lit(True).alias("has")).distinct()
    nodes = K.at_depth(V.memory_nodes(spark, sf), 3).join(known, "id", "left")
    return nodes.withColumn("has_embedding", F.coalesce("has", F.lit(False))).drop("has")


@query(V.with_views("nodes") + "SELECT id, node_type, node_role, frontmatter, keywords, last_event, activation_count FROM nodes")
def project_reference(spark, sf):
    return K.at_depth(V.memory_nodes(spark, sf), 0)


@query(V.with_views("nodes") + "SELECT id, node_type, node_role, frontmatter, keywords, last_event, activation_count, lang, source FROM nodes")
def project_metadata(spark, sf):
    return K.at_depth(V.memory_nodes(spark, sf), 1)


@query(f"{V.with_views('nodes')} SELECT n.id, len(embedding) AS width FROM nodes n JOIN embeddings ON vec_id = n.id WHERE node_type = 'episodic' AND embedding IS NOT NULL")
def embeddings_of_type(spark, sf):
    nodes = V.memory_nodes(spark, sf).where("node_type = 'episodic'").select("id")
    return nodes.join(V.read(spark, sf, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("width")), "id")


@query(f"{_E} SELECT 'weighted' AS graph, source_id, target_id, weight FROM edges WHERE (source_id = 5 AND target_id < 10) OR (target_id = 5 AND source_id < 10) UNION ALL SELECT 'memory', source_id, target_id, weight / 100 FROM edges WHERE edge_type = 'about' AND ((source_id = 5 AND target_id < 10) OR (target_id = 5 AND source_id < 10))")
def relationship_of_graphs(spark, sf):
    """Edges between a node and some others, both ways, in both graphs."""
    near = ((F.col("source_id") == 5) & (F.col("target_id") < 10)) | ((F.col("target_id") == 5) & (F.col("source_id") < 10))
    own = lambda df, name: df.where(near).select(F.lit(name).alias("graph"), "source_id", "target_id", "weight")
    return own(V.weighted_edges(spark, sf), "weighted").union(own(unit_edges(spark, sf).where("edge_type = 'about'"), "memory"))


@query(f"{_E}, w AS (SELECT CASE WHEN source_id = 5 THEN target_id ELSE source_id END AS id, max(weight) AS weight FROM edges WHERE (source_id = 5 OR target_id = 5) AND edge_type <> 'about' GROUP BY 1), m AS (SELECT CASE WHEN source_id = 5 THEN target_id ELSE source_id END AS id, max(weight / 100) AS weight FROM edges WHERE (source_id = 5 OR target_id = 5) AND edge_type IN ('about', 'related') GROUP BY 1) SELECT id, weight, graph FROM (SELECT id, weight, 'weighted' AS graph FROM w UNION ALL SELECT id, weight, 'memory' FROM m WHERE id NOT IN (SELECT id FROM w)) ORDER BY weight DESC, id LIMIT 60")
def strongest_of_both(spark, sf):
    edges = V.weighted_edges(spark, sf)
    return G.strongest_connections(edges.where("edge_type <> 'about'"), unit_edges(spark, sf).where("edge_type in ('about', 'related')"), 5, 60)


_SAMPLE = f"{V.with_views('nodes', 'edges')}, h AS (SELECT id, node_role, activation_count FROM nodes WHERE node_role = 'hub' ORDER BY activation_count DESC, id LIMIT 20), s AS (SELECT * FROM h UNION ALL SELECT * FROM (SELECT id, node_role, activation_count FROM nodes WHERE node_role = 'leaf' ORDER BY activation_count DESC, id LIMIT (SELECT 80 - count(*) FROM h)))"


@query(f"{_SAMPLE} SELECT id, node_role, activation_count FROM s")
def graph_sample_nodes(spark, sf):
    return G.sample(V.memory_nodes(spark, sf), V.weighted_edges(spark, sf), 80, 20)[0]


@query(f"{_SAMPLE} SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM s) AND target_id IN (SELECT id FROM s)")
def graph_sample_edges(spark, sf):
    return G.sample(V.memory_nodes(spark, sf), V.weighted_edges(spark, sf), 80, 20)[1].select("source_id", "target_id")


@query("""WITH t AS (SELECT c_custkey AS agent_id, c_mktsegment AS axis, floor(c_acctbal) / 8192 AS value FROM customer), u AS (SELECT agent_id, CASE WHEN agent_id % 4 = 0 THEN 'NEW' ELSE axis END AS axis, -value AS new FROM t WHERE agent_id % 2 = 0), j AS (SELECT u.agent_id, u.axis, value, new, greatest(-0.1, least(0.1, new - value)) AS s FROM u LEFT JOIN t ON t.agent_id = u.agent_id AND t.axis = u.axis),
 c AS (SELECT agent_id, CASE WHEN value IS NULL THEN axis || ': new axis (' || printf('%.2f', new) || ')' ELSE axis || ': ' || printf('%.2f', value) || ' → ' || printf('%.2f', greatest(-1, least(1, value + s))) END AS change FROM j WHERE value IS NULL OR abs(new - value) > 0.001
  UNION ALL SELECT c_custkey, 'new principle: "keep ' || c_mktsegment || '"' FROM customer WHERE c_custkey % 5 >= 3) SELECT agent_id, agent_id % 3 + 1 AS version, change, 'cycle' AS triggered_by FROM c""")
def identity_changes(spark, sf):
    customers = V.read(spark, sf, "customer")
    traits = customers.select(F.col("c_custkey").alias("agent_id"), F.col("c_mktsegment").alias("axis"), (F.floor("c_acctbal") / 8192).alias("value"))
    new = traits.where("agent_id % 2 = 0").select("agent_id", F.when(F.col("agent_id") % 4 == 0, "NEW").otherwise(F.col("axis")).alias("axis"), (-F.col("value")).alias("value"))
    principles = customers.select(F.col("c_custkey").alias("agent_id"), F.concat(F.lit("keep "), "c_mktsegment").alias("principle"), F.slice(F.array(*map(F.lit, range(1, 5))), F.lit(1), (F.col("c_custkey") % 5).cast("int")).alias("sources"))
    versions = customers.select(F.col("c_custkey").alias("agent_id"), (F.col("c_custkey") % 3).alias("version"))
    return K.identity_history(traits, new, principles, versions, "cycle")


def _monitor(order: str) -> str:
    gap = f"greatest({NOW} - last_event, 0)"
    return f"{_E}, x AS (SELECT source_id, target_id, last_event, {r4(_EFFECTIVE)} AS effective_weight, {r4(f'CASE WHEN {gap} <= 0 OR decay_rate <= 0 THEN shield ELSE greatest(shield - 0.5 * {gap}, 0) END')} AS effective_shield FROM edges) SELECT source_id, target_id, effective_weight, effective_shield, last_event, (SELECT count(*) FROM x) AS total FROM x ORDER BY {order}, source_id, target_id LIMIT 25 OFFSET 50"


def _monitored(spark, sf, by, descending):
    return U.monitor(V.weighted_edges(spark, sf), NOW, by, descending, 50, 25).select("source_id", "target_id", "effective_weight", "effective_shield", "last_event", "total")


@query(_monitor("effective_weight DESC"))
def edge_monitor_effective(spark, sf):
    return _monitored(spark, sf, "effective_weight", True)


@query(_monitor("effective_shield DESC"))
def edge_monitor_shield(spark, sf):
    return _monitored(spark, sf, "effective_shield", True)


@query(_monitor("last_event"))
def edge_monitor_oldest(spark, sf):
    return _monitored(spark, sf, "last_event", False)
