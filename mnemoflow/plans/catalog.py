"""Registered queries of the engine's operators over the given tables, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import conversations as C
from ..operators import fulltext as FT
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import weights as W
from ..sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = 250.0
TERMS = ["the", "licensed"]
R4 = "floor(({}) * 1e4 + 0.5) / 1e4"
Q0 = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
COS = "greatest(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 0)"
TOKENS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"


def r4(x: str) -> str:
    return R4.format(x)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Decay of an anchor by the time since its last access and by its uses.
_EFF = "least(greatest(pow(CASE WHEN idle_seconds <= 0 THEN 1.0 ELSE exp(-ln(2) * idle_seconds * (0.02 / 0.01) / 2592000.0) END, 0.7) * pow(1 - 0.5 / (1 + label), 0.3), 0), 1)"


def effective_weight() -> Column:
    return S.edge_decay(F.col("current_weight"), F.col("idle_seconds"), F.lit(0.02), F.col("label"))


def first_vector(spark, sf) -> list[float]:
    row = V.read(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [0.0]


def by(df: DataFrame, *keys: str, k: int = 20) -> DataFrame:
    """A page: descending keys by a leading minus."""
    return df.orderBy(*(F.col(c[1:]).desc() if c[0] == "-" else F.col(c) for c in keys)).limit(k)


# --- scans, projections, filters -------------------------------------------------------------------------------------
@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn BETWEEN 1 AND 4")
def messages_in_range(spark, sf):
    return V.read(spark, sf, "conversations").where("conv_id = 3 and turn between 1 and 4").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations) WHERE p <= 3")
def latest_messages(spark, sf):
    return C.latest(V.read(spark, sf, "conversations").select("conv_id", "turn", "role"), 3)


@query("SELECT conv_id, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY n DESC, conv_id LIMIT 20")
def conv_list_counts(spark, sf):
    return by(V.read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn")), "-n", "conv_id")


@query("SELECT conv_id, turn FROM conversations WHERE text ILIKE '%the%'")
def search_text_like(spark, sf):
    return V.read(spark, sf, "conversations").where(F.col("text").ilike("%the%")).select("conv_id", "turn")


@query("SELECT conv_id, turn AS old_turn, turn + 10 AS new_turn FROM (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1)")
def append_offset(spark, sf):
    return V.read(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("old_turn")).withColumn("new_turn", F.col("old_turn") + 10)


@query(V.with_views("nodes") + "SELECT id, node_type, node_role, frontmatter, activation_count FROM nodes WHERE (node_type IN ('semantic', 'episodic') OR node_type IS NULL) AND activation_count >= 10 ORDER BY activation_count DESC, id LIMIT 50")
def node_list_page(spark, sf):
    kept = V.memory_nodes(spark, sf).where((F.col("node_type").isin("semantic", "episodic") | F.col("node_type").isNull()) & (F.col("activation_count") >= 10))
    return by(kept.select("id", "node_type", "node_role", "frontmatter", "activation_count"), "-activation_count", "id", k=50)


@query(V.with_views("nodes") + "SELECT id, activation_count FROM nodes WHERE node_role = 'hub' ORDER BY activation_count DESC, id LIMIT 50")
def hubs(spark, sf):
    return by(V.memory_nodes(spark, sf).where("node_role = 'hub'").select("id", "activation_count"), "-activation_count", "id", k=50)


@query(V.with_views("nodes") + "SELECT id, keywords FROM nodes")
def keywords_normalize(spark, sf):
    return V.memory_nodes(spark, sf).select("id", "keywords")


@query(V.with_views("edges") + "SELECT source_id, target_id, weight, edge_type FROM edges WHERE weight >= 95 AND edge_type IN ('about', 'caused')")
def edges_filtered(spark, sf):
    return V.weighted_edges(spark, sf).where((F.col("weight") >= 95) & F.col("edge_type").isin("about", "caused")).select("source_id", "target_id", "weight", "edge_type")


@query(V.with_views("edges") + "SELECT source_id, target_id, weight, edge_type FROM edges ORDER BY weight DESC, source_id, target_id LIMIT 25 OFFSET 25")
def edge_monitor(spark, sf):
    order = (F.col("weight").desc(), "source_id", "target_id")
    return V.weighted_edges(spark, sf).select("source_id", "target_id", "weight", "edge_type").orderBy(*order).offset(25).limit(25)


@query(V.with_views("anchors") + "SELECT id, current_weight FROM anchors WHERE current_weight BETWEEN 0.3 AND 0.6")
def anchors_weight_range(spark, sf):
    return V.anchors(spark, sf).where(F.col("current_weight").between(0.3, 0.6)).select("id", "current_weight")


@query("SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN FALSE ELSE TRUE END AS superseded FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) s ON s.doc_id = d.doc_id")
def supersede(spark, sf):
    old = V.read(spark, sf, "labels").where("quality = 0").select("doc_id").distinct().withColumn("gone", F.lit(True))
    return V.read(spark, sf, "documents").select("doc_id").join(old, "doc_id", "left").select("doc_id", F.coalesce("gone", F.lit(False)).alias("superseded"))


# --- vectors ---------------------------------------------------------------------------------------------------------
@query(f"WITH {Q0} SELECT vec_id AS id, {r4(COS)} AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 10")
def vec_topk(spark, sf):
    return R.vector_top_k(V.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), first_vector(spark, sf))


@query(f"WITH {Q0} SELECT vec_id, {r4('list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[]))')} AS score FROM embeddings, q")
def vec_raw_cosine(spark, sf):
    q = F.array(*map(F.lit, map(float, first_vector(spark, sf))))
    return V.read(spark, sf, "embeddings").select("vec_id", S.round_to(S.cosine_raw(F.col("embedding"), q)).alias("score"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings")
def l2_norms(spark, sf):
    return V.read(spark, sf, "embeddings").select("vec_id", F.round(S.l2_norm(F.col("embedding")), 6).alias("norm"))


@query(f"{V.with_views('anchors')}, {Q0} SELECT id, {r4(f'{COS} * greatest(0.01, least(1, current_weight * {_EFF}))')} AS score FROM anchors, q WHERE {COS} >= 0.3 ORDER BY score DESC, id LIMIT 10")
def anchor_search(spark, sf):
    return R.vector_top_k(V.anchors(spark, sf), first_vector(spark, sf), 10, 0.3, effective_weight())


@query(f"""{V.with_views('anchors', 'edges')}, {Q0},
 a AS (SELECT id, {r4(f'{COS} * current_weight')} AS score FROM anchors, q ORDER BY score DESC, id LIMIT 10),
 e AS (SELECT e.*, a.score, row_number() OVER (PARTITION BY source_id ORDER BY e.weight DESC, target_id) AS p FROM (SELECT source_id, target_id, weight / 100 AS weight FROM edges WHERE weight / 100 >= 0.1) e JOIN a ON a.id = e.source_id)
 SELECT target_id AS id, {r4('max(score * weight)')} AS score FROM e WHERE p <= 5 GROUP BY 1 ORDER BY score DESC, id LIMIT 50""")
def anchor_expand(spark, sf):
    found = R.vector_top_k(V.anchors(spark, sf), first_vector(spark, sf), 10, 0.0, F.col("current_weight"))
    return G.expand(found, unit_edges(spark, sf))


# --- full text and hybrid --------------------------------------------------------------------------------------------
def _bm25_sql(terms: list[str], every: bool, weights: dict[str, float], where: str = "TRUE", limit: int | None = None, first_in: str | None = None) -> str:
    toks = {c: TOKENS.format(f"coalesce({c}, '')") for c in weights}
    count = lambda c, t: f"len(list_filter({toks[c]}, lambda x: x = '{t}'))"
    cols = ", ".join(f"{' + '.join(f'{w} * {count(c, t)}' for c, w in weights.items() if i or first_in in (None, c))} AS tf{i}" for i, t in enumerate(terms))
    length = " + ".join(f"len({x})" for x in toks.values())
    n = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(terms)))
    idf = lambda i: f"CASE WHEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - n{i} + 0.5) / (n{i} + 0.5)) END"
    rank = " - ".join(["0.0", *(f"({idf(i)}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / avgdl))" for i in range(len(terms)))])
    hit = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""t AS (SELECT *, {length} AS length, {cols} FROM nodes), s AS (SELECT count(*) AS N, avg(length) AS avgdl, {n} FROM t),
 hits AS (SELECT id, floor(({rank}) * 1e6 + 0.5) / 1e6 AS rank FROM t, s WHERE ({hit}) AND {where}{f' ORDER BY rank, id LIMIT {limit}' if limit else ''})"""


_W = FT.COLUMN_WEIGHTS
_INDEXES: dict[tuple, FT.Postings] = {}


def text_index(spark, sf) -> FT.Postings:
    """The postings of the nodes' texts; they are built once for a state of the table's files."""
    seen = V.read(spark, sf, "documents").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    # Sums over rows, which need no shuffle of them: they change with the files and with the rows of each.
    state = seen.agg(F.count("*"), F.max("file_modification_time"), F.sum("file_size"), F.sum(F.hash("file_path", "file_modification_time").cast("long"))).first()
    key = (spark.sparkContext.applicationId, sf, *state)
    if key not in _INDEXES:
        _INDEXES[key] = FT.Postings.build(V.memory_nodes(spark, sf))
    return _INDEXES[key]


@query(f"{V.with_views('nodes')}, {_bm25_sql(TERMS, False, _W, limit=50)} SELECT id, rank FROM hits")
def fts_search(spark, sf):
    return text_index(spark, sf).best(TERMS, 50)


@query(f"{V.with_views('nodes')}, {_bm25_sql(TERMS, True, _W, limit=50)} SELECT id, rank FROM hits")
def fts_and(spark, sf):
    return text_index(spark, sf).best(TERMS, 50, every=True)


@query(f"{V.with_views('nodes')}, {_bm25_sql(['en', 'src1'], False, {'keywords': 10.0}, limit=50)} SELECT id, rank FROM hits")
def fts_keyword(spark, sf):
    return text_index(spark, sf).best(["en", "src1"], 50, weights={"keywords": 10.0})


_KEEP = "(node_type IN ('semantic', 'procedural') OR node_type IS NULL) AND node_role = 'leaf'"


@query(f"{V.with_views('nodes')}, {_bm25_sql(TERMS, False, _W, _KEEP, 50)} SELECT id, rank FROM hits")
def fts_filtered(spark, sf):
    return text_index(spark, sf).best(TERMS, 50, keep=F.expr(_KEEP))


@query(f"{V.with_views('nodes')}, {_bm25_sql(TERMS, False, _W)} SELECT count(*) AS n FROM hits")
def fts_count(spark, sf):
    return text_index(spark, sf).hits(TERMS).agg(F.count("*").alias("n"))


_NORM = r4("CASE WHEN hi > lo THEN (hi - rank) / (hi - lo) ELSE 1.0 END")
_FTS200 = f"{_bm25_sql(TERMS, False, _W, limit=200)}, f AS (SELECT id, {_NORM} AS fts_score FROM hits, (SELECT min(rank) AS lo, max(rank) AS hi FROM hits))"


@query(f"{V.with_views('nodes')}, {_FTS200} SELECT id, fts_score FROM f")
def fts_normalized(spark, sf):
    return R.normalized(text_index(spark, sf).best(TERMS, 200))


_HYBRID = f"""{_FTS200}, {Q0}, h AS (SELECT f.id, {r4(f'(0.3 * fts_score + 0.7 * coalesce({COS}, 0)) * pow(2, -greatest(0, {NOW} - last_event) / 50)')} AS score
 FROM f JOIN nodes n ON n.id = f.id LEFT JOIN embeddings e ON e.vec_id = f.id, q), hy AS (SELECT id, score FROM h WHERE score >= 0.01 ORDER BY score DESC, id LIMIT 20)"""


def _hybrid(spark, sf):
    vectors = V.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.hybrid(text_index(spark, sf), vectors, TERMS, first_vector(spark, sf), NOW, least=0.01)


@query(f"{V.with_views('nodes')}, {_HYBRID} SELECT id, score FROM hy")
def hybrid_search(spark, sf):
    return _hybrid(spark, sf)


_HUBS = f"{_bm25_sql(TERMS, False, _W, 'node_role = ' + chr(39) + 'hub' + chr(39), 50)}, f AS (SELECT id, {_NORM} AS fts_score FROM hits, (SELECT min(rank) AS lo, max(rank) AS hi FROM hits))"


def _hub_sql(least: float, hubs: str = _HUBS) -> str:
    return f"""{V.with_views('nodes')}, {hubs}, {Q0}, c AS (SELECT n.id, fts_score, {COS} AS near FROM nodes n JOIN embeddings e ON e.vec_id = n.id LEFT JOIN f ON f.id = n.id, q WHERE node_role = 'hub'),
 k AS (SELECT count(*) AS n FROM f) SELECT c.id, {r4('0.2 * coalesce(fts_score, 0) + 0.8 * near')} AS score FROM c, k WHERE near >= {least} AND (k.n < 3 OR fts_score IS NOT NULL) ORDER BY score DESC, c.id LIMIT 5"""


@query(_hub_sql(0.85))
def hub_match(spark, sf):
    vectors = V.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.match_hubs(text_index(spark, sf), vectors, TERMS, first_vector(spark, sf))


@query(_hub_sql(0.1))
def hub_match_wide(spark, sf):
    """The same with a low threshold, under which the tables' vectors match."""
    vectors = V.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.match_hubs(text_index(spark, sf), vectors, TERMS, first_vector(spark, sf), least=0.1)


_FEW_TERMS = ["src3", "en"]


@query(_hub_sql(0.1, f"{_bm25_sql(_FEW_TERMS, True, _W, 'node_role = ' + chr(39) + 'hub' + chr(39), 50)}, f AS (SELECT id, {_NORM} AS fts_score FROM hits, (SELECT min(rank) AS lo, max(rank) AS hi FROM hits))"))
def hub_match_few(spark, sf):
    """The text hits fewer than three hubs, so that all hubs are compared."""
    vectors = V.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.match_hubs(text_index(spark, sf), vectors, _FEW_TERMS, first_vector(spark, sf), least=0.1, every=True)


_FIRST = _bm25_sql(["en", "the"], False, _W, limit=50, first_in="keywords")


@query(f"{V.with_views('nodes')}, {_FIRST} SELECT id, rank FROM hits")
def fts_first_scoped(spark, sf):
    """A column before a list of terms holds for the first of them alone."""
    return text_index(spark, sf).best(["en", "the"], 50, first_in="keywords")


@query(f"{V.with_views('nodes')}, {_bm25_sql(TERMS, False, _W, limit=50)} SELECT id, rank FROM hits")
def fts_scan(spark, sf):
    """The same as fts_search, without postings."""
    return FT.Scan(V.memory_nodes(spark, sf)).best(TERMS, 50)


@query("SELECT conv_id, turn, CASE WHEN len(t) > 0 THEN array_to_string(list_transform(t, lambda x: '\"' || replace(x, '\"', '\"\"') || '\"'), ' AND ') END AS expression FROM (SELECT conv_id, turn, list_filter(string_split_regex(trim(lower(text)), '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]')) AS t FROM conversations)")
def fts_match_expression(spark, sf):
    return V.read(spark, sf, "conversations").select("conv_id", "turn", S.match_expression(F.col("text"), every=True).alias("expression"))


_TOP = f"vt AS (SELECT vec_id AS id, {r4(COS)} AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 30)"


def _merge_sql(minmax: bool) -> str:
    share = lambda t: f"SELECT id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS s FROM {t}" if minmax else f"SELECT id, score AS s FROM {t}"
    return f"""{V.with_views('nodes')}, {_HYBRID}, {_TOP}, v AS ({share('vt')}), g AS ({share('hy')}),
 m AS (SELECT coalesce(v.id, g.id) AS id, {r4('least(greatest(CASE WHEN g.s IS NULL THEN 0.6 * v.s WHEN v.s IS NULL THEN 0.4 * g.s ELSE 0.6 * v.s + 0.4 * g.s + 0.1 END, 0), 1)')} AS score,
 CASE WHEN v.id IS NULL OR g.id IS NULL THEN 1 ELSE 2 END AS n_sources FROM v FULL JOIN g ON v.id = g.id) SELECT id, score, n_sources FROM m WHERE score >= 0.05 ORDER BY score DESC, n_sources DESC, id LIMIT 20"""


def _merged(spark, sf, minmax):
    vectors = V.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.merge_paths(R.vector_top_k(vectors, first_vector(spark, sf), 30), _hybrid(spark, sf), minmax=minmax)


@query(_merge_sql(True))
def merge_minmax(spark, sf):
    return _merged(spark, sf, True)


@query(_merge_sql(False))
def merge_none(spark, sf):
    return _merged(spark, sf, False)


@query(f"{V.with_views('nodes')}, {_HYBRID} SELECT hy.id, {r4('CASE WHEN e.label IS NULL THEN score ELSE 0.7 * (e.label / 10.0) + 0.3 * score END')} AS score FROM hy LEFT JOIN (SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 0) e ON e.vec_id = hy.id WHERE e.label IS NULL OR e.label / 10.0 >= 0.1")
def llm_blend(spark, sf):
    given = V.read(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), (F.col("label") / 10.0).alias("relevance"))
    return R.blend(_hybrid(spark, sf), given)


@query(f"{V.with_views('nodes')}, {Q0}, {_TOP}, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS p FROM vt) SELECT p.id, CASE WHEN n.id IS NULL THEN 'L0' WHEN p <= 5 THEN 'L2' ELSE 'L1' END AS depth FROM p LEFT JOIN (SELECT id FROM nodes WHERE node_type IS NOT NULL) n ON n.id = p.id")
def depth_enrich(spark, sf):
    vectors = V.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return R.with_depth(R.vector_top_k(vectors, first_vector(spark, sf), 30), V.memory_nodes(spark, sf).where("node_type is not null"))


# --- graph -----------------------------------------------------------------------------------------------------------
def unit_edges(spark, sf) -> DataFrame:
    return V.weighted_edges(spark, sf).withColumn("weight", F.col("weight") / 100)


def _seeds(spark) -> DataFrame:
    return spark.createDataFrame([(1, 1.0), (7, 0.8)], "id long, score double")


_UND = "u AS (SELECT src, dst, max(w) AS w FROM (SELECT source_id AS src, target_id AS dst, weight / 100 AS w FROM edges UNION ALL SELECT target_id, source_id, weight / 100 FROM edges) GROUP BY ALL)"


@query(f"""{V.with_views('edges')}, {_UND}, l0 AS (SELECT * FROM (VALUES (1, CAST(1.0 AS DOUBLE)), (7, CAST(0.8 AS DOUBLE))) t(id, s)),
 l1 AS (SELECT dst AS id, max(s * w * 0.7) AS s FROM l0 JOIN u ON u.src = l0.id WHERE w >= 0.1 AND s * w * 0.7 >= 0.05 GROUP BY 1),
 l2 AS (SELECT dst AS id, max(s * w * 0.7) AS s FROM l1 JOIN u ON u.src = l1.id WHERE w >= 0.1 AND s * w * 0.7 >= 0.05 GROUP BY 1),
 a AS (SELECT id, s, 0 AS h FROM l0 UNION ALL SELECT id, s, 1 FROM l1 UNION ALL SELECT id, s, 2 FROM l2), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, h) AS p FROM a)
 SELECT id, {r4('s')} AS score, h AS hops FROM b WHERE p = 1""")
def traverse_undirected(spark, sf):
    return G.traverse(unit_edges(spark, sf), _seeds(spark))


@query(f"""{V.with_views('edges', recursive=True)}, {_UND}, r AS (SELECT * FROM (VALUES (1, 0), (7, 0)) t(id, depth) UNION SELECT u.dst, depth + 1 FROM r JOIN u ON u.src = r.id WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY 1""")
def subgraph(spark, sf):
    return G.reach(V.weighted_edges(spark, sf), _seeds(spark), 2)


@query(f"{V.with_views('edges')} SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1")
def degree(spark, sf):
    return G.degree(V.weighted_edges(spark, sf))


@query(f"{V.with_views('edges')} SELECT CASE WHEN source_id = 5 THEN target_id ELSE source_id END AS id, max(weight) AS weight FROM edges WHERE source_id = 5 OR target_id = 5 GROUP BY 1")
def neighbors(spark, sf):
    return G.neighbors(V.weighted_edges(spark, sf), 5)


@query(f"{V.with_views('edges')} SELECT source_id, target_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS p FROM edges) WHERE p <= 3")
def strongest(spark, sf):
    return G.best_per_source(V.weighted_edges(spark, sf), 3).select("source_id", "target_id", "weight")


@query(f"{V.with_views('edges')}, s AS (SELECT id FROM (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY 1) ORDER BY n DESC, id LIMIT 60) SELECT source_id, target_id FROM edges WHERE source_id IN (SELECT id FROM s) AND target_id IN (SELECT id FROM s)")
def graph_sample(spark, sf):
    edges = V.weighted_edges(spark, sf)
    return G.induced(edges, by(G.degree(edges), "-degree", "id", k=60)).select("source_id", "target_id")


@query(f"{V.with_views('edges')} SELECT source_id, target_id, weight, CASE WHEN source_id = 5 THEN 'out' ELSE 'in' END AS direction FROM edges WHERE source_id = 5 OR target_id = 5 ORDER BY weight DESC, source_id, target_id LIMIT 20")
def children_page(spark, sf):
    own = V.weighted_edges(spark, sf).where("source_id = 5 or target_id = 5")
    return by(own.select("source_id", "target_id", "weight", F.when(F.col("source_id") == 5, "out").otherwise("in").alias("direction")), "-weight", "source_id", "target_id")


# --- weight dynamics -------------------------------------------------------------------------------------------------
_GAP = f"greatest({NOW} - last_event, 0)"


@query(f"{V.with_views('edges')} SELECT source_id, target_id, {r4(f'CASE WHEN {_GAP} <= 0 OR decay_rate <= 0 THEN weight ELSE greatest(weight - greatest({_GAP} * decay_rate - greatest(shield - 0.5 * {_GAP}, 0), 0), 0) END')} AS weight, {r4(f'CASE WHEN {_GAP} <= 0 OR decay_rate <= 0 THEN shield ELSE greatest(shield - 0.5 * {_GAP}, 0) END')} AS shield FROM edges")
def edge_decay_lazy(spark, sf):
    return W.decay_lazy(V.weighted_edges(spark, sf), NOW).select("source_id", "target_id", "weight", "shield")


@query(f"{V.with_views('edges')} SELECT source_id, target_id, {r4(f'greatest(weight - greatest({_GAP} * decay_rate - shield, 0), 0)')} AS weight, {r4(f'greatest(shield - {_GAP} * decay_rate, 0)')} AS shield FROM edges")
def edge_decay_absorb(spark, sf):
    return W.decay_absorb(V.weighted_edges(spark, sf), NOW).select("source_id", "target_id", "weight", "shield")


@query(f"{V.with_views('edges')} SELECT * FROM (SELECT source_id, target_id, {r4(f'greatest(weight - greatest({_GAP} * decay_rate - shield, 0), 0)')} AS weight FROM edges) WHERE weight >= 40")
def edge_prune(spark, sf):
    return W.decay_absorb(V.weighted_edges(spark, sf), NOW, 40).select("source_id", "target_id", "weight")


_TIME = "CASE WHEN idle_seconds <= 0 THEN 1.0 ELSE exp(-ln(2) * idle_seconds * (0.02 / 0.01) / 2592000.0) END"
_USE = "(1 - 0.5 / (1 + label))"


@query(f"{V.with_views('anchors')} SELECT id, {r4(_TIME)} AS time_factor, {r4(_USE)} AS usage_factor, {r4(f'least(greatest(pow({_TIME}, 0.7) * pow({_USE}, 0.3), 0), 1)')} AS factor FROM anchors")
def anchor_decay(spark, sf):
    time, use = S.time_decay(F.col("idle_seconds"), F.lit(0.02)), S.usage_decay(F.col("label"))
    return V.anchors(spark, sf).select("id", S.round_to(time).alias("time_factor"), S.round_to(use).alias("usage_factor"), S.round_to(S.combined_decay(time, use)).alias("factor"))


@query(f"{V.with_views('edges')} SELECT source_id, target_id, {r4('100 - (100 - weight) * pow(0.9, activation_count)')} AS weight FROM edges")
def edge_reinforce_batch(spark, sf):
    used = V.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"))
    return W.reinforce_batch(V.weighted_edges(spark, sf).select("source_id", "target_id", "weight"), V.parted(used, "source_id", "target_id"), 0.1)


def _upsert_sql(expression: str) -> str:
    return f"""{V.with_views('edges')}, a AS (SELECT source_id, target_id, weight / 100 AS w FROM edges WHERE source_id % 3 <> 0), b AS (SELECT source_id, target_id, shield / 100 AS v FROM edges WHERE source_id % 2 = 0)
 SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(a.target_id, b.target_id) AS target_id, {r4(f'CASE WHEN w IS NULL THEN v WHEN v IS NULL THEN w ELSE {expression} END')} AS weight FROM a FULL JOIN b ON a.source_id = b.source_id AND a.target_id = b.target_id"""


def _upsert(spark, sf, strategy):
    edges = unit_edges(spark, sf)
    return W.upsert(edges.where("source_id % 3 <> 0"), edges.where("source_id % 2 = 0").withColumn("weight", F.col("shield") / 100), strategy)


@query(_upsert_sql("greatest(w, v)"))
def edge_upsert_max(spark, sf):
    return _upsert(spark, sf, "max")


@query(_upsert_sql("(w + v) / 2"))
def edge_upsert_average(spark, sf):
    return _upsert(spark, sf, "average")


@query(_upsert_sql("1 - (1 - w) * (1 - v)"))
def edge_upsert_hebbian(spark, sf):
    return _upsert(spark, sf, "hebbian")


_SIMULATED = f"{V.with_views('edges')} SELECT source_id, target_id, step, {r4('CASE WHEN step <= 0 OR decay_rate <= 0 THEN weight ELSE greatest(weight - greatest(step * decay_rate - greatest(shield - 0.5 * step, 0), 0), 0) END')} AS weight, {r4('CASE WHEN decay_rate <= 0 THEN shield ELSE greatest(shield - 0.5 * step, 0) END')} AS shield FROM edges, (SELECT CAST(unnest(range(0, 11)) AS INTEGER) AS step)"


@query(_SIMULATED)
def decay_simulate(spark, sf):
    return W.simulate(V.weighted_edges(spark, sf), 10)


@query(_SIMULATED)
def decay_simulate_all(spark, sf):
    """The same, by the name that earlier timings bear."""
    return decay_simulate(spark, sf)


@query(f"{V.with_views('edges')} SELECT source_id, target_id, CASE WHEN decay_rate > 0 AND weight > 0 AND g <= 1e6 THEN CAST(last_event + g AS BIGINT) END AS death FROM (SELECT *, ceil(CASE WHEN shield - 0.5 * ((weight + shield) / (decay_rate + 0.5)) > 0 THEN (weight + shield) / (decay_rate + 0.5) WHEN decay_rate > 0 THEN weight / decay_rate END - 1e-9) AS g FROM edges)")
def death_event(spark, sf):
    edges = V.weighted_edges(spark, sf).withColumn("decay_rate", F.col("decay_rate"))
    safe = F.when(F.col("decay_rate") > 0, F.col("decay_rate"))
    return edges.select("source_id", "target_id", S.death_event(F.col("weight"), F.col("shield"), safe, F.col("last_event")).cast("long").alias("death"))


@query(f"{V.with_views('edges')} SELECT source_id, target_id, CASE WHEN decay_rate > 0 THEN CAST(last_event + ceil(shield / decay_rate - 1e-9) AS BIGINT) END AS gone FROM edges")
def shield_depletion(spark, sf):
    gone = F.when(F.col("decay_rate") > 0, F.col("last_event") + F.ceil(F.col("shield") / F.when(F.col("decay_rate") > 0, F.col("decay_rate")) - 1e-9))
    return V.weighted_edges(spark, sf).select("source_id", "target_id", gone.cast("long").alias("gone"))


@query(f"{V.with_views('edges')} SELECT source_id, target_id, {r4('CASE WHEN weight / 100 + decay_rate > 0 THEN weight / 100 / (weight / 100 + decay_rate) ELSE 0 END')} AS equilibrium FROM edges")
def equilibrium(spark, sf):
    return unit_edges(spark, sf).select("source_id", "target_id", S.round_to(S.equilibrium(F.col("weight"), F.col("decay_rate"))).alias("equilibrium"))


_PAIRS = "pairs AS (SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS frequency, min(event_id) AS first_seen, max(event_id) AS last_seen FROM (SELECT event_id, nodes[i] AS x, unnest(nodes[i + 1:20]) AS y FROM (SELECT event_id, nodes, unnest(range(1, len(nodes) + 1)) AS i FROM co WHERE len(nodes) >= 2)) GROUP BY 1, 2)"


def _pairs(spark, sf):
    return W.pair_counts(V.co_retrieval_events(spark, sf), parts=V.parts(V.read(spark, sf, "lineitem")))


@query(f"{V.with_views('co')}, {_PAIRS} SELECT a, b, frequency, first_seen, last_seen FROM pairs")
def coret_pairs(spark, sf):
    return _pairs(spark, sf)


@query(f"{V.with_views('co')}, {_PAIRS} SELECT count(*) AS n, coalesce(max(frequency), 0) AS most, {r4('coalesce(avg(frequency), 0)')} AS mean FROM pairs")
def coret_stats(spark, sf):
    return _pairs(spark, sf).agg(F.count("*").alias("n"), F.coalesce(F.max("frequency"), F.lit(0)).alias("most"), S.round_to(F.coalesce(F.avg("frequency"), F.lit(0.0))).alias("mean"))


@query(f"{V.with_views('co')}, {_PAIRS} SELECT CASE WHEN a = 5 THEN b ELSE a END AS partner, frequency FROM pairs WHERE a = 5 OR b = 5 ORDER BY frequency DESC, partner LIMIT 10")
def coret_top_partners(spark, sf):
    pairs = _pairs(spark, sf).where("a = 5 or b = 5")
    return by(pairs.select(F.when(F.col("a") == 5, F.col("b")).otherwise(F.col("a")).alias("partner"), "frequency"), "-frequency", "partner", k=10)


@query(f"{V.with_views('co')}, {_PAIRS}, act AS (SELECT l_partkey AS id, greatest(0.1, 1 - exp(-count(*) / 5.0)) AS l FROM lineitem GROUP BY 1), d AS (SELECT a, b, frequency / 100.0 AS w, 0.1 * u.l * v.l * (1 - least(frequency / 100.0, 1)) AS d FROM pairs JOIN act u ON u.id = a JOIN act v ON v.id = b) SELECT a, b, {r4('d')} AS delta, {r4('least(1, w + d)')} AS weight FROM d")
def hebbian_pairs(spark, sf):
    pairs = _pairs(spark, sf).select("a", "b", (F.col("frequency") / 100.0).alias("weight"))
    uses = V.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).count()
    return W.hebbian(pairs, uses)


# --- statistics ------------------------------------------------------------------------------------------------------
@query(f"{V.with_views('nodes')} SELECT t.node_type, count(n.id) AS n FROM (SELECT unnest(['semantic', 'episodic', 'procedural', 'prospective', 'emotional', 'none']) AS node_type) t LEFT JOIN nodes n ON coalesce(n.node_type, 'none') = t.node_type GROUP BY 1")
def node_stats(spark, sf):
    keys = spark.createDataFrame([(t,) for t in (*V.NODE_TYPES, "none")], "node_type string")
    counts = V.memory_nodes(spark, sf).groupBy(F.coalesce("node_type", F.lit("none")).alias("node_type")).count()
    return keys.join(counts, "node_type", "left").select("node_type", F.coalesce("count", F.lit(0)).alias("n"))


@query(f"{V.with_views('edges')} SELECT edge_type, count(*) AS n, {r4('avg(weight)')} AS mean_weight, {r4('avg(shield)')} AS mean_shield, sum(CASE WHEN weight <= 2 THEN 1 ELSE 0 END) AS weak FROM edges GROUP BY 1")
def edge_stats(spark, sf):
    return V.weighted_edges(spark, sf).groupBy("edge_type").agg(F.count("*").alias("n"), S.round_to(F.avg("weight")).alias("mean_weight"), S.round_to(F.avg("shield")).alias("mean_shield"), F.sum((F.col("weight") <= 2).cast("long")).alias("weak"))


@query("SELECT event_type AS stage, count(*) AS n, round(avg(value), 2) AS mean_duration FROM events GROUP BY 1")
def trace_stats(spark, sf):
    return V.read(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean_duration"))


@query("SELECT user_id, event_type AS stage, min(event_id) AS first_id, max(event_id) AS last_id, arg_max(value, event_id) AS last_value FROM events GROUP BY 1, 2")
def trace_timeline(spark, sf):
    return V.read(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.max_by("value", "event_id").alias("last_value"))


# --- conversations and sessions --------------------------------------------------------------------------------------
@query("SELECT conv_id, turn, user_turn FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn FROM conversations) WHERE role = 'assistant'")
def turn_pairs(spark, sf):
    return C.turn_pairs(V.read(spark, sf, "conversations"))


@query("SELECT m.conv_id, m.turn, coalesce(string_agg('[' || p.role || ']: ' || p.text, chr(10) || chr(10) ORDER BY p.turn), '') AS context FROM conversations m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) p ON p.conv_id = m.conv_id AND p.turn < m.turn - 1 AND p.turn >= m.turn - 7 GROUP BY 1, 2")
def prior_context(spark, sf):
    return C.prior_context(V.read(spark, sf, "conversations"))


_SESS = "s AS (SELECT user_id, session, min(ts) AS started_at, max(ts) AS last_at, count(*) AS n FROM (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 21600000000 THEN 1 ELSE 0 END AS cut FROM events)) GROUP BY 1, 2)"


@query(f"WITH {_SESS} SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(started_at) AS started_us, epoch_us(last_at) AS last_us, n FROM s")
def sessions_timeout(spark, sf):
    out = C.sessions(V.read(spark, sf, "events"), 21_600)
    return out.select("user_id", "session", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_at").alias("last_us"), "n")


@query(f"WITH {_SESS} SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(last_at) - epoch_us(started_at) >= 86400000000 AS expired FROM s")
def sessions_ttl(spark, sf):
    return C.sessions(V.read(spark, sf, "events"), 21_600, 86_400).select("user_id", "session", "expired")


@query("SELECT event_id, user_id, round(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0 WHEN event_type = 'view' THEN 0.3 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS clock FROM events")
def event_clock(spark, sf):
    return C.event_clock(V.read(spark, sf, "events"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_and(event_type IN ('purchase', 'signup')) THEN 'completed' ELSE 'running' END AS status FROM events GROUP BY 1")
def jobs_status(spark, sf):
    failed, done = F.bool_or(F.col("event_type") == "error"), F.bool_and(F.col("event_type").isin("purchase", "signup"))
    return V.read(spark, sf, "events").groupBy("user_id").agg(F.when(failed, "failed").when(done, "completed").otherwise("running").alias("status"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse_props(spark, sf):
    return V.read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
