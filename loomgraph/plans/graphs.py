"""Registered queries: graph analytics, retrieval and the knowledge graph, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import expressions as X
from loomgraph.operators import graph as G
from loomgraph.operators import relational as R
from loomgraph.operators import retrieval as T
from loomgraph.plans import standins as S
from loomgraph.plans.catalogue import ORACLES, query
from loomgraph.plans.core import BIG, RISK, WITH10
from loomgraph.session import table


def reach_sql(depth: int | None = None) -> str:
    return f"WITH RECURSIVE {S.TREE}, {S.FILES}, r AS (SELECT dst AS root, src AS node, 1 AS depth FROM edges UNION SELECT r.root, e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.node {'' if depth is None else f'WHERE r.depth < {depth}'}), m AS (SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE root <> node GROUP BY root, node)"


@query("gr_blast_depth4", reach_sql(4) + " SELECT * FROM m")
def gr_blast(spark, d):
    return G.reach(S.tree(spark, d), depth=4).select("root", "node", *BIG("depth"))


@query("gr_blast_all", reach_sql() + " SELECT * FROM m")
def gr_blast_all(spark, d):
    return G.reach(S.tree(spark, d)).select("root", "node", *BIG("depth"))


@query("gr_blast_ranked", reach_sql() + f", c AS (SELECT root, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive FROM m WHERE node % 9 <> 0 GROUP BY root), t AS (SELECT count(*) AS total FROM files), b AS (SELECT file_id, coalesce(direct, 0) AS direct, coalesce(transitive, 0) AS transitive, coalesce(direct + transitive, 0) AS affected, total FROM t, files LEFT JOIN c ON root = file_id) SELECT file_id, direct, transitive, affected, {RISK} AS risk FROM b")
def gr_ranked(spark, d):
    f = S.files(spark, d).select(F.col("file_id").alias("id"), F.expr("CASE WHEN file_id % 9 = 0 THEN concat(path, '.spec.ts') ELSE path END").alias("path"))
    tests = f.filter(X.is_test_path(F.col("path")))
    return G.blast(S.tree(spark, d), f, hidden=tests).select(F.col("id").alias("file_id"), *BIG("direct", "transitive", "affected"), "risk")


@query("srt_riskiest", reach_sql() + ", c AS (SELECT root AS id, count(*) AS affected FROM m GROUP BY root) SELECT id, affected FROM c ORDER BY affected DESC, id LIMIT 30")
def srt_riskiest(spark, d):
    from loomgraph.operators.reports import riskiest

    return riskiest(G.blast(S.tree(spark, d), S.files(spark, d).select(F.col("file_id").alias("id")))).select("id", *BIG("affected"))


LEVELS = f"WITH RECURSIVE {S.TREE}, r AS (SELECT DISTINCT src AS id, 0 AS level FROM edges UNION SELECT e.dst, r.level + 1 FROM r JOIN edges e ON e.src = r.id), l AS (SELECT id, CAST(max(level) AS BIGINT) AS level FROM r GROUP BY id)"


@query("gr_topo_levels", LEVELS + " SELECT * FROM l")
def gr_topo(spark, d):
    return G.levels(S.tree(spark, d)).select("id", *BIG("level"))


@query("gr_reading_order", LEVELS + ", u AS (SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY CAST(dst AS VARCHAR)) AS depends_on FROM edges GROUP BY src) SELECT l.id, level, row_number() OVER (ORDER BY level, l.id) AS position, coalesce(depends_on, '') AS depends_on FROM l LEFT JOIN u ON u.id = l.id")
def gr_reading(spark, d):
    e = S.tree(spark, d)
    lv = G.levels(e).select("id", *BIG("level"))
    uses = e.groupBy(F.col("src").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.col("dst").cast("string"))), ",").alias("depends_on"))
    from loomgraph.operators.windows import position

    return position(lv, F.asc("level"), F.asc("id")).join(uses, "id", "left").select("id", "level", "position", F.coalesce("depends_on", F.lit("")).alias("depends_on"))


@query("gr_scc", f"WITH RECURSIVE {S.JUMPS}, r AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM r JOIN edges e ON e.src = r.b), s AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b) SELECT a AS id, least(a, min(b)) AS component FROM s GROUP BY a")
def gr_scc(spark, d):
    return G.scc(S.jumps(spark, d))


@query("gr_is_dag", f"WITH RECURSIVE {S.JUMPS}, r AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM r JOIN edges e ON e.src = r.b) SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS vertices, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM r WHERE a = b) = 0 AS is_dag")
def gr_is_dag(spark, d):
    e = S.jumps(spark, d)
    return e.agg(F.count("*").alias("edges")).join(G.vertices(e).agg(F.count("*").alias("vertices"))).select("vertices", "edges", F.lit(G.is_dag(e)).alias("is_dag"))


@query("gr_components", f"WITH RECURSIVE {S.JUMPS}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS id, least(a, min(b)) AS component FROM r GROUP BY a")
def gr_components(spark, d):
    return G.components(S.jumps(spark, d))


@query("gr_shortest_path", f"WITH RECURSIVE {S.TREE}, ends AS (SELECT max(src) AS s, min(dst) AS g FROM edges), r AS (SELECT s AS node, 0 AS d FROM ends UNION SELECT e.dst, r.d + 1 FROM r JOIN edges e ON e.src = r.node) SELECT s AS start, g AS goal, CAST(min(d) AS BIGINT) AS hops FROM ends JOIN r ON node = g GROUP BY 1, 2")
def gr_shortest(spark, d):
    e = S.tree(spark, d)
    start, goal = e.agg(F.max("src"), F.min("dst")).first()
    path = G.shortest_path(e, start, goal)
    return spark.createDataFrame([(start, goal, len(path) - 1)], "start bigint, goal bigint, hops bigint")


def pagerank_sql(rounds: int, graph: str = S.edges_sql()) -> str:
    base = f"WITH {graph}, v AS (SELECT id, (SELECT count(*) FROM edges WHERE src = id) AS deg FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)), c AS (SELECT count(*) AS n FROM v), r0 AS (SELECT id, deg, 1.0::DOUBLE / n AS rank FROM v, c)"
    for k in range(1, rounds + 1):
        base += f", g{k} AS (SELECT dst AS id, sum(rank / deg) AS got FROM edges JOIN r{k - 1} ON id = src GROUP BY dst), d{k} AS (SELECT coalesce(sum(rank), 0) AS d FROM r{k - 1} WHERE deg = 0), r{k} AS (SELECT v.id, v.deg, 0.15 / n + 0.85 * (coalesce(got, 0) + d / n) AS rank FROM v CROSS JOIN c CROSS JOIN d{k} LEFT JOIN g{k} ON g{k}.id = v.id)"
    return base + f" SELECT id, round(rank, 6) AS rank FROM r{rounds}"


@query("gr_pagerank_k", pagerank_sql(5))
def gr_pagerank(spark, d):
    return G.pagerank(S.edges(spark, d), 5).select("id", F.round("rank", 6).alias("rank"))


BETWEEN = """vv AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
 w AS (SELECT id AS root, id AS node, 0 AS d FROM vv UNION SELECT w.root, e.dst, w.d + 1 FROM w JOIN edges e ON e.src = w.node),
 m AS (SELECT root, node, min(d) AS d FROM w GROUP BY root, node),
 p AS (SELECT root, node, d, 1.0::DOUBLE AS s FROM m WHERE d = 0 UNION ALL SELECT m.root, m.node, m.d, p.s FROM p JOIN edges e ON e.src = p.node JOIN m ON m.root = p.root AND m.node = e.dst AND m.d = p.d + 1),
 g AS (SELECT root, node, d, sum(s) AS sigma FROM p GROUP BY root, node, d),
 bt AS (SELECT x.node AS id, sum(x.sigma * y.sigma / t.sigma) AS b FROM g x JOIN g y ON y.root = x.node JOIN g t ON t.root = x.root AND t.node = y.node AND t.d = x.d + y.d WHERE x.d > 0 AND y.d > 0 GROUP BY x.node)"""


@query("gr_betweenness", f"WITH RECURSIVE {S.TREE}, {BETWEEN} SELECT vv.id, round(coalesce(b, 0), 4) AS betweenness FROM vv LEFT JOIN bt ON bt.id = vv.id")
def gr_betweenness(spark, d):
    return G.betweenness(S.tree(spark, d)).select("id", F.round("betweenness", 4).alias("betweenness"))


@query("gr_feedback_arcs")
def gr_feedback(spark, d):
    return G.feedback_arcs(S.edges(spark, d))


@query("gr_feedback_leaves_dag", f"WITH {S.JUMPS} SELECT count(*) AS edges, true AS is_dag FROM edges")
def gr_feedback_rest(spark, d):
    """Whether the edges without the feedback arcs have no cycle."""
    e = S.jumps(spark, d)
    rest = e.join(G.feedback_arcs(e), ["src", "dst"], "left_anti")
    return e.agg(F.count("*").alias("edges")).withColumn("is_dag", F.lit(G.is_dag(rest)))


@query("gr_centrality", f"{pagerank_sql(5, S.TREE).replace('WITH', 'WITH RECURSIVE', 1).rpartition(' SELECT ')[0]}, {{BETWEEN}}, dg AS (SELECT node AS id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY node) SELECT dg.id, fan_in, fan_out, round(rank, 6) AS pagerank, round(coalesce(b, 0), 4) AS betweenness FROM dg JOIN r5 ON r5.id = dg.id LEFT JOIN bt ON bt.id = dg.id".replace("{BETWEEN}", BETWEEN))
def gr_centrality(spark, d):
    return G.centrality(S.tree(spark, d), 5).select("id", *BIG("fan_in", "fan_out"), "pagerank", "betweenness")


@query("srt_top_central", f"WITH z AS MATERIALIZED (SELECT * FROM ({ORACLES['gr_centrality']})), m AS (SELECT 'betweenness' AS measure, id, betweenness AS value FROM z UNION ALL SELECT 'pagerank', id, pagerank FROM z) SELECT measure, rank, id, value FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, id) AS rank FROM m) WHERE rank <= 10")
def srt_top_central(spark, d):
    return G.top_central(gr_centrality(spark, d), 10).select("measure", *BIG("rank"), "id", "value")


@query("gr_focused", f"WITH {S.edges_sql()}, t AS (SELECT dst AS id FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 50), n AS (SELECT id FROM t UNION SELECT dst FROM edges WHERE src IN (SELECT id FROM t)) SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def gr_focused(spark, d):
    return G.focused(S.edges(spark, d))


@query("gr_neighbors", WITH10 + ", k AS (SELECT min(src) AS id FROM edges) SELECT 'in' AS direction, src AS id FROM edges WHERE dst = (SELECT id FROM k) UNION SELECT 'out', dst FROM edges WHERE src = (SELECT id FROM k)")
def gr_neighbors(spark, d):
    e = S.edges(spark, d)
    return G.neighbours(e, e.agg(F.min("src")).first()[0])


@query("gr_top_central", f"WITH {S.edges_sql()}, x AS (SELECT node, CAST(sum(i) AS BIGINT) AS fan_in FROM (SELECT dst AS node, 1 AS i FROM edges UNION ALL SELECT src, 0 FROM edges) GROUP BY node) SELECT node, fan_in FROM x ORDER BY fan_in DESC, node LIMIT 30")
def gr_top_central(spark, d):
    return R.degrees(S.edges(spark, d)).orderBy(F.desc("fan_in"), "node").limit(30).select("node", "fan_in")


# --- retrieval -------------------------------------------------------------

DIST = "round(1 - list_dot_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 5) + 0.0"
HITS = f"WITH h AS (SELECT q.vec_id AS q_id, c.vec_id AS c_id, {DIST} AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, c_id) AS rank FROM h)"


def _hits(spark, d, n):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    c = e.select(F.col("vec_id").alias("c_id"), F.col("embedding").alias("c_vec"))
    met = T.nearest(q, c, n + 1, 5).filter("q_id <> c_id").withColumn("distance", F.col("distance") + 0.0)
    return R.top_per_group(met.drop("rank"), ["q_id"], n, F.asc("distance"), F.asc("c_id"))


@query("ret_knn", HITS + " SELECT q_id, c_id, distance, rank FROM n WHERE rank <= 5")
def ret_knn(spark, d):
    return _hits(spark, d, 5).select("q_id", "c_id", "distance", *[F.col("rn").cast("bigint").alias("rank")])


@query("ret_distance_gate", HITS + " SELECT q_id, count(*) FILTER (distance <= 0.75) AS kept, count(*) AS total, round(avg(CASE WHEN distance <= 0.55 THEN 1.0 ELSE 0.0 END), 6) AS confidence, count(*) FILTER (distance <= 0.75) >= 1 AND avg(CASE WHEN distance <= 0.55 THEN 1.0 ELSE 0.0 END) >= 0.35 AS good FROM n WHERE rank <= 12 GROUP BY q_id")
def ret_gate(spark, d):
    return T.gate(_hits(spark, d, 12), "q_id").select("q_id", "kept", "total", F.round("confidence", 6).alias("confidence"), "good")


TOKENS = """list_distinct(list_concat(list_transform(raw, lambda w: lower(w)),
  flatten(list_transform(list_filter(raw, lambda w: contains(w, '_')), lambda w: string_split(lower(w), '_'))),
  flatten(list_transform(list_filter(list_transform(raw, lambda w: regexp_extract_all(w, '[a-z]+|[A-Z][a-z]*')), lambda p: len(p) > 1), lambda p: list_transform(p, lambda x: lower(x))))))"""
STOP = "[" + ", ".join(f"'{w}'" for w in X.GRADE_STOP) + "]"


def tokens_sql(src: str) -> str:
    return f"SELECT id, list_filter({TOKENS}, lambda t: len(t) > 2 AND NOT list_contains({STOP}, t)) AS t FROM (SELECT id, list_distinct(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) AS raw FROM ({src}))"


@query("ret_tokens", f"WITH t AS ({tokens_sql('SELECT doc_id AS id, text FROM documents')}) SELECT id AS doc_id, len(t) AS n, array_to_string(list_sort(t), ' ') AS tokens FROM t")
def ret_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.keyword_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.array_join(F.array_sort("t"), " ").alias("tokens"))


QUESTIONS = "SELECT item_id AS id, text FROM benchmark"


@query("ret_keyword_grade", f"WITH q AS ({tokens_sql(QUESTIONS)}), c AS ({tokens_sql('SELECT doc_id AS id, text FROM documents')}), o AS (SELECT q.id AS q_id, c.id AS c_id, round(len(list_intersect(q.t, c.t)) / len(q.t), 6) AS overlap FROM q, c WHERE len(q.t) > 0) SELECT q_id, c_id, overlap FROM (SELECT *, max(overlap) OVER (PARTITION BY q_id) AS m FROM o) WHERE overlap >= 0.2 OR m < 0.2")
def ret_grade(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    c = table(spark, d, "documents").select(F.col("doc_id").alias("c_id"), "text")
    return T.keyword_grade(q, c).select("q_id", "c_id", F.round("overlap", 6).alias("overlap"))


@query("ret_symbol_lookup", f"WITH q AS (SELECT doc_id AS q_id, unnest(list_distinct(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*'))) AS name FROM documents), s AS (SELECT p_partkey AS symbol_id, CASE p_partkey % 4 WHEN 0 THEN 'License' WHEN 1 THEN 'License' || CAST(p_partkey AS VARCHAR) WHEN 2 THEN 'token' ELSE 'the' END AS name FROM part) SELECT DISTINCT q_id, symbol_id FROM q JOIN s USING (name) WHERE len(name) > 2 AND lower(name) NOT IN ({', '.join(repr(w) for w in X.LOOKUP_STOP)})")
def ret_lookup(spark, d):
    q = table(spark, d, "documents").select(F.col("doc_id").alias("q_id"), F.col("text").alias("question"))
    s = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.expr("CASE p_partkey % 4 WHEN 0 THEN 'License' WHEN 1 THEN concat('License', p_partkey) WHEN 2 THEN 'token' ELSE 'the' END").alias("name"))
    return T.symbol_lookup(q, s)


EXPAND = f"{S.edges_sql()}, s AS (SELECT p_size AS q_id, p_partkey AS id FROM part WHERE p_partkey % 7 = 0), b AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), x AS (SELECT DISTINCT q_id, dst AS id FROM s JOIN b ON src = id), y AS (SELECT q_id, id FROM x EXCEPT SELECT q_id, id FROM s)"


@query("ret_graph_expand", f"WITH {EXPAND} SELECT CAST(q_id AS BIGINT) AS q_id, id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY id) AS rn FROM y) WHERE rn <= 10")
def ret_expand(spark, d):
    s = table(spark, d, "part").filter("p_partkey % 7 = 0").select(F.col("p_size").cast("bigint").alias("q_id"), F.col("p_partkey").alias("id"))
    return T.expand(S.edges(spark, d), s, 10)


SEARCH = HITS.replace("WITH h AS", f"WITH {S.edges_sql()}, h AS") + """, k AS (SELECT * FROM n WHERE rank <= 5),
 g AS (SELECT q_id, count(*) FILTER (distance <= 0.75) >= 1 AND avg(CASE WHEN distance <= 0.55 THEN 1.0 ELSE 0.0 END) >= 0.35 AS good FROM k GROUP BY q_id),
 s AS (SELECT q_id, c_id AS id FROM k WHERE distance <= 0.75 AND q_id IN (SELECT q_id FROM g WHERE NOT good)), b AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
 x AS (SELECT DISTINCT q_id, dst AS id FROM s JOIN b ON src = id), y AS (SELECT q_id, id FROM x EXCEPT SELECT q_id, id FROM s), z AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY id) AS rn FROM y)
 SELECT q_id, c_id, distance, 'vector' AS origin FROM k WHERE distance <= 0.75 UNION ALL SELECT q_id, id, 0.5, 'graph' FROM z WHERE rn <= 5"""


@query("ret_search_pipeline", SEARCH.replace("AND q.vec_id <> c.vec_id", ""))
def ret_search(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    c = e.select(F.col("vec_id").alias("c_id"), F.col("embedding").alias("c_vec"))
    found = T.search(q, c, S.edges(spark, d), 5, 5)
    return found.select("q_id", "c_id", (F.col("distance") + 0.0).alias("distance"), "origin")


# --- knowledge graph -------------------------------------------------------


@query("kg_nodes", f"WITH {S.FILES} SELECT 'file:' || path AS id, 'file' AS type, CASE WHEN p_size * 500 < 4000 THEN 'simple' WHEN p_size * 500 < 20000 THEN 'moderate' ELSE 'complex' END AS complexity FROM files JOIN part ON p_partkey = file_id UNION ALL SELECT DISTINCT 'module:' || module, 'module', NULL FROM files")
def kg_nodes(spark, d):
    f = S.files(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), "p_size"), "file_id")
    a = f.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("type"), X.complexity(F.col("p_size") * 500).alias("complexity"))
    b = f.select(F.concat(F.lit("module:"), "module").alias("id")).distinct().select("id", F.lit("module").alias("type"), F.lit(None).cast("string").alias("complexity"))
    return a.unionByName(b)


@query("kg_layout_grid", f"WITH {S.FILES}, r AS (SELECT file_id, module, row_number() OVER (PARTITION BY module ORDER BY file_id) - 1 AS i FROM files) SELECT file_id, module, i % 10 AS x, CAST(floor(i / 10) AS BIGINT) AS y FROM r")
def kg_layout(spark, d):
    i = (F.row_number().over(W.partitionBy("module").orderBy("file_id")) - 1).cast("bigint")
    return S.files(spark, d).select("file_id", "module", i.alias("i")).select("file_id", "module", (F.col("i") % 10).alias("x"), F.floor(F.col("i") / 10).alias("y"))
