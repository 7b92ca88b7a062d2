"""Registered queries: joins, aggregates, windows, sets, filters and projections, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import expressions as X
from loomgraph.operators import incremental as I
from loomgraph.operators import relational as R
from loomgraph.operators import review as V
from loomgraph.operators import windows as N
from loomgraph.plans import standins as S
from loomgraph.plans.catalogue import query
from loomgraph.session import table

WITH10 = f"WITH {S.FILES}, {S.edges_sql()} "
BIG = lambda *cs: [F.col(c).cast("bigint").alias(c) for c in cs]


# --- joins -----------------------------------------------------------------


@query("jn_import_edges", WITH10 + "SELECT a.path AS source_path, b.path AS target_path FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst")
def jn_import_edges(spark, d):
    return R.import_edges(S.edges(spark, d), S.files(spark, d))


@query("jn_importers", WITH10 + "SELECT dst AS file_id, path FROM edges JOIN files ON src = file_id WHERE dst IN (SELECT file_id FROM files WHERE module = 'Brand#11')")
def jn_importers(spark, d):
    f = S.files(spark, d)
    return R.importers(S.edges(spark, d), f, f.filter("module = 'Brand#11'"))


@query("jn_imports", WITH10 + "SELECT src AS file_id, path FROM edges JOIN files ON dst = file_id WHERE src IN (SELECT file_id FROM files WHERE module = 'Brand#11')")
def jn_imports(spark, d):
    f = S.files(spark, d)
    return R.imports_of(S.edges(spark, d), f, f.filter("module = 'Brand#11'"))


@query("jn_callers", f"WITH {S.CALLS} SELECT callee, s_name, n_name, CAST(line AS BIGINT) AS line FROM calls JOIN supplier ON s_suppkey = caller JOIN nation ON n_nationkey = s_nationkey")
def jn_callers(spark, d):
    sup, nat = table(spark, d, "supplier"), table(spark, d, "nation")
    return S.calls(spark, d).join(sup, F.col("s_suppkey") == F.col("caller")).join(nat, F.col("n_nationkey") == F.col("s_nationkey")).select("callee", "s_name", "n_name", *BIG("line"))


@query("jn_callees", f"WITH {S.CALLS}, {S.FILES} SELECT caller, path, CAST(line AS BIGINT) AS line FROM calls JOIN files ON file_id = callee")
def jn_callees(spark, d):
    return S.calls(spark, d).join(S.files(spark, d), F.col("file_id") == F.col("callee")).select("caller", "path", *BIG("line"))


@query("jn_symbols_left_metadata", "SELECT d.doc_id, lang, source, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jn_symbols_left_metadata(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", "source", *BIG("quality", "toxic"))


@query("jn_neighbors_semi_anti", WITH10 + ", seeds AS (SELECT file_id FROM files WHERE module = 'Brand#11') SELECT DISTINCT dst FROM edges WHERE src IN (SELECT file_id FROM seeds) AND dst NOT IN (SELECT file_id FROM seeds)")
def jn_neighbors_semi_anti(spark, d):
    seeds = S.files(spark, d).filter("module = 'Brand#11'").select(F.col("file_id").alias("id"))
    return R.neighbours_outside(S.edges(spark, d), seeds)


@query("jn_edges_within_set", WITH10 + ", s AS (SELECT file_id FROM files WHERE language LIKE 'P%') SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT file_id FROM s) AND dst IN (SELECT file_id FROM s)")
def jn_edges_within_set(spark, d):
    nodes = S.files(spark, d).filter("language LIKE 'P%'").select(F.col("file_id").alias("id"))
    return R.edges_within(S.edges(spark, d), nodes)


@query("jn_call_resolution_prefer_same_group", """WITH c AS (SELECT DISTINCT l_orderkey AS call_id, l_suppkey % 25 AS file_id, l_partkey % 64 AS name FROM lineitem),
 c1 AS (SELECT call_id, min(file_id) AS file_id, min(name) AS name FROM c GROUP BY call_id),
 s AS (SELECT p_partkey AS symbol_id, p_partkey % 25 AS file_id, p_partkey % 64 AS name FROM part),
 r AS (SELECT call_id, symbol_id, CASE WHEN c1.file_id = s.file_id THEN 1 ELSE 0 END AS same_file FROM c1 JOIN s USING (name)),
 n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY same_file DESC, symbol_id) AS rn FROM r)
 SELECT call_id, symbol_id, CAST(same_file AS BIGINT) AS same_file FROM n WHERE rn = 1""")
def jn_call_resolution(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.min(F.expr("l_suppkey % 25")).alias("file_id"), F.min(F.expr("l_partkey % 64")).alias("name"))
    s = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.expr("p_partkey % 25").alias("file_id"), F.expr("p_partkey % 64").alias("name"))
    return R.resolve_calls(c, s).select("call_id", "symbol_id", *BIG("same_file"))


SPANS = f"""WITH {S.LINES}, n AS (SELECT doc_id, max(line) AS n FROM lines GROUP BY doc_id),
 o AS (SELECT doc_id, k AS id, k AS ordinal, k * 2 + 1 AS s, least(n, k * 2 + 4) AS e FROM n, (SELECT unnest(range(0, 5)) AS k) WHERE k * 2 + 1 <= n),
 i AS (SELECT doc_id, k AS id, k + 1 AS s, least(n, k + 2) AS e FROM n, (SELECT unnest(range(0, 8)) AS k) WHERE k + 1 <= n)"""


def _spans(spark, d):
    n = S.lines(spark, d).groupBy(F.col("doc_id").alias("file_id")).agg(F.max("line").alias("n"))
    o = n.select("file_id", "n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).filter("k * 2 + 1 <= n").selectExpr("file_id", "CAST(k AS BIGINT) AS id", "k * 2 + 1 AS start", "least(n, k * 2 + 4) AS end", "k AS ordinal")
    i = n.select("file_id", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).filter("k + 1 <= n").selectExpr("file_id", "CAST(k AS BIGINT) AS id", "k + 1 AS start", "least(n, k + 2) AS end")
    return o, i


@query("jn_range_containment", SPANS + ", m AS (SELECT i.doc_id, i.id, o.id AS outer_id, row_number() OVER (PARTITION BY i.doc_id, i.id ORDER BY ordinal) AS rn FROM i JOIN o ON i.doc_id = o.doc_id AND o.s <= i.s AND i.e <= o.e) SELECT doc_id AS file_id, id, outer_id FROM m WHERE rn = 1")
def jn_range_containment(spark, d):
    o, i = _spans(spark, d)
    return R.containing(i, o)


@query("jn_uncovered_lines", SPANS + ", r AS (SELECT doc_id, s, e FROM o WHERE id % 2 = 1) SELECT doc_id AS file_id, line FROM lines l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND line BETWEEN s AND e)")
def jn_uncovered_lines(spark, d):
    o, _ = _spans(spark, d)
    return R.uncovered_lines(S.lines(spark, d).select(F.col("doc_id").alias("file_id"), "line"), o.filter("id % 2 = 1"))


@query("jn_suffix_priority_resolution", f"""WITH {S.FILES}, k AS (SELECT file_id AS key, path AS suffix FROM files WHERE file_id % 3 = 0 UNION ALL SELECT file_id, language || '/' || CAST(file_id AS VARCHAR) FROM files WHERE file_id % 3 = 1 UNION ALL SELECT file_id, CAST(file_id AS VARCHAR) FROM files WHERE file_id % 3 = 2),
 c AS (SELECT file_id AS id, CAST(i - 1 AS BIGINT) AS priority, array_to_string(string_split(path, '/')[i:], '/') AS suffix FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM files)),
 m AS (SELECT id, priority, key, row_number() OVER (PARTITION BY id ORDER BY priority, key) AS rn FROM c JOIN k USING (suffix)) SELECT id, priority, key FROM m WHERE rn = 1""")
def jn_suffix(spark, d):
    f = S.files(spark, d)
    known = f.selectExpr("file_id AS key", "CASE file_id % 3 WHEN 0 THEN path WHEN 1 THEN concat(language, '/', file_id) ELSE CAST(file_id AS STRING) END AS suffix")
    return R.resolve_by_suffix(f.select(F.col("file_id").alias("id"), "path"), known).select("id", *BIG("priority"), "key")


@query("jn_lateral_latest_inner", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer JOIN o ON o_custkey = c_custkey AND rn = 1")
def jn_lateral_inner(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("o"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey").select("c_custkey", "c_name", "o.o_orderkey", "o.o_orderstatus")


@query("jn_lateral_latest_left", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_custkey % 3 <> 0) SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN o ON o_custkey = c_custkey AND rn = 1")
def jn_lateral_left(spark, d):
    o = table(spark, d, "orders").filter("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("o"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left").select("c_custkey", "c_name", "o.o_orderkey", "o.o_orderstatus")


@query("jn_same_file_pairs_top12", "WITH t AS (SELECT module, file_id, row_number() OVER (PARTITION BY module ORDER BY file_id) AS rn FROM (SELECT p_brand AS module, p_partkey AS file_id FROM part)) SELECT a.module, a.file_id AS a, b.file_id AS b FROM t a JOIN t b ON a.module = b.module AND a.rn < b.rn WHERE b.rn <= 12")
def jn_pairs(spark, d):
    return R.pairs_of_first(S.files(spark, d), "module", "file_id")


@query("jn_best_child_per_parent", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), h AS (SELECT label AS parent, vec_id AS child, round(1 - list_dot_product(e.embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))), 5) + 0.0 AS distance FROM embeddings e, q WHERE vec_id > 0), n AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY distance, child) AS rn FROM h) SELECT CAST(parent AS BIGINT) AS parent, child, distance FROM n WHERE rn = 1")
def jn_best_child(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("v"))  # one row
    h = e.filter("vec_id > 0").join(F.broadcast(q), F.lit(True)).select(F.col("label").alias("parent"), F.col("vec_id").alias("child"), (F.round(X.cosine_distance(F.col("embedding"), F.col("v")), 5) + 0.0).alias("distance"))
    return R.best_per_parent(h).select(*BIG("parent"), "child", "distance")


# --- aggregates ------------------------------------------------------------


@query("agg_language_counts", f"WITH {S.FILES} SELECT coalesce(language, 'unknown') AS language, count(*) AS n FROM files GROUP BY 1")
def agg_language_counts(spark, d):
    return R.language_counts(S.files(spark, d))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


@query("agg_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def agg_table_counts(spark, d):
    out = None
    for t in TABLES:
        one = table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("agg_module_languages", f"WITH {S.FILES}, c AS (SELECT module, language, count(*) AS n FROM files GROUP BY 1, 2) SELECT module, CAST(sum(n) AS BIGINT) AS file_count, string_agg(language || ':' || CAST(n AS VARCHAR), ',' ORDER BY language || ':' || CAST(n AS VARCHAR)) AS languages FROM c GROUP BY module")
def agg_module_languages(spark, d):
    return R.module_languages(S.files(spark, d))


@query("agg_degrees", WITH10 + "SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY node")
def agg_degrees(spark, d):
    return R.degrees(S.edges(spark, d))


CROSS = WITH10 + ", x AS (SELECT a.module AS source, b.module AS target FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst WHERE a.module <> b.module)"


@query("agg_coupling", CROSS + " SELECT module, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM (SELECT source AS module, 1 AS o, 0 AS i FROM x UNION ALL SELECT target, 0, 1 FROM x) GROUP BY module")
def agg_coupling(spark, d):
    return R.coupling(S.edges(spark, d), S.files(spark, d))


@query("agg_module_deps", CROSS + " SELECT DISTINCT source, target FROM x")
def agg_module_deps(spark, d):
    return R.module_deps(S.edges(spark, d), S.files(spark, d))


DEPS500 = f"WITH {S.FILES}, {S.edges_sql()}, x AS (SELECT DISTINCT a.module AS source, b.module AS target FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst WHERE a.module <> b.module)"


@query("agg_entry_core_modules", DEPS500 + ", c AS (SELECT target AS module, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, module LIMIT 3) SELECT 'entry' AS kind, module FROM (SELECT DISTINCT module FROM files) WHERE module NOT IN (SELECT target FROM x) UNION ALL SELECT 'core', module FROM c")
def agg_entry_core(spark, d):
    f = S.files(spark, d)
    deps = R.module_deps(S.edges(spark, d), f)
    return R.entry_modules(deps, f.select("module").distinct()).select(F.lit("entry").alias("kind"), "module").unionByName(R.core_modules(deps).select(F.lit("core").alias("kind"), "module"))


RISK = "CASE WHEN total = 0 THEN 'none' WHEN affected > 0.5 * total OR affected >= 20 THEN 'critical' WHEN affected > 0.25 * total OR affected >= 10 THEN 'high' WHEN affected > 0.1 * total OR affected >= 4 THEN 'moderate' ELSE 'low' END"
DIRECT = WITH10 + ", c AS (SELECT dst AS file_id, count(*) AS affected FROM edges GROUP BY 1), t AS (SELECT count(*) AS total FROM files), b AS (SELECT files.file_id, coalesce(affected, 0) AS affected, total FROM t, files LEFT JOIN c ON c.file_id = files.file_id)"


def _direct(spark, d):
    f = S.files(spark, d)
    c = S.edges(spark, d).groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("affected"))
    out = f.select("file_id").join(c, "file_id", "left").na.fill(0, ["affected"])
    return out.withColumn("risk", X.risk_level(F.col("affected"), f.count()))


@query("gr_direct_blast", DIRECT + f" SELECT file_id, affected, {RISK} AS risk FROM b")
def gr_direct_blast(spark, d):
    return _direct(spark, d).orderBy(F.desc("affected"), "file_id")


@query("agg_risk_histogram", DIRECT + f", r AS (SELECT {RISK} AS risk FROM b) SELECT " + ", ".join(f"count(*) FILTER (risk = '{r}') AS n_{r}" for r in V.RISK_LEVELS) + " FROM r")
def agg_risk_histogram(spark, d):
    return V.risk_histogram(_direct(spark, d))


@query("agg_percentile_nearest_rank", "WITH s AS (SELECT list(n_chars ORDER BY n_chars) AS a, count(*) AS n FROM documents) SELECT CAST(p AS BIGINT) AS p, a[least(CAST(floor(n * p / 100) AS BIGINT), n - 1) + 1] AS value FROM s, (SELECT unnest([10, 50, 90, 100]) AS p)")
def agg_percentile(spark, d):
    return R.nearest_rank(table(spark, d, "documents"), "n_chars", [10, 50, 90, 100]).select(*BIG("p"), "value")


@query("agg_review_summary", "SELECT event_type AS severity, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS blocking FROM events GROUP BY 1")
def agg_review_summary(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("severity"), (F.col("value") > 50).alias("blocking"))
    return V.summary(e, "severity")


@query("agg_eval_report", "SELECT lang AS category, count(*) AS n, round(avg(quality), 6) AS avg_quality, round(avg(CASE WHEN n_chars > 0 THEN length(replace(text, ' ', '')) / n_chars END), 6) AS survival, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS low_confidence FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def agg_eval_report(spark, d):
    m = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    kept = F.when(F.col("n_chars") > 0, F.char_length(F.replace("text", F.lit(" "), F.lit(""))) / F.col("n_chars"))
    return m.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("avg_quality"), F.round(F.avg(kept), 6).alias("survival"), F.sum((F.col("toxic") == 1).cast("int")).alias("low_confidence"))


@query("agg_threshold_agreement", "WITH s AS (SELECT least(n_chars / 5000.0, 1.0) AS score, quality FROM documents JOIN labels USING (doc_id)), e AS (SELECT *, CAST(unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6]) AS DOUBLE) AS threshold FROM s) SELECT threshold, count(*) AS n, round(avg(CASE WHEN (score >= threshold) = (quality = 1) THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) FILTER (score >= threshold AND quality <> 1) AS false_positives, count(*) FILTER (score < threshold AND quality = 1) AS false_negatives FROM e GROUP BY threshold")
def agg_threshold(spark, d):
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"), "quality")
    return V.agreement(s, "score", "quality", [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]).withColumn("agreement", F.round("agreement", 6))


@query("agg_precision_recall", "WITH s AS (SELECT n_chars > 1000 AS f, quality = 1 AS e FROM documents JOIN labels USING (doc_id)) SELECT round(count(*) FILTER (f AND e) / count(*) FILTER (f), 6) AS \"precision\", round(count(*) FILTER (f AND e) / count(*) FILTER (e), 6) AS recall FROM s")
def agg_precision_recall(spark, d):
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return V.precision_recall(s, F.col("n_chars") > 1000, F.col("quality") == 1).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("agg_source_root", f"WITH {S.FILES}, c AS (SELECT string_split(path, '/')[1] AS part, count(*) AS n FROM files GROUP BY 1), t AS (SELECT sum(n) AS total FROM c) SELECT part, n, round(n / total, 6) AS share, n >= 0.5 * total AS dominant FROM c, t ORDER BY n DESC, part LIMIT 1")
def agg_source_root(spark, d):
    c = S.files(spark, d).groupBy(F.split("path", "/")[0].alias("part")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    top = c.orderBy(F.desc("n"), "part").limit(1)
    return top.join(total).select("part", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") >= 0.5 * F.col("total")).alias("dominant"))


@query("agg_module_depth", f"WITH {S.FILES}, p AS (SELECT DISTINCT string_split(path, '/')[1] AS parent, string_split(path, '/')[2] AS child FROM files), c AS (SELECT child, count(*) AS parents FROM p GROUP BY child) SELECT count(*) AS children, count(*) FILTER (parents >= 2) AS shared, round(count(*) FILTER (parents >= 2) / count(*), 6) AS share FROM c")
def agg_module_depth(spark, d):
    p = S.files(spark, d).select(F.split("path", "/")[0].alias("parent"), F.split("path", "/")[1].alias("child")).distinct()
    c = p.groupBy("child").agg(F.count("*").alias("parents"))
    shared = F.sum((F.col("parents") >= 2).cast("int"))
    return c.agg(F.count("*").alias("children"), shared.alias("shared"), F.round(shared / F.count("*"), 6).alias("share"))


@query("agg_clean_batches", "SELECT CAST(event_id % 100 AS BIGINT) AS batch, count(*) AS n FROM events GROUP BY 1 HAVING avg(value) < 50 ORDER BY batch LIMIT 20")
def agg_clean_batches(spark, d):
    return table(spark, d, "events").groupBy((F.col("event_id") % 100).alias("batch")).agg(F.count("*").alias("n"), F.avg("value").alias("m")).filter("m < 50").orderBy("batch").limit(20).select("batch", "n")


@query("agg_source_projects", "WITH p AS (SELECT url, string_split(regexp_replace(url, '^https?://', ''), '/')[1] AS project, string_split(url, '/')[-1] AS name FROM pages) SELECT project, count(DISTINCT name) AS n_names, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM p GROUP BY project")
def agg_source_projects(spark, d):
    p = table(spark, d, "pages").select(X.project_of(F.regexp_replace("url", "^https?://", "")).alias("project"), X.basename(F.col("url")).alias("name"))
    return p.groupBy("project").agg(F.count_distinct("name").alias("n_names"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


# --- windows ---------------------------------------------------------------


@query("win_position", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders")
def win_position(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return N.position(o, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "position")


@query("win_cap_per_group", "SELECT module, file_id, rn FROM (SELECT p_brand AS module, p_partkey AS file_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM part) WHERE rn <= 12")
def win_cap(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("file_id"), "p_size")
    return R.top_per_group(p, ["module"], 12, F.desc("p_size"), F.asc("file_id")).select("module", "file_id", *BIG("rn"))


@query("win_trend_delta", "WITH m AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, CAST(day AS VARCHAR)[1:10] AS day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM m")
def win_trend(spark, d):
    m = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return N.trend(m, "event_type", "day", "n")


@query("win_token_budget_prefix", "WITH r AS (SELECT o_custkey, o_orderkey, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM orders) SELECT o_custkey, o_orderkey, CAST(used AS BIGINT) AS used FROM r WHERE used <= 500000")
def win_budget(spark, d):
    o = table(spark, d, "orders").withColumn("cost", F.floor("o_totalprice").cast("bigint"))
    return N.budget_prefix(o, "o_custkey", "cost", 500000, F.asc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "used")


CHUNKS = "SELECT l_partkey AS file, l_suppkey AS symbol, CAST(l_linenumber AS BIGINT) AS start_line, CAST(l_linenumber + l_quantity AS BIGINT) AS end_line, l_orderkey AS hit, l_extendedprice AS score FROM lineitem"


@query("win_dedup_first", f"SELECT file, symbol, start_line, end_line, hit, score FROM (SELECT *, row_number() OVER (PARTITION BY file, symbol, start_line, end_line ORDER BY hit, score) AS rn FROM ({CHUNKS})) WHERE rn = 1")
def win_dedup(spark, d):
    li = table(spark, d, "lineitem")
    hits = li.select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("symbol"), F.col("l_linenumber").cast("bigint").alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity")).cast("bigint").alias("end_line"), F.col("l_orderkey").alias("hit"), F.col("l_extendedprice").alias("score"))
    return R.first_by(hits, ["file", "symbol", "start_line", "end_line"], ["hit", "score"])


@query("win_char_windows", "WITH w AS (SELECT doc_id, text, CASE WHEN length(text) <= 5000 THEN [0] ELSE range(0, length(text), 4600) END AS s FROM documents), e AS (SELECT doc_id, text, unnest(range(0, len(s))) AS chunk, unnest(s) AS start FROM w) SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, md5(substr(text, start + 1, 5000)) AS h FROM e WHERE length(trim(substr(text, start + 1, 5000))) > 0")
def win_char_windows(spark, d):
    return N.char_windows(table(spark, d, "documents")).select("doc_id", *BIG("chunk"), F.md5("text").alias("h"))


@query("win_merge_ranges", f"""WITH r AS (SELECT l_suppkey AS g, l_partkey % 500 AS s, l_partkey % 500 + l_linenumber AS e FROM lineitem),
 f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 WHEN max(e) OVER (PARTITION BY g ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1 ELSE 0 END AS new FROM r),
 i AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT g, min(s) AS "start", max(e) AS "end" FROM i GROUP BY g, island""")
def win_merge(spark, d):
    r = table(spark, d, "lineitem").selectExpr("l_suppkey AS g", "l_partkey % 500 AS start", "l_partkey % 500 + l_linenumber AS end")
    return N.merge_ranges(r, "g")


HEAD = "^[A-Z][^ ]* the "


@query("win_sections", f"""WITH {S.LINES}, m AS (SELECT doc_id, line, content, sum(CASE WHEN regexp_matches(content, '{HEAD}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM lines),
 g AS (SELECT doc_id, section, string_agg(content, chr(10) ORDER BY line) AS body, min(content) FILTER (regexp_matches(content, '{HEAD}')) AS title FROM m GROUP BY doc_id, section)
 SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(title, '') AS title, CAST(length(trim(regexp_replace(body, chr(10) || '+$', ''))) AS BIGINT) AS n_chars FROM g WHERE length(trim(regexp_replace(body, chr(10) || '+$', ''))) >= 20""")
def win_sections(spark, d):
    return N.sections(table(spark, d, "documents"), HEAD).select("doc_id", *BIG("section"), "title", *BIG("n_chars"))


@query("win_latest_versions", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3 OR o_orderstatus = 'P'")
def win_latest(spark, d):
    o = table(spark, d, "orders").withColumn("active", F.col("o_orderstatus") == "P")
    return N.newest_versions(o, "o_custkey", "o_orderkey", 3, "active").select("o_custkey", "o_orderkey")


@query("fold_batch_packing", """WITH RECURSIVE t AS (SELECT p_brand AS g, p_partkey AS item, CAST(p_size AS BIGINT) AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
 f AS (SELECT g, item, k, c AS used, 1 AS n, 1 AS batch FROM t WHERE k = 1 UNION ALL
 SELECT t.g, t.item, t.k, CASE WHEN f.used + t.c > 100 OR f.n >= 5 THEN t.c ELSE f.used + t.c END, CASE WHEN f.used + t.c > 100 OR f.n >= 5 THEN 1 ELSE f.n + 1 END, CASE WHEN f.used + t.c > 100 OR f.n >= 5 THEN f.batch + 1 ELSE f.batch END FROM f JOIN t ON t.g = f.g AND t.k = f.k + 1)
 SELECT g, item, CAST(batch AS BIGINT) AS batch FROM f""")
def fold_packing(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("item"), F.col("p_size").alias("cost"))
    return N.pack_batches(p, "g", "cost", 100, 5, "item").select("g", "item", *BIG("batch"))


@query("win_diff_cap", """WITH RECURSIVE t AS (SELECT l_orderkey AS g, CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS line, CAST(floor(l_quantity) AS BIGINT) AS c, l_returnflag = 'R' AS a FROM lineitem),
 u AS (SELECT g, line, min(c) AS c, bool_or(a) AS a FROM t GROUP BY g, line), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY line) AS k FROM u),
 f AS (SELECT g, line, k, CASE WHEN a OR c + 1 <= 60 THEN c + 1 ELSE 0 END AS used, a OR c + 1 <= 60 AS keep FROM r WHERE k = 1 UNION ALL
 SELECT r.g, r.line, r.k, CASE WHEN a OR f.used + c + 1 <= 60 THEN f.used + c + 1 ELSE f.used END, a OR f.used + c + 1 <= 60 FROM f JOIN r ON r.g = f.g AND r.k = f.k + 1) SELECT g, line FROM f WHERE keep""")
def win_diff_cap(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey AS g", "CAST(l_linenumber AS BIGINT) * 1000000 + l_partkey AS line", "CAST(floor(l_quantity) AS BIGINT) AS n_chars", "l_returnflag = 'R' AS always")
    t = t.groupBy("g", "line").agg(F.min("n_chars").alias("n_chars"), F.bool_or("always").alias("always"))
    return N.diff_cap(t, "g", 60, "line")


# --- sets ------------------------------------------------------------------


@query("set_orphans", f"WITH {S.FILES}, {S.edges_sql()} SELECT path FROM files WHERE file_id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)")
def set_orphans(spark, d):
    from loomgraph.operators.graph import vertices

    return S.files(spark, d).join(vertices(S.edges(spark, d)).withColumnRenamed("id", "file_id"), "file_id", "left_anti").select("path")


@query("set_transitive_minus_direct", f"WITH {S.TREE} SELECT DISTINCT a.dst AS root, b.src AS node FROM edges a JOIN edges b ON b.dst = a.src WHERE a.dst <> b.src AND NOT EXISTS (SELECT 1 FROM edges c WHERE c.dst = a.dst AND c.src = b.src)")
def set_transitive(spark, d):
    e = S.tree(spark, d)
    a, b = e.select(F.col("dst").alias("root"), F.col("src").alias("mid")), e.select(F.col("dst").alias("mid"), F.col("src").alias("node"))
    two = a.join(b, "mid").filter("root <> node").select("root", "node").distinct()
    return two.join(e.select(F.col("dst").alias("root"), F.col("src").alias("node")), ["root", "node"], "left_anti")


@query("set_rejected_hidden", "SELECT event_id AS id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value > 90)")
def set_rejected(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    return R.hide_rejected(e.select("id", "event_type"), e.filter("value > 90"))


@query("set_catchup_first_source", "WITH u AS (SELECT o_custkey AS k, 0 AS source FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 3 FROM customer) SELECT k, CAST(min(source) AS BIGINT) AS source FROM u GROUP BY k")
def set_catchup(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = F.col("o_custkey").alias("k")
    parts = [o.filter("o_orderstatus = 'P'").select(k), o.filter("o_orderstatus = 'O'").select(k), c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")), c.select(F.col("c_custkey").alias("k"))]
    return R.first_source(parts, "k").select("k", *BIG("source"))


@query("set_entry_files", WITH10 + "SELECT file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN files s ON s.file_id = e.src WHERE e.dst = f.file_id AND s.module = f.module)")
def set_entry_files(spark, d):
    f = S.files(spark, d)
    inner = R.module_edges(S.edges(spark, d), f).filter("source = target").select(F.col("dst").alias("file_id"))
    return f.join(inner, "file_id", "left_anti").select("file_id")


@query("set_affected_union", WITH10 + "SELECT DISTINCT src AS file_id FROM edges WHERE dst IN (SELECT file_id FROM files WHERE language LIKE 'S%')")
def set_affected(spark, d):
    f = S.files(spark, d).filter("language LIKE 'S%'").select(F.col("file_id").alias("dst"))
    return S.edges(spark, d).join(f, "dst", "left_semi").select(F.col("src").alias("file_id")).distinct()


# --- projections and filters -----------------------------------------------


@query("prj_stable_ids", f"WITH {S.FILES} SELECT file_id, sha256(path) AS id, sha256(path || '|' || module || '|' || language) AS symbol FROM files")
def prj_ids(spark, d):
    return S.files(spark, d).select("file_id", X.stable_id("path").alias("id"), X.stable_id("path", "module", "language").alias("symbol"))


@query("prj_complexity", "SELECT doc_id, CASE WHEN n_chars < 4000 THEN 'simple' WHEN n_chars < 20000 THEN 'moderate' ELSE 'complex' END AS complexity, CAST(floor(length(text) / 3) AS BIGINT) AS tokens FROM documents")
def prj_complexity(spark, d):
    return table(spark, d, "documents").select("doc_id", X.complexity(F.col("n_chars")).alias("complexity"), X.token_estimate(F.col("text")).alias("tokens"))


@query("prj_entry_kind", """WITH s AS (SELECT p_partkey, '@app.' || CASE p_partkey % 7 WHEN 0 THEN 'get(''/a'')' WHEN 1 THEN 'click.command(''x'')' WHEN 2 THEN 'on_event(''e'')' WHEN 3 THEN 'cron' ELSE 'plain' END AS dec, CASE p_partkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'AService' WHEN 2 THEN 'BModel' ELSE 'x' END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'function' END AS t FROM part)
 SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'route' WHEN p_partkey % 7 = 1 THEN 'cli' WHEN p_partkey % 7 = 2 THEN 'event' WHEN p_partkey % 7 = 3 THEN 'cron' WHEN name = 'main' THEN 'entrypoint' WHEN t = 'class' AND name = 'AService' THEN 'service' WHEN t = 'class' AND name = 'BModel' THEN 'model' END AS kind, nullif(regexp_extract(dec, '''([^'']+)''', 1), '') AS quoted FROM s""")
def prj_entry_kind(spark, d):
    k = F.col("p_partkey")
    dec = F.concat(F.lit("@app."), F.when(k % 7 == 0, "get('/a')").when(k % 7 == 1, "click.command('x')").when(k % 7 == 2, "on_event('e')").when(k % 7 == 3, "cron").otherwise("plain"))
    name = F.when(k % 5 == 0, "main").when(k % 5 == 1, "AService").when(k % 5 == 2, "BModel").otherwise("x")
    kind = X.entry_kind(F.array(dec), name, F.when(k % 2 == 0, "class").otherwise("function"), F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", kind.alias("kind"), X.quoted(dec).alias("quoted"))


@query("prj_finding_id", "SELECT event_id, substr(sha256(event_type || '|' || 'f' || CAST(user_id AS VARCHAR) || '|' || trim(regexp_replace(regexp_replace(regexp_replace(lower(event_type || ' of an item ' || CAST(event_id AS VARCHAR)), '\\b[a-z_][a-z0-9_]{0,2}\\b', '', 'g'), '[0-9]+', '', 'g'), '\\s+', ' ', 'g')) || '|' || 'f' || CAST(user_id AS VARCHAR)), 1, 16) AS id FROM events")
def prj_finding_id(spark, d):
    path = F.concat(F.lit("f"), F.col("user_id").cast("string"))
    title = F.concat(F.col("event_type"), F.lit(" of an item "), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", X.finding_id(F.col("event_type"), path, title).alias("id"))


@query("prj_risk_score", "SELECT l_orderkey, l_linenumber, l_partkey, round(2 * ln(1 + l_quantity) + 3 * l_discount + 1.5 * ln(1 + l_linenumber + floor(l_tax * 100)), 6) AS score FROM lineitem")
def prj_risk_score(spark, d):
    score = X.risk_score(F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber"), F.floor(F.col("l_tax") * 100))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 6).alias("score"))


@query("flt_test_paths", f"WITH {S.FILES}, p AS (SELECT file_id, CASE file_id % 4 WHEN 0 THEN path || '.test.ts' WHEN 1 THEN 'a/Tests/' || path WHEN 2 THEN 'a/tests_x/' || path ELSE path || '.SPEC.js' END AS path FROM files) SELECT file_id, path FROM p WHERE NOT (" + " OR ".join(f"contains(lower(path), '{m}')" for m in X.TEST_MARKS) + ")")
def flt_test_paths(spark, d):
    p = S.files(spark, d).select("file_id", F.expr("CASE file_id % 4 WHEN 0 THEN concat(path, '.test.ts') WHEN 1 THEN concat('a/Tests/', path) WHEN 2 THEN concat('a/tests_x/', path) ELSE concat(path, '.SPEC.js') END").alias("path"))
    return p.filter(~X.is_test_path(F.col("path")))


@query("flt_ignore_rules", f"WITH {S.FILES} SELECT path FROM files WHERE NOT (regexp_matches(path, '^.*1$') OR list_contains(string_split(path, '/'), 'Brand#12') OR regexp_matches(path, '^Brand#2./.*/..$'))")
def flt_ignore_rules(spark, d):
    from loomgraph.sources.scan import ignored

    return S.files(spark, d).filter(~ignored(F.col("path"), ["*1", "Brand#12/", "Brand#2?/*/??"])).select("path")


@query("flt_commented_keywords", f"WITH {S.LINES}, c AS (SELECT doc_id, line, lower(trim('# ' || content)) AS t FROM lines), k AS (SELECT doc_id, line, CASE WHEN contains(t, 'token') THEN 'token' WHEN contains(t, 'password') THEN 'password' WHEN contains(t, 'licens') THEN 'licens' END AS keyword FROM c) SELECT doc_id AS file_id, keyword, min(line) AS line FROM k WHERE keyword IS NOT NULL GROUP BY 1, 2")
def flt_commented(spark, d):
    c = S.lines(spark, d).select(F.col("doc_id").alias("file_id"), "line", F.concat(F.lit("# "), "content").alias("content"))
    return V.commented_keywords(c, ["token", "password", "licens"])


# --- incremental and control plane -----------------------------------------

DISK = "k AS (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0), i AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE md5(text) END AS was FROM documents WHERE doc_id % 7 <> 0)"


@query("str_incremental_diff", f"WITH {DISK}, d AS (SELECT doc_id, md5(text) AS now, trim(text) = '' AS blank FROM documents WHERE doc_id % 11 <> 0) SELECT CAST(coalesce(d.doc_id, i.doc_id) AS VARCHAR) AS path, CASE WHEN now IS NULL THEN 'deleted' WHEN blank THEN 'skipped' WHEN was IS NULL THEN 'new' WHEN was <> now THEN 'changed' ELSE 'unchanged' END AS state FROM d FULL JOIN i ON d.doc_id = i.doc_id")
def str_incremental(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.md5("text").alias("hash"), (F.trim("text") == "").alias("blank"))
    index = docs.filter("doc_id % 7 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")))
    return I.changes(docs.filter("doc_id % 11 <> 0"), index)


@query("str_supersede_latest", "SELECT user_id, event_id AS latest, n - 1 AS superseded FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def str_supersede(spark, d):
    return I.supersede(table(spark, d, "events"), "user_id", "ts", "event_id")


@query("str_stuck_jobs", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 100000 MINUTES")
def str_stuck(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    now = o.agg(F.max("o_orderdate").alias("now"))  # one row
    return o.filter("o_orderstatus = 'O'").join(F.broadcast(now), F.expr("o_orderdate < now - INTERVAL 100000 MINUTES")).select("o_orderkey")


@query("str_staleness", "WITH v AS (SELECT c_custkey, count(o_orderkey) AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), m AS (SELECT max(version) AS newest FROM v) SELECT c_custkey, version, newest - version AS behind, version < newest AS stale FROM v, m")
def str_staleness(spark, d):
    v = table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("version")), "c_custkey", "left").na.fill(0, ["version"])
    m = v.agg(F.max("version").alias("newest"))
    return v.join(F.broadcast(m), F.lit(True)).select("c_custkey", "version", (F.col("newest") - F.col("version")).alias("behind"), (F.col("version") < F.col("newest")).alias("stale"))


@query("str_index_complete", "WITH e AS (SELECT doc_id FROM documents WHERE length(trim(text)) > 0), i AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) SELECT count(*) AS expected, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM i)) AS missing, count(*) > 0 AND count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM i)) = 0 AS complete FROM e")
def str_complete(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return I.index_complete(docs.filter("length(trim(text)) > 0").select("path"), docs.filter("path % 7 <> 0").select("path"))


@query("str_sliding_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events")
def str_sliding(spark, d):
    w = W.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-3600, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(w).alias("n"))


@query("ops_upsert", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 'new ' || c_name, 0.0 FROM customer WHERE c_custkey % 10 = 0")
def ops_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 10 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return R.upsert(c, new, ["c_custkey"])


@query("ops_run_compare", "WITH a AS (SELECT lang AS metric, CAST(count(*) AS DOUBLE) AS v FROM documents WHERE doc_id % 2 = 0 AND lang <> 'de' GROUP BY 1), b AS (SELECT lang AS metric, CAST(count(*) AS DOUBLE) AS v FROM documents WHERE doc_id % 2 = 1 AND lang <> 'fr' GROUP BY 1) SELECT coalesce(a.metric, b.metric) AS metric, coalesce(a.v, 0.0) AS before, coalesce(b.v, 0.0) AS after, coalesce(b.v, 0.0) - coalesce(a.v, 0.0) AS delta FROM a FULL JOIN b ON a.metric = b.metric")
def ops_run_compare(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.col("lang").alias("metric"))
    run = lambda df: df.groupBy("metric").agg(F.count("*").cast("double").alias("value"))
    return V.compare_runs(run(t.filter("doc_id % 2 = 0 AND metric <> 'de'")), run(t.filter("doc_id % 2 = 1 AND metric <> 'fr'")))


@query("ops_graph_validate", f"WITH {S.edges_sql()}, n AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 50 <> 0 UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 77 = 0 AND p_partkey % 50 <> 0) SELECT 'duplicate_node' AS problem, id FROM n GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'dangling_edge', id FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM n)")
def ops_graph_validate(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id")).filter("id % 50 <> 0")
    return V.graph_violations(p.unionByName(p.filter("id % 77 = 0")), S.edges(spark, d))
