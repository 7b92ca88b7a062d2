"""Registered queries: composed answers and the control plane, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import control as K
from loomgraph.operators import reports as Q
from loomgraph.plans import standins as S
from loomgraph.plans.catalogue import query
from loomgraph.plans.core import BIG, DEPS500, RISK, WITH10
from loomgraph.plans.graphs import reach_sql
from loomgraph.session import table


@query("ret_module_blast", reach_sql() + f", x AS (SELECT a.module, m.node, b.path, min(m.depth) AS depth FROM m JOIN files a ON a.file_id = m.root JOIN files b ON b.file_id = m.node WHERE a.module <> b.module GROUP BY 1, 2, 3), t AS (SELECT count(*) AS total FROM files), c AS (SELECT module, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, count(DISTINCT string_split(path, '/')[1]) AS projects, count(*) AS affected FROM x GROUP BY module) SELECT module, direct, transitive, projects, affected, {RISK} AS risk FROM c, t")
def ret_module_blast(spark, d):
    return Q.module_blast(S.tree(spark, d), S.files(spark, d)).select("module", *BIG("direct", "transitive"), "projects", *BIG("affected"), "risk")


@query("ret_execution_flow", WITH10 + "SELECT src, dst, a.module AS source, b.module AS target, CASE WHEN a.module = b.module THEN 'inside' ELSE 'cross' END AS scope FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst")
def ret_flow(spark, d):
    return Q.execution_flow(S.edges(spark, d), S.files(spark, d))


@query("ret_overview", DEPS500 + ", c AS (SELECT target AS module, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, module LIMIT 3) SELECT 'size' AS kind, 'files' AS name, count(*) AS value FROM files UNION ALL SELECT 'size', 'edges', count(*) FROM edges UNION ALL SELECT 'entry', module, 0 FROM (SELECT DISTINCT module FROM files) WHERE module NOT IN (SELECT target FROM x) UNION ALL SELECT 'core', module, n FROM c")
def ret_overview(spark, d):
    return Q.overview(S.edges(spark, d), S.files(spark, d))


@query("ret_module_details", WITH10 + ", l AS (SELECT module, CAST(count(*) AS BIGINT) AS file_count FROM files GROUP BY 1), e AS (SELECT module, count(*) AS entries FROM files f WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN files s ON s.file_id = e.src WHERE e.dst = f.file_id AND s.module = f.module) GROUP BY 1), x AS (SELECT a.module AS s, b.module AS t FROM edges JOIN files a ON a.file_id = src JOIN files b ON b.file_id = dst WHERE a.module <> b.module) SELECT module, file_count, coalesce(entries, 0) AS entries, (SELECT count(*) FROM x WHERE s = module) AS outgoing, (SELECT count(*) FROM x WHERE t = module) AS incoming FROM l LEFT JOIN e USING (module)")
def ret_module_details(spark, d):
    return Q.module_details(S.edges(spark, d), S.files(spark, d)).select("module", "file_count", "entries", "outgoing", "incoming")


@query("ret_explain_symbol", f"WITH {S.CALLS}, k AS (SELECT 1 AS own), r AS (SELECT DISTINCT 'caller' AS relation, caller AS symbol_id, line FROM calls, k WHERE callee = own AND caller <> own UNION SELECT DISTINCT 'callee', callee, line FROM calls, k WHERE caller = own AND callee <> own) SELECT relation, symbol_id, CAST(line AS BIGINT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY symbol_id, line) AS rn FROM r) WHERE rn <= 10")
def ret_explain(spark, d):
    calls = S.calls(spark, d).filter("caller <> callee")
    ids = calls.select(F.col("caller").alias("symbol_id")).unionByName(calls.select(F.col("callee").alias("symbol_id"))).distinct()
    symbols = ids.withColumn("name", F.lpad(F.col("symbol_id").cast("string"), 12, "0"))
    return Q.explain_symbol(calls, symbols, "000000000001").select("relation", "symbol_id", *BIG("line"))


@query("ops_next_version", "SELECT o_custkey AS repo, max(CAST(o_orderkey AS BIGINT)) + 1 AS version FROM orders GROUP BY 1")
def ops_next(spark, d):
    return K.next_version(table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("version")))


@query("str_version_outdated", "SELECT p_partkey, 'v' || (p_partkey % 3) || '.' || (p_partkey % 12) || '.' || p_size AS version, (p_partkey % 3, p_partkey % 12, p_size) < (1, 10, 2) AS outdated FROM part")
def str_outdated(spark, d):
    v = F.concat(F.lit("v"), (F.col("p_partkey") % 3).cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string"), F.lit("."), F.col("p_size").cast("string"))
    return K.outdated(table(spark, d, "part").select("p_partkey", v.alias("version")), "1.10.2")


@query("ops_stale_sessions", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 24000 HOURS THEN 'abandoned' WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def ops_sessions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "open").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").alias("updated_at"))
    now = o.agg(F.max("updated_at").alias("now"))  # one row
    return K.abandon(o.join(F.broadcast(now), F.lit(True)), F.col("now"), 24000).select("o_orderkey", "status")


@query("ops_cache_keys", "SELECT c_custkey, substr(sha256(c_name || '|' || CAST(c_nationkey AS VARCHAR) || '|' || c_mktsegment), 1, 24) AS key FROM customer")
def ops_cache(spark, d):
    return table(spark, d, "customer").select("c_custkey", K.cache_key(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("key"))


@query("snk_route_chunks", "WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - p_partkey % 10 END AS parent_id FROM part) SELECT id, CASE WHEN id IN (SELECT parent_id FROM c WHERE parent_id IS NOT NULL) THEN 'parent' ELSE 'child' END AS kind FROM c")
def snk_route(spark, d):
    c = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - p_partkey % 10 END").alias("parent_id"))
    parents, children = K.route_chunks(c)
    return parents.select("id", F.lit("parent").alias("kind")).unionByName(children.select("id", F.lit("child").alias("kind")))
