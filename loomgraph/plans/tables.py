"""Registered queries: rows of the graph's tables, review batches and snippets, evaluation; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import batching as B
from loomgraph.operators import evaluation as E
from loomgraph.operators import relational as R
from loomgraph.operators import store as K
from loomgraph.plans import standins as S
from loomgraph.plans.catalogue import query
from loomgraph.plans.core import BIG, CROSS, WITH10
from loomgraph.session import table

# expressions that both dialects read: symbols are parts, ten to a file; every fifth is a class, of which most others are members
SYM = [
    "p_partkey AS symbol_id", "CAST(floor(p_partkey / 10) AS BIGINT) AS file_id", "concat('n', p_partkey % 64) AS name", "CASE WHEN p_partkey % 5 = 0 THEN 'class' ELSE 'function' END AS type",
    "CASE WHEN p_partkey % 5 > 1 THEN concat('n', (p_partkey - p_partkey % 5) % 64) END AS parent_class", "CAST(p_size AS BIGINT) AS start_line",
]
CALL = ["l_partkey AS caller", "l_suppkey * 7 AS callee", "CAST(l_linenumber AS BIGINT) AS line"]
PATH = "concat('d', file_id % 7, '/', CASE file_id % 4 WHEN 0 THEN concat('f', file_id, '.py') WHEN 1 THEN concat('test_f', file_id - 1, '.py') WHEN 2 THEN concat('g', file_id, '.test.ts') ELSE concat('g', file_id - 1, '.ts') END)"
SYMS = f"s AS (SELECT {', '.join(SYM)} FROM part), cl AS (SELECT file_id, name, max(symbol_id) AS cid FROM s WHERE type = 'class' GROUP BY 1, 2)"
CALLS = f"c AS (SELECT DISTINCT {', '.join(CALL)} FROM lineitem)"
PATHS = f"p AS (SELECT p_partkey AS ordinal, {PATH.replace('file_id', 'p_partkey')} AS path FROM part)"


def _symbols(spark, d):
    return table(spark, d, "part").selectExpr(*SYM)


def _calls(spark, d):
    return table(spark, d, "lineitem").selectExpr(*CALL).distinct()


def _paths(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey AS ordinal", f"{PATH.replace('file_id', 'p_partkey')} AS path")


# --- rows of the tables ----------------------------------------------------


@query("snk_file_rows", f"WITH {S.FILES} SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'root' ELSE module END AS module FROM files")
def snk_files(spark, d):
    f = S.files(spark, d)
    return K.file_rows(f.select("file_id", "path"), f.filter("file_id % 3 <> 0")).select("file_id", "module")


@query("snk_import_rows", WITH10 + "SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT file_id FROM files WHERE language LIKE '%S%') AND dst IN (SELECT file_id FROM files WHERE language LIKE '%S%')")
def snk_imports(spark, d):
    return R.edges_within(S.edges(spark, d), S.files(spark, d).filter("language LIKE '%S%'").select(F.col("file_id").alias("id")))


@query("snk_hierarchy", f"WITH {SYMS} SELECT DISTINCT s.symbol_id AS class_id, cid AS parent_id FROM s JOIN cl ON cl.file_id = s.file_id AND cl.name = concat('n', (s.symbol_id + 5) % 64) WHERE s.type = 'class' AND s.symbol_id <> cid")
def snk_hierarchy(spark, d):
    return K.hierarchy(_symbols(spark, d).withColumn("bases", F.array(F.expr("concat('n', (symbol_id + 5) % 64)"), F.lit("Base"))))


@query("snk_members", f"WITH {SYMS} SELECT DISTINCT cid AS class_id, symbol_id AS member_id FROM s JOIN cl ON cl.file_id = s.file_id AND cl.name = s.parent_class")
def snk_members(spark, d):
    return K.members(_symbols(spark, d))


@query("jn_class_nodes", f"WITH {SYMS}, o AS (SELECT * FROM s WHERE start_line > 10), oc AS (SELECT file_id, name, max(symbol_id) AS cid FROM o WHERE type = 'class' GROUP BY 1, 2) SELECT symbol_id, cid AS class_id FROM o LEFT JOIN oc ON oc.file_id = o.file_id AND oc.name = o.parent_class")
def jn_class_nodes(spark, d):
    s = _symbols(spark, d)
    return K.class_nodes(s, s.filter("start_line > 10"))


@query("snk_symbol_metadata", "SELECT p_partkey AS symbol_id, CASE WHEN p_partkey % 7 = 0 THEN 'route' WHEN p_partkey % 7 = 1 THEN 'cli' ELSE 'entrypoint' END AS kind, CASE WHEN p_partkey % 7 = 0 THEN 'GET' END AS http_method, CASE WHEN p_partkey % 7 = 0 THEN '/a' END AS http_path FROM part WHERE p_partkey % 7 < 2 OR p_partkey % 11 = 0")
def snk_metadata(spark, d):
    k = F.col("p_partkey")
    dec = F.when(k % 7 == 0, "@app.get('/a')").when(k % 7 == 1, "@click.command()").otherwise("@plain")
    s = table(spark, d, "part").select(k.alias("symbol_id"), F.when(k % 11 == 0, "main").otherwise("x").alias("name"), F.lit("function").alias("type"), F.array().cast("array<string>").alias("bases"), F.array(dec).alias("decorators"))
    return K.metadata_rows(s)


@query("snk_module_rows", CROSS + " SELECT DISTINCT source AS module, target FROM x")
def snk_modules(spark, d):
    deps = R.module_deps(S.edges(spark, d), S.files(spark, d)).groupBy(F.col("source").alias("module")).agg(F.collect_set("target").alias("depends_on"))
    return K.module_rows(deps.withColumn("files", F.array().cast("array<bigint>")))[1]


@query("snk_chunk_rows", f"WITH {SYMS}, l AS (SELECT file_id, name, max(symbol_id) AS symbol_id FROM s GROUP BY 1, 2), k AS (SELECT p_partkey AS chunk_id, CAST(floor(p_partkey / 10) AS BIGINT) AS file_id, concat('n', (p_partkey + p_size % 9) % 64) AS symbol_name FROM part) SELECT chunk_id, k.file_id, symbol_name, symbol_id FROM k LEFT JOIN l ON l.file_id = k.file_id AND l.name = symbol_name")
def snk_chunks(spark, d):
    k = table(spark, d, "part").selectExpr("p_partkey AS chunk_id", "CAST(floor(p_partkey / 10) AS BIGINT) AS file_id", "concat('n', (p_partkey + p_size % 9) % 64) AS symbol_name")
    return K.chunk_rows(k.unionByName(k), _symbols(spark, d))


@query("snk_backfill", "SELECT vec_id AS chunk_id, CAST(label AS BIGINT) AS parent_id FROM embeddings")
def snk_backfill(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("parent_id"))
    return K.backfilled(K.cleared(v)[0], v)


@query("snk_document_rows", "SELECT doc_id, CAST(length(CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 15000) ELSE text END) AS BIGINT) AS n FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def snk_documents(spark, d):
    t = table(spark, d, "documents")
    return K.document_rows(t.filter("doc_id % 2 = 0"), t.filter("doc_id % 3 = 0")).select("doc_id", F.char_length("text").cast("bigint").alias("n"))


@query("snk_manifest", WITH10 + "SELECT 7::BIGINT AS version, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM documents) AS chunks, (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM files) AS languages, (SELECT count(*) FROM part) AS graph_nodes, (SELECT count(*) FROM edges) AS graph_edges")
def snk_manifest(spark, d):
    m = K.manifest(S.files(spark, d), table(spark, d, "documents"), 7)
    return K.with_graph(m, table(spark, d, "part"), S.edges(spark, d)).withColumn("version", F.col("version").cast("bigint"))


@query("snk_without_file", "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY source HAVING count(*) > 20)")
def snk_without(spark, d):
    from loomgraph.operators.control import without_file

    t = table(spark, d, "documents").select("doc_id", F.col("source").alias("path"))
    gone = t.groupBy("path").count().filter("count > 20")
    return without_file(t, gone).select("doc_id", F.col("path").alias("source"))


@query("src_indexed_paths", "SELECT DISTINCT source AS path FROM documents")
def src_paths(spark, d):
    return K.indexed_paths(table(spark, d, "documents").select(F.col("source").alias("path")))


@query("src_first_hashes", "SELECT source AS path, md5(text) AS hash FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def src_first_hashes(spark, d):
    return K.first_hashes(table(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("ordinal"), F.md5("text").alias("hash")))


@query("srt_symbols_of_file", f"WITH {SYMS} SELECT symbol_id, name, start_line FROM s WHERE file_id = 3 ORDER BY start_line, symbol_id")
def srt_symbols(spark, d):
    return K.symbols_of(_symbols(spark, d), 3).select("symbol_id", "name", "start_line")


@query("jn_symbols_by_file", f"WITH {SYMS} SELECT file_id, string_agg(name, ',' ORDER BY start_line, symbol_id) AS names FROM s WHERE file_id IN (SELECT file_id FROM s WHERE start_line = 50) GROUP BY file_id")
def jn_symbols_by_file(spark, d):
    s = _symbols(spark, d)
    return K.symbols_by_file(s, s.filter("start_line = 50"))


@query("jn_rows_by_id", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)")
def jn_rows_by_id(spark, d):
    wanted = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("doc_id"))
    return K.rows_by_id(table(spark, d, "documents").select("doc_id", "lang"), wanted, "doc_id")


FAN = f"WITH {S.FILES}, {S.edges_sql()}, {SYMS}, {CALLS}, a AS (SELECT dst AS file_id, count(*) AS affected FROM edges WHERE dst % 2 = 0 GROUP BY 1), m AS (SELECT file_id, max(n) AS n FROM (SELECT file_id, callee, count(DISTINCT caller) AS n FROM c JOIN s ON symbol_id = callee GROUP BY 1, 2) GROUP BY 1), fi AS (SELECT p_partkey AS file_id, coalesce(nullif(affected, 0), nullif(n, 0), least(p_size * 2, 50)) AS fan_in, p_size FROM part LEFT JOIN a ON a.file_id = p_partkey LEFT JOIN m ON m.file_id = p_partkey)"


def _fan_in(spark, d):
    reached = S.edges(spark, d).filter("dst % 2 = 0").groupBy(F.col("dst").alias("file_id")).agg(F.count("*").alias("affected"))
    files = table(spark, d, "part").selectExpr("p_partkey AS file_id", "p_size * 2 AS changed")
    return K.fan_in(files, _symbols(spark, d), _calls(spark, d), reached)


@query("agg_fan_in", FAN + " SELECT file_id, CAST(fan_in AS BIGINT) AS fan_in FROM fi")
def agg_fan_in(spark, d):
    return _fan_in(spark, d)


@query("jn_risk_annotations", FAN + ", r AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 0.25 ELSE least(fan_in / 500, 1.0) END AS pr, fan_in, p_size FROM fi) SELECT file_id, CAST(fan_in AS BIGINT) AS fan_in, round(pr, 6) AS pagerank, CASE WHEN file_id % 3 = 0 THEN 2.0 ELSE 0.0 END AS betweenness, file_id % 4 = 0 AS in_cycle, round(2 * ln(fan_in + 1) + 3 * pr + 1.5 * ln(p_size + 3), 6) AS score FROM r")
def jn_annotations(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey AS file_id", "p_size AS added", "2 AS removed")
    ranks = p.filter("file_id % 3 = 0").select("file_id", F.lit(0.25).alias("pagerank"), F.lit(2.0).alias("betweenness"))
    out = K.annotations(_fan_in(spark, d).join(p, "file_id"), ranks, p.filter("file_id % 4 = 0"))
    return out.withColumn("pagerank", F.round("pagerank", 6)).withColumn("score", F.round("score", 6))


@query("prj_risk_text", """WITH t AS (SELECT p_partkey, concat_ws(', ', CASE WHEN p_size > 25 THEN concat(p_size, ' affected file(s)') END, CASE WHEN p_size % 3 = 0 THEN concat(p_size, ' direct callers') END, CASE WHEN p_size % 5 = 0 THEN 'PageRank 0.25' END, CASE WHEN p_size % 7 = 0 THEN 'in circular dependency' END, CASE WHEN p_size % 11 = 0 THEN 'architectural bottleneck' END) AS t FROM part)
 SELECT p_partkey, CASE WHEN t = '' THEN '' ELSE concat('⚠️ HIGH BLAST RADIUS (f', p_partkey, '): ', t, '. Review with extra care.') END AS note FROM t""")
def prj_risk_text(spark, d):
    s = F.col("p_size")
    note = K.risk_text(F.concat(F.lit("f"), F.col("p_partkey").cast("string")), F.when(s > 25, s).otherwise(0), F.when(s % 3 == 0, s), F.when(s % 5 == 0, F.lit(0.25)), s % 7 == 0, s % 11 == 0)
    return table(spark, d, "part").select("p_partkey", note.alias("note"))


@query("prj_summary_text", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'GET /a' WHEN 1 THEN 'route /a' WHEN 2 THEN 'CLI: run' WHEN 3 THEN 'Event: e' WHEN 4 THEN 'Http Route' ELSE '' END AS summary FROM part")
def prj_summary(spark, d):
    k = F.col("p_partkey") % 6
    text = K.summary_text(F.when(k == 4, "http_route"), F.when(k == 0, "GET"), F.when(k < 2, "/a"), F.when(k == 3, "e"), F.when(k == 2, "run"))
    return table(spark, d, "part").select("p_partkey", text.alias("summary"))


JOBS = ["o_orderkey AS job_id", "o_custkey AS repo", "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END AS status", "o_orderdate AS queued_at"]


@query("agg_open_jobs", "SELECT count(*) FILTER (o_orderstatus IN ('O', 'P')) AS open_jobs, count(DISTINCT o_custkey) FILTER (o_orderstatus = 'P') AS indexing FROM orders")
def agg_open_jobs(spark, d):
    return K.open_jobs(table(spark, d, "orders").selectExpr(*JOBS))


@query("srt_queue_head", "SELECT o_orderkey AS job_id, o_custkey AS repo FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def srt_queue_head(spark, d):
    return K.queue_head(table(spark, d, "orders").selectExpr(*JOBS)).select("job_id", "repo")


@query("str_claim_oldest", "WITH h AS (SELECT o_orderkey AS h FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1) SELECT o_orderkey AS job_id, CASE WHEN o_orderkey = h OR o_orderstatus = 'P' THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'done' END AS status FROM orders, h")
def str_claim(spark, d):
    return K.claim(table(spark, d, "orders").selectExpr(*JOBS), F.current_timestamp()).select("job_id", "status")


# --- review batches and snippets -------------------------------------------


@query("prj_prompt_tokens", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(40000, (l_quantity * 300 + l_linenumber + 200) * 5) + CASE WHEN l_returnflag = 'R' THEN 0 ELSE least(20000, floor(l_extendedprice / 3)) END + 50 AS BIGINT) AS tokens FROM lineitem")
def prj_prompt_tokens(spark, d):
    n = B.prompt_tokens(F.col("l_quantity") * 300, F.col("l_linenumber"), F.col("l_returnflag") == "R", F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", n.alias("tokens"))


ANY = lambda marks, col="lower(path)": "(" + " OR ".join(f"contains({col}, '{m}')" for m in marks) + ")"
TEST = ANY(B.BATCH_TEST_MARKS)[:-1] + " OR lower(path) LIKE 'test/%' OR lower(path) LIKE 'tests/%')"


@query("flt_test_variants", f"WITH {PATHS} SELECT ordinal, {TEST} AS batching, (contains(lower(path), '.test.') OR contains(lower(path), '.spec.') OR lower(path) LIKE 'test\\_%' ESCAPE '\\' OR lower(path) LIKE '%\\_test.py' ESCAPE '\\') AS snippet FROM p")
def flt_test_variants(spark, d):
    return _paths(spark, d).select("ordinal", B.is_batch_test(F.col("path")).alias("batching"), B.is_snippet_test(F.col("path")).alias("snippet"))


@query("flt_code_files", "WITH n AS (SELECT p_partkey, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.md' WHEN 2 THEN '.test.ts' ELSE '' END) AS path FROM part) SELECT p_partkey FROM n WHERE p_partkey % 4 IN (0, 2)")
def flt_code(spark, d):
    n = table(spark, d, "part").selectExpr("p_partkey", "concat(replace(p_name, '.', ''), CASE p_partkey % 4 WHEN 0 THEN '.PY' WHEN 1 THEN '.md' WHEN 2 THEN '.test.ts' ELSE '' END) AS path")
    return n.filter(B.is_code(F.col("path"))).select("p_partkey")


@query("flt_noisy_symbols", "SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0")
def flt_noisy(spark, d):
    return table(spark, d, "part").filter(~B.is_noisy(F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('_', p_name) ELSE p_name END"))).select("p_partkey")


@query("jn_test_pairs", f"WITH {PATHS} SELECT a.path AS source, b.path AS test FROM p a JOIN p b ON (a.ordinal % 4 = 0 AND b.ordinal = a.ordinal + 1) OR (a.ordinal % 4 = 3 AND b.ordinal = a.ordinal - 1)")
def jn_test_pairs(spark, d):
    return B.test_pairs(_paths(spark, d))


@query("win_review_batches", f"""WITH RECURSIVE {PATHS}, t AS (SELECT a.ordinal, a.path, b.path AS test, split_part(a.path, '/', 1) AS folder FROM p a LEFT JOIN p b ON (a.ordinal % 4 = 0 AND b.ordinal = a.ordinal + 1) OR (a.ordinal % 4 = 3 AND b.ordinal = a.ordinal - 1) WHERE a.ordinal % 4 IN (0, 3)
 UNION ALL SELECT x.ordinal, x.path, NULL, NULL FROM p x WHERE x.ordinal % 4 IN (1, 2) AND NOT EXISTS (SELECT 1 FROM p y WHERE (x.ordinal % 4 = 1 AND y.ordinal = x.ordinal - 1) OR (x.ordinal % 4 = 2 AND y.ordinal = x.ordinal + 1))),
 k AS (SELECT *, CASE WHEN test IS NULL THEN 1 ELSE 2 END AS size, row_number() OVER (PARTITION BY folder ORDER BY ordinal) AS k FROM t),
 f AS (SELECT folder, path, test, k, size AS used, 0 AS batch FROM k WHERE k = 1 UNION ALL
 SELECT k.folder, k.path, k.test, k.k, CASE WHEN f.used >= 5 THEN k.size ELSE f.used + k.size END, CASE WHEN f.used >= 5 THEN f.batch + 1 ELSE f.batch END FROM f JOIN k ON k.folder IS NOT DISTINCT FROM f.folder AND k.k = f.k + 1)
 SELECT folder, CAST(batch AS BIGINT) AS batch, path FROM f UNION ALL SELECT folder, CAST(batch AS BIGINT), test FROM f WHERE test IS NOT NULL""")
def win_review_batches(spark, d):
    return B.review_batches(_paths(spark, d))


@query("win_token_split", """WITH RECURSIVE t AS (SELECT o_custkey AS batch, o_orderkey AS ordinal, CAST(floor(o_totalprice) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
 f AS (SELECT batch, ordinal, k, tokens AS used, 0 AS part FROM t WHERE k = 1 UNION ALL SELECT t.batch, t.ordinal, t.k, CASE WHEN f.used > 0 AND f.used + t.tokens > 399000 THEN t.tokens ELSE f.used + t.tokens END, CASE WHEN f.used > 0 AND f.used + t.tokens > 399000 THEN f.part + 1 ELSE f.part END FROM f JOIN t ON t.batch = f.batch AND t.k = f.k + 1)
 SELECT batch, ordinal, CAST(part AS BIGINT) AS part FROM f""")
def win_token_split(spark, d):
    o = table(spark, d, "orders").selectExpr("o_custkey AS batch", "o_orderkey AS ordinal", "CAST(floor(o_totalprice) AS BIGINT) AS tokens")
    return B.split_by_tokens(o, 400_000, 1000)


@query("jn_caller_snippets", f"WITH {SYMS}, {CALLS}, m AS (SELECT t.file_id, u.file_id AS caller_file, line, row_number() OVER (PARTITION BY callee ORDER BY line, u.file_id, caller) AS rn FROM c JOIN s t ON t.symbol_id = callee JOIN s u ON u.symbol_id = caller WHERE t.file_id IN (SELECT file_id FROM s WHERE start_line > 40)) SELECT DISTINCT file_id, caller_file, greatest(1, line - 5) AS \"start\", line + 25 AS \"end\" FROM m WHERE rn <= 5")
def jn_callers_near(spark, d):
    s = _symbols(spark, d)
    return B.caller_snippets(_calls(spark, d), s, s.filter("start_line > 40"))


@query("jn_tests_near", f"WITH {PATHS} SELECT a.path, b.path AS test FROM p a JOIN p b ON (a.ordinal % 4 = 3 AND b.ordinal = a.ordinal - 1)")
def jn_tests_near(spark, d):
    p = _paths(spark, d)
    return B.tests_near(p, p.filter("ordinal % 4 = 3"))


@query("jn_interfaces", f"WITH {PATHS} SELECT path, regexp_replace(path, '/[^/]*$', '') || '/' || CASE WHEN ordinal % 2 = 0 THEN 'a.ts' ELSE 'b/index.js' END AS target FROM p WHERE ordinal % 3 <> 2")
def jn_interfaces(spark, d):
    p = _paths(spark, d)
    imports = p.select("path", F.expr("CASE WHEN ordinal % 3 = 2 THEN './gone' WHEN ordinal % 2 = 0 THEN './a' ELSE './b' END").alias("module"))
    folders = p.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct()
    files = folders.select(F.explode(F.array(*[F.concat("f", F.lit(x)) for x in ("/a.ts", "/a.js", "/b/index.js", "/b.py")])).alias("path"))
    return B.interfaces(imports, files)


@query("ret_neighbourhood", """WITH s AS (SELECT user_id AS review, event_id AS ordinal, concat('f', event_id % 13, CASE event_id % 5 WHEN 0 THEN '.test.ts' ELSE '.ts' END) AS path, CASE event_type WHEN 'click' THEN 'caller' WHEN 'view' THEN 'test' ELSE 'interface' END AS source, CAST(floor(value) * 3 + 3 AS BIGINT) AS chars FROM events),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review, path, source ORDER BY ordinal) AS k FROM s) WHERE k = 1),
 p AS (SELECT *, CASE WHEN path IN ('f1.ts', 'f2.ts') THEN 0 WHEN source = 'test' OR path LIKE '%.test.%' THEN 1 WHEN source = 'caller' THEN 2 ELSE 3 END AS priority FROM f),
 r AS (SELECT *, row_number() OVER (PARTITION BY review ORDER BY priority, ordinal) AS rn FROM p),
 u AS (SELECT *, sum(chars // 3) OVER (PARTITION BY review ORDER BY priority, ordinal ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE rn <= 20)
 SELECT review, CAST(rn AS BIGINT) AS rn, path, source, CAST(priority AS BIGINT) AS priority, CAST(used AS BIGINT) AS used FROM u WHERE used <= 300""")
def ret_neighbourhood(spark, d):
    s = table(spark, d, "events").selectExpr("user_id AS review", "event_id AS ordinal", "concat('f', event_id % 13, CASE event_id % 5 WHEN 0 THEN '.test.ts' ELSE '.ts' END) AS path", "CASE event_type WHEN 'click' THEN 'caller' WHEN 'view' THEN 'test' ELSE 'interface' END AS source", "repeat('x', CAST(floor(value) * 3 + 3 AS INT)) AS content")
    changed = spark.createDataFrame([("f1.ts",), ("f2.ts",)], "path string")
    return B.neighbourhood(s, changed, 20, 300).select("review", *BIG("rn"), "path", "source", *BIG("priority", "used"))


@query("src_import_names", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('mod', p_size, ',react') ELSE 'react' END AS names FROM part")
def src_import_names(spark, d):
    text = F.concat(F.lit("import X from 'react'\nimport Y from './near'\n# from x\nimport os\n"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat('  import { Z } from \"mod', p_size, '\";') ELSE '' END"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(B.import_names(text)), ",").alias("names"))


@query("src_line_slice", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents")
def src_line_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", B.lines_of(F.col("text"), F.lit(2), F.lit(4)).alias("part"))


@query("ret_excerpt", f"""WITH {S.LINES}, h AS (SELECT doc_id, max(line) AS n FROM lines GROUP BY doc_id), g AS (SELECT doc_id, 2 AS s, 3 AS e FROM h UNION ALL SELECT doc_id, n // 2 + 3, n // 2 + 3 FROM h), w AS (SELECT *, unnest([20, 10, 5, 2, 0]) AS context FROM g),
 m AS (SELECT DISTINCT l.doc_id, context, line, content FROM lines l JOIN w ON w.doc_id = l.doc_id AND line BETWEEN s - context AND e + context), x AS (SELECT doc_id, context, count(*) AS n_lines, sum(length(content) + 1) AS chars FROM m GROUP BY 1, 2),
 b AS (SELECT doc_id, coalesce(max(context) FILTER (chars // 3 <= 600), min(context)) AS context FROM x GROUP BY 1) SELECT doc_id AS file_id, CAST(context AS BIGINT) AS context, n_lines FROM b JOIN x USING (doc_id, context)""")
def ret_excerpt(spark, d):
    lines = S.lines(spark, d).withColumnRenamed("doc_id", "file_id")
    h = lines.groupBy("file_id").agg(F.max("line").alias("n"))
    hunks = h.selectExpr("file_id", "CAST(2 AS BIGINT) AS start", "CAST(3 AS BIGINT) AS end").unionByName(h.selectExpr("file_id", "n div 2 + 3 AS start", "n div 2 + 3 AS end"))
    return B.excerpt(lines, hunks, 600)


# --- evaluation ------------------------------------------------------------


@query("agg_dataset_counts", "SELECT 'file' AS kind, source AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'category', lang, count(*) FROM documents GROUP BY 2")
def agg_dataset_counts(spark, d):
    return E.dataset_counts(table(spark, d, "documents").select(F.col("source").alias("file"), F.col("lang").alias("category")))


@query("flt_samples", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 3")
def flt_samples(spark, d):
    s = table(spark, d, "events").selectExpr("event_id", "event_type AS category", "CAST(user_id AS STRING) AS tool")
    return E.of_category(s, "click", "3").select("event_id")


@query("ops_sweep", "WITH r AS (SELECT unnest([10.0, 50.0, 90.0, 95.0]) AS t), m AS (SELECT CAST(t AS DOUBLE) AS value, avg(CASE WHEN (value >= t) = (event_type = 'purchase') THEN 1.0 ELSE 0.0 END) AS mean FROM events, r GROUP BY t) SELECT value, round(mean, 6) AS mean FROM m ORDER BY mean DESC, value LIMIT 1")
def ops_sweep(spark, d):
    e = table(spark, d, "events")
    run = lambda threshold: e.select(((F.col("value") >= threshold) == (F.col("event_type") == "purchase")).cast("double").alias("score"))
    return E.best_value(E.sweep(run, "threshold", [10.0, 50.0, 90.0, 95.0])).select("value", F.round("mean", 6).alias("mean"))


@query("agg_merged_queries", "SELECT user_id, bool_or(value > 90) AS confident, max(value) AS confidence, count(*) AS chunks, CAST(sum(event_id % 3) AS BIGINT) AS retries FROM events GROUP BY 1")
def agg_merged(spark, d):
    p = table(spark, d, "events").selectExpr("user_id", "value > 90 AS confident", "value AS confidence", "CAST(1 AS BIGINT) AS chunks", "event_id % 3 AS retries")
    return E.merged_queries(p, "user_id")


@query("jn_scores_by_position", "SELECT event_id AS ordinal, CASE WHEN event_id % 4 <> 0 THEN value END AS score FROM events")
def jn_scores(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("ordinal"), F.col("value").alias("score"))
    return E.with_scores(e.select("ordinal"), e.filter("ordinal % 4 <> 0"))


@query("jn_question_deltas", "SELECT event_id AS ordinal, event_type AS question, round(value / 2, 6) AS delta FROM events WHERE event_id % 3 <> 0")
def jn_deltas(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("question"), F.col("value").alias("score"))
    after = e.select("ordinal", F.expr("CASE WHEN ordinal % 3 = 0 THEN 'other' ELSE question END").alias("question"), (F.col("score") * 1.5).alias("score"))
    return E.question_deltas(e, after).withColumn("delta", F.round("delta", 6))


@query("ops_variants", "WITH v AS (SELECT 'plain' AS variant, avg(value) AS a, avg(event_id % 7) AS b FROM events UNION ALL SELECT 'expanded', avg(value * 2), avg(event_id % 5) FROM events), l AS (SELECT variant, 'confidence' AS metric, a AS mean FROM v UNION ALL SELECT variant, 'kept', b FROM v) SELECT l.variant, l.metric, round(l.mean, 6) AS mean, round(l.mean - r.mean, 6) AS gain FROM l JOIN l r ON r.metric = l.metric AND r.variant = 'plain'")
def ops_variants(spark, d):
    e = table(spark, d, "events")
    runs = E.variants({"plain": e.select(F.col("value").alias("confidence"), (F.col("event_id") % 7).alias("kept")), "expanded": e.select((F.col("value") * 2).alias("confidence"), (F.col("event_id") % 5).alias("kept"))})
    out = E.metric_comparison(runs.withColumn("kept", F.col("kept").cast("double")), "plain", ["confidence", "kept"])
    return out.select("variant", "metric", F.round("mean", 6).alias("mean"), F.round("gain", 6).alias("gain"))


@query("ops_layer_counters", "SELECT user_id, count(*) AS found, count(*) FILTER (value < 75) AS within_distance, count(*) FILTER (value < 75 AND event_type <> 'view') AS graded FROM events GROUP BY 1")
def ops_layers(spark, d):
    return E.layer_counters(table(spark, d, "events"), "user_id", {"within_distance": F.col("value") < 75, "graded": F.col("event_type") != "view"})


@query("agg_run_summary", "SELECT count(*) AS questions, round(avg(value), 6) AS avg_confidence, count(*) FILTER (event_id % 4 = 0) AS without, CAST(sum(event_id % 3) AS BIGINT) AS retries, count(*) FILTER (event_id % 2 = 1) AS expansions FROM events")
def agg_run_summary(spark, d):
    e = table(spark, d, "events").selectExpr("value AS confidence", "event_id % 4 AS kept", "event_id % 3 AS retries", "event_id % 2 = 1 AS expanded")
    return E.run_summary(e).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("set_unmatched", "SELECT 'missed' AS side, event_id AS id FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0 UNION ALL SELECT 'extra', event_id FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def set_unmatched(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"))
    return E.unmatched(e.filter("id % 2 = 0"), e.filter("id % 3 = 0"), "id")


@query("set_keep_ungraded", "SELECT user_id AS q_id, event_id AS position FROM events WHERE event_id % 5 = 0 OR value > 50")
def set_ungraded(spark, d):
    e = table(spark, d, "events").selectExpr("user_id AS q_id", "event_id AS position", "value > 50 AS relevant")
    return E.keep_ungraded(e, e.filter("position % 5 <> 0"))


@query("agg_repeated_queries", "SELECT user_id AS session, event_type AS query, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2")
def agg_repeated(spark, d):
    return E.repeated_queries(table(spark, d, "events").select(F.col("user_id").alias("session"), F.expr("concat(' ', upper(event_type), CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END)").alias("query")))


@query("agg_gathered_findings", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS text FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 ORDER BY id")
def agg_gathered(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"))
    return E.gathered([e.filter("id % 2 = 0").withColumn("text", F.lit("a")), e.filter("id % 3 = 0").withColumn("text", F.lit("b"))])


@query("win_first_appearance", "SELECT doc, chunk, query_ix, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc, chunk ORDER BY query_ix, rank) AS rn FROM (SELECT l_partkey AS doc, l_suppkey % 3 AS chunk, l_orderkey AS query_ix, CAST(l_linenumber AS BIGINT) AS rank FROM lineitem)) WHERE rn = 1")
def win_first_appearance(spark, d):
    return E.first_appearance(table(spark, d, "lineitem").selectExpr("l_orderkey AS query_ix", "CAST(l_linenumber AS BIGINT) AS rank", "l_partkey AS doc", "l_suppkey % 3 AS chunk"))


@query("prj_parsed_issues", "SELECT event_id AS id, 'unknown' AS file_path, event_type AS title, CASE event_id % 4 WHEN 0 THEN 'bug' ELSE 'security' END AS category, 'error' AS severity, user_id AS line FROM events WHERE event_id % 4 < 2")
def prj_issues(spark, d):
    e = table(spark, d, "events").selectExpr("event_id AS id", "CAST(NULL AS STRING) AS file_path", "event_type AS title", "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'security' ELSE 'weird' END AS category", "CAST(NULL AS STRING) AS severity", "user_id AS line")
    return E.parsed_issues(e, ["bug", "security"], ["error", "warning"])


@query("prj_category", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'click' ELSE 'bug' END AS category FROM events")
def prj_category(spark, d):
    return table(spark, d, "events").select("event_id", E.known_or(F.col("event_type"), ["click", "style"], "bug").alias("category"))


@query("prj_tolerant_json", "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN concat('t', p_size) END AS title, CASE WHEN p_partkey % 4 < 3 THEN 1 END::BIGINT AS n FROM part")
def prj_json(spark, d):
    one = F.expr("concat('[{\"title\":\"t', p_size, '\"}]')")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, one).when(k == 1, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(k == 2, F.concat(F.lit('{"issues":'), one, F.lit("}"))).otherwise("nothing found")
    got = E.tolerant_json(text, "array<struct<title:string>>")
    return table(spark, d, "part").select("p_partkey", got.alias("g")).select("p_partkey", F.get("g", F.lit(0))["title"].alias("title"), F.when(F.get("g", F.lit(0))["title"].isNotNull(), F.size("g")).cast("bigint").alias("n"))


@query("prj_at_position", "SELECT p_partkey, CASE WHEN p_size - 3 BETWEEN 0 AND 2 THEN ['a', 'b', 'c'][p_size - 2] END AS finding FROM part")
def prj_position(spark, d):
    found = E.at_position(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("p_size") - 3)
    return table(spark, d, "part").select("p_partkey", found.alias("finding"))


@query("prj_target_alias", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'main' END AS target FROM part")
def prj_target(spark, d):
    t = F.expr("CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Current ' WHEN 2 THEN '  ' ELSE ' main ' END")
    return table(spark, d, "part").select("p_partkey", E.target_alias(t).alias("target"))


# --- knowledge graph, modules, state ---------------------------------------


def _full_symbols(spark, d):
    return _symbols(spark, d).withColumn("bases", F.array(F.expr("concat('n', (symbol_id + 5) % 64)"), F.lit("Base"))).withColumn("qualified_name", F.expr("concat(name, '.', symbol_id)"))


KG = f"""{S.FILES}, {S.edges_sql()}, {CALLS}, s AS (SELECT * FROM (SELECT {', '.join(SYM)} FROM part) WHERE file_id IN (SELECT file_id FROM files)), cl AS (SELECT file_id, name, max(symbol_id) AS cid FROM s WHERE type = 'class' GROUP BY 1, 2),
 i AS (SELECT *, concat(type, ':', name, '.', symbol_id) AS node, row_number() OVER (PARTITION BY file_id ORDER BY start_line, symbol_id) AS rn FROM s), fx AS (SELECT a.*, b.path AS tp, b.module AS tm, c.path AS sp, c.module AS sm FROM edges a JOIN files b ON b.file_id = dst JOIN files c ON c.file_id = src)"""


@query("kg_edges", f"""WITH {KG} SELECT 'file:' || path AS source, node AS target, 'exports' AS type, 0.9::DOUBLE AS weight FROM i JOIN files USING (file_id)
 UNION ALL SELECT * FROM (SELECT DISTINCT a.node, b.node, 'extends', 0.8 FROM i a JOIN cl ON cl.file_id = a.file_id AND cl.name = concat('n', (a.symbol_id + 5) % 64) JOIN i b ON b.symbol_id = cid WHERE a.type = 'class' AND a.symbol_id <> cid)
 UNION ALL SELECT * FROM (SELECT DISTINCT b.node, a.node, 'contains', 0.85 FROM i a JOIN cl ON cl.file_id = a.file_id AND cl.name = a.parent_class JOIN i b ON b.symbol_id = cid)
 UNION ALL SELECT a.node, b.node, 'related', 0.6 FROM i a JOIN i b ON a.file_id = b.file_id AND a.rn < b.rn WHERE b.rn <= 12
 UNION ALL SELECT 'module:' || module, 'file:' || path, 'contains', 0.5 FROM files UNION ALL SELECT 'file:' || sp, 'file:' || tp, 'imports', 1.0 FROM fx
 UNION ALL SELECT a.node, b.node, 'calls', 0.8 FROM (SELECT DISTINCT caller, callee FROM c) JOIN i a ON a.symbol_id = caller JOIN i b ON b.symbol_id = callee
 UNION ALL SELECT * FROM (SELECT DISTINCT 'module:' || sm, 'module:' || tm, 'module_dep', 0.7 FROM fx WHERE sm <> tm)""")
def kg_edges(spark, d):
    return K.typed_edges(S.files(spark, d), _full_symbols(spark, d), S.edges(spark, d), _calls(spark, d))


@query("agg_layers", f"WITH {S.FILES} SELECT 'layer:' || module AS layer, string_agg('file:' || path, ',' ORDER BY path) || ',module:' || module AS nodes FROM files GROUP BY module")
def agg_layers(spark, d):
    return K.layers(S.files(spark, d)).select("layer", F.array_join("nodes", ",").alias("nodes"))


@query("ret_find_node", f"WITH {S.FILES} SELECT file_id AS ordinal, path FROM files WHERE contains(lower(path || ' ' || module || ' ' || language), 'brand#2') ORDER BY file_id LIMIT 1")
def ret_find(spark, d):
    n = S.files(spark, d).select(F.col("file_id").alias("ordinal"), F.col("path").alias("name"), F.col("module").alias("qualified_name"), F.col("language").alias("path"))
    return K.find_node(n, "BRAND#2").select("ordinal", F.col("name").alias("path"))


@query("jn_module_named", f"WITH {S.FILES} SELECT DISTINCT upper(module) AS asked, module, false AS as_feature FROM files UNION ALL SELECT upper(language), min(module), true FROM files GROUP BY language")
def jn_module_named(spark, d):
    f = S.files(spark, d)
    asked = f.select(F.upper("module").alias("asked")).unionByName(f.select(F.upper("language").alias("asked"))).distinct()
    return K.module_named(f.select("module").distinct(), f, asked)


@query("agg_detected_modules", f"WITH {S.FILES}, n AS (SELECT count(DISTINCT module || '/' || language) AS n FROM files) SELECT file_id, CASE WHEN n > 20 THEN module ELSE module || '/' || language END AS module FROM files, n")
def agg_detected(spark, d):
    return K.detected_modules(S.files(spark, d), 2)


@query("kg_layout_layers", "WITH r AS (SELECT p_partkey AS id, p_size AS level, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_size) AS n FROM part) SELECT id, CAST(level * 240 AS BIGINT) AS x, (i - 1 - (n - 1) / 2) * 70 AS y FROM r")
def kg_layers(spark, d):
    out = K.layered_layout(table(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS level"))
    return out.select("id", *BIG("x"), F.col("y").cast("double").alias("y"))


RISKY = ["p_partkey", "p_name AS path", "p_size AS affected", "p_partkey % 41 = 0 AS in_cycle", "p_partkey % 37 = 0 AS bottleneck"]


@query("flt_high_impact", "SELECT p_partkey FROM part WHERE p_size >= 40 OR p_partkey % 41 = 0 OR p_partkey % 37 = 0")
def flt_high_impact(spark, d):
    return K.high_impact(table(spark, d, "part").selectExpr(*RISKY), 40).select("p_partkey")


@query("flt_architecture_flags", "SELECT string_agg(DISTINCT p_name, ',' ORDER BY p_name) FILTER (p_partkey % 37 = 0) AS bottlenecks, string_agg(DISTINCT p_name, ',' ORDER BY p_name) FILTER (p_partkey % 41 = 0) AS cycles FROM part")
def flt_flags(spark, d):
    return K.architecture_flags(table(spark, d, "part").selectExpr(*RISKY))


@query("flt_related_findings", "SELECT event_id AS id, event_type AS path FROM events WHERE event_type IN ('click', 'view') ORDER BY id DESC LIMIT 50")
def flt_related(spark, d):
    e = table(spark, d, "events").selectExpr("event_id AS id", "event_type AS path")
    return K.related_findings(e, e.filter("path IN ('click', 'view')"))


MARKERS = {"package.json": "javascript", "Cargo.toml": "rust", "go.mod": "go", "pom.xml": "java"}


@query("src_tech_stack", "WITH p AS (SELECT c_nationkey AS repo, CASE c_custkey % 5 WHEN 0 THEN 'javascript' WHEN 1 THEN 'rust' WHEN 2 THEN 'go' WHEN 3 THEN 'java' END AS tech FROM customer) SELECT repo, string_agg(DISTINCT tech, ',' ORDER BY tech) AS stack FROM p WHERE tech IS NOT NULL GROUP BY repo")
def src_tech(spark, d):
    p = table(spark, d, "customer").selectExpr("c_nationkey AS repo", "CASE c_custkey % 5 WHEN 0 THEN 'package.json' WHEN 1 THEN 'Cargo.toml' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'pom.xml' ELSE 'README' END AS path")
    return K.tech_stack(p, MARKERS)


@query("prj_context_header", "SELECT p_partkey, concat('--- ', p_name, CASE WHEN p_partkey % 2 = 0 THEN concat(' | class: C', p_partkey) ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN concat(' (lines ', p_size, '-', p_size + 4, ')') ELSE '' END, ' ---') AS header FROM part")
def prj_header(spark, d):
    k = F.col("p_partkey")
    h = K.context_header(F.col("p_name"), F.when(k % 2 == 0, F.concat(F.lit("C"), k.cast("string"))), F.lit("class"), F.when(k % 3 == 0, F.col("p_size")), F.col("p_size") + 4)
    return table(spark, d, "part").select("p_partkey", h.alias("header"))


@query("str_staleness_status", "SELECT p_partkey AS repo, p_size % 3 > 0 AS index_stale, (1, p_size % 12) < (1, 10) AS software_stale, (1, p_size % 5) < (1, p_size % 12) AS build_stale, p_size % 3 > 0 OR p_size % 12 < 10 OR p_size % 5 < p_size % 12 AS has_updates FROM part")
def str_status(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey AS repo", "concat('1.', p_size % 12) AS version", "'1.10' AS newest", "p_size % 3 AS behind", "concat('v1.', p_size % 5) AS build")
    return K.staleness_status(p)


@query("win_next_batches", "WITH b AS (SELECT o_custkey AS session, o_orderkey AS batch, o_orderstatus = 'F' AS done FROM orders) SELECT c_custkey AS session, min(batch) FILTER (NOT done) AS batch, count(batch) FILTER (NOT done) AS left FROM customer LEFT JOIN b ON session = c_custkey GROUP BY 1".replace("AS left", 'AS "left"'))
def win_next(spark, d):
    b = table(spark, d, "orders").selectExpr("o_custkey AS session", "o_orderkey AS batch", "o_orderstatus = 'F' AS done")
    return K.next_batches(table(spark, d, "customer").select(F.col("c_custkey").alias("session")), b, b.filter("done"))


# --- earlier operators that had no query -----------------------------------


@query("prj_without_controls", "SELECT doc_id, md5(substr(text, 1, 15000)) AS h FROM documents")
def prj_controls(spark, d):
    from loomgraph.functions import expressions as X

    t = F.concat(F.lit("\x01"), F.regexp_replace("text", " ", "\x02 "))
    return table(spark, d, "documents").select("doc_id", F.md5(X.without_controls(t)).alias("h"))


@query("prj_search_depth", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 12 ELSE 5 END::BIGINT AS n FROM benchmark")
def prj_depth(spark, d):
    from loomgraph.operators.retrieval import depth_for

    q = F.expr("CASE item_id % 3 WHEN 0 THEN 'Give me an Overview of it' WHEN 1 THEN 'what is x' ELSE 'who calls y' END")
    return table(spark, d, "benchmark").select("item_id", depth_for(q).cast("bigint").alias("n"))


@query("prj_collection_names", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9_-]+', '_', 'g'), '_') AS name FROM part")
def prj_collections(spark, d):
    from loomgraph.operators.control import collection_name

    return table(spark, d, "part").select("p_partkey", collection_name(F.col("p_type")).alias("name"))


@query("flt_branches", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1_' OR p_brand LIKE '%5'")
def flt_branches(spark, d):
    from loomgraph.operators.control import branch_allowed

    return table(spark, d, "part").filter(branch_allowed(F.col("p_brand"), ["Brand#1?", "*5"])).select("p_partkey")


@query("srt_last_session", "SELECT o_orderkey AS session_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def srt_last(spark, d):
    from loomgraph.operators.control import last_session

    return last_session(table(spark, d, "orders").selectExpr("o_orderkey AS session_id", "o_orderstatus AS branch", "o_orderdate AS updated_at"), "O").select("session_id")


@query("ops_register", "SELECT c_custkey AS repo, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS url FROM customer")
def ops_register(spark, d):
    from loomgraph.operators.control import register

    c = table(spark, d, "customer").selectExpr("c_custkey AS repo", "c_name AS full_name", "c_mktsegment AS url")
    return register(c, c.filter("repo % 4 = 0").withColumn("url", F.lit("new"))).select("repo", "url")


@query("ret_health", f"WITH RECURSIVE {S.JUMPS}, r AS (SELECT src AS a, dst AS b FROM edges UNION SELECT r.a, e.dst FROM r JOIN edges e ON e.src = r.b), s AS (SELECT a, least(a, min(b)) AS g FROM (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b) GROUP BY a) SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS vertices, (SELECT count(*) FROM edges) AS edges, count(*) = 0 AS is_dag, count(*) AS in_cycles, count(DISTINCT g) AS groups FROM s")
def ret_health(spark, d):
    from loomgraph.operators.reports import health

    return health(S.jumps(spark, d))


@query("ops_reading_order", f"WITH RECURSIVE {S.TREE}, r AS (SELECT DISTINCT src AS id, 0 AS level FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, r.level + 1 FROM r JOIN edges e ON e.src = r.id), l AS (SELECT id, max(level) AS level FROM r GROUP BY id) SELECT p_partkey AS id, CAST(level AS BIGINT) AS level, CASE WHEN p_partkey % 2 = 0 THEN 'low' ELSE 'none' END AS risk FROM part LEFT JOIN l ON l.id = p_partkey")
def ops_reading(spark, d):
    from loomgraph.operators.reports import reading_order

    f = S.files(spark, d)
    risks = f.filter("file_id % 2 = 0").select(F.col("file_id").alias("id"), F.lit("low").alias("risk"))
    return reading_order(S.tree(spark, d), f, risks).select("id", *BIG("level"), "risk")
