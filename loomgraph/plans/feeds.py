"""Registered queries: parsers, analyzer outputs, chunking, review gates and stateful operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions import expressions as X
from loomgraph.operators import relational as R
from loomgraph.operators import retrieval as T
from loomgraph.operators import review as V
from loomgraph.plans import standins as S
from loomgraph.plans.catalogue import query
from loomgraph.plans.core import BIG
from loomgraph.session import table
from loomgraph.sources import code as C
from loomgraph.sources import diffs as D
from loomgraph.sources import documents as P
from loomgraph.sources import tools as A
from loomgraph.streaming.limits import rate_limited


def _code(spark, d):
    """A small Python file for each part: a class with a method, and a function that calls."""
    k = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("import os\nfrom pkg.m"), k, F.lit(" import x\n\nclass C"), k, F.lit("(Base):\n    def run(self, a):\n        return f"), k, F.lit("(a)\n\ndef f"), k, F.lit("(n):\n    y = len(n)\n    return y\n"))
    return table(spark, d, "part").select(F.concat(F.lit("src/m"), k, F.lit(".py")).alias("path"), body.alias("content"), F.lit("python").alias("language"), "p_partkey")


@query("src_symbols", "SELECT 'src/m' || p_partkey || '.py' AS path, t AS type, replace(n, '#', CAST(p_partkey AS VARCHAR)) AS name, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line, replace(c, '#', CAST(p_partkey AS VARCHAR)) AS parent_class FROM part, (VALUES ('class', 'C#', 4, 6, NULL), ('function', 'run', 5, 6, 'C#'), ('function', 'f#', 8, 10, NULL)) v(t, n, a, b, c)")
def src_symbols(spark, d):
    return C.parse_python(_code(spark, d)).select("path", "type", "name", *BIG("start_line", "end_line"), "parent_class")


@query("src_calls", "SELECT 'src/m' || p_partkey || '.py' AS path, replace(c, '#', CAST(p_partkey AS VARCHAR)) AS caller, replace(e, '#', CAST(p_partkey AS VARCHAR)) AS callee, CAST(l AS BIGINT) AS line FROM part, (VALUES ('C#.run', 'f#', 6), ('f#', 'len', 9)) v(c, e, l)")
def src_calls(spark, d):
    return C.extract_calls(_code(spark, d)).select("path", "caller", "callee", *BIG("line"))


@query("src_imports", "SELECT 'src/m' || p_partkey || '.py' AS path, 'pkg.m' || p_partkey AS raw FROM part UNION ALL SELECT 'src/m' || p_partkey || '.py', 'os' FROM part")
def src_imports(spark, d):
    c = _code(spark, d)
    return c.select("path", F.explode(C.raw_imports(F.col("content"), F.col("language"))).alias("raw"))


@query("src_import_resolution", "SELECT 'src/m' || p_partkey || '.py' AS path, 'pkg.m' || p_partkey AS raw, CASE WHEN p_partkey % 2 = 0 THEN 'lib/pkg/m' || p_partkey || '.py' ELSE 'src/m' || p_partkey || '.py' END AS resolved FROM part UNION ALL SELECT 'src/m' || p_partkey || '.py', 'os', NULL FROM part")
def src_resolution(spark, d):
    c = _code(spark, d)
    imports = c.select("path", "language", F.explode(C.raw_imports(F.col("content"), F.col("language"))).alias("raw"))
    files = c.select("path").unionByName(c.filter("p_partkey % 2 = 0").select(F.concat(F.lit("lib/pkg/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path")))
    return C.resolve_imports(imports, files)


@query("src_diff_lines", "SELECT CAST(p_partkey AS VARCHAR) AS diff_id, 'f' || p_partkey || '.py' AS file_path, CAST(n AS BIGINT) AS line_number, CASE WHEN k = 'added' THEN 'b' || p_size ELSE c END AS content, k AS change_type FROM part, (VALUES (10, 'x', 'context'), (11, 'a', 'removed'), (11, '', 'added'), (12, 'z', 'context')) v(n, c, k)")
def src_diff(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("diff --git a/f"), k, F.lit(".py b/f"), k, F.lit(".py\n--- a/f"), k, F.lit(".py\n+++ b/f"), k, F.lit(".py\n@@ -10,3 +10,3 @@ def\n x\n-a\n+b"), F.col("p_size").cast("string"), F.lit("\n z\n"))
    return D.parse_diffs(table(spark, d, "part").select(k.alias("diff_id"), text.alias("text"))).select("diff_id", "file_path", *BIG("line_number"), "content", "change_type")


@query("src_diff_totals", "SELECT 'f' || p_partkey || '.py' AS file_path, 1::BIGINT AS added, 1::BIGINT AS removed, 'a' AS old_text, 'b' || p_size AS new_text FROM part")
def src_diff_totals(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("diff --git a/f"), k, F.lit(".py b/f"), k, F.lit(".py\n--- a/f"), k, F.lit(".py\n+++ b/f"), k, F.lit(".py\n@@ -10,3 +10,3 @@ def\n x\n-a\n+b"), F.col("p_size").cast("string"), F.lit("\n z\n"))
    return D.line_totals(D.parse_diffs(table(spark, d, "part").select(k.alias("diff_id"), text.alias("text"))))


@query("src_tool_findings", "SELECT tool, 'f' || event_id AS file_path, CAST(user_id AS BIGINT) AS line_number, code, severity, category FROM events, (VALUES ('ruff', 'S101', 'error', 'security'), ('mypy', 'attr-defined', 'error', 'type'), ('bandit', 'B1', 'error', 'security'), ('eslint', 'no-x', 'error', 'style')) v(tool, code, severity, category) WHERE (event_id % 4 = 0 AND tool = 'ruff') OR (event_id % 4 = 1 AND tool = 'mypy') OR (event_id % 4 = 2 AND tool = 'bandit') OR (event_id % 4 = 3 AND tool = 'eslint')")
def src_tools(spark, d):
    e, f, u = table(spark, d, "events"), F.concat(F.lit("f"), F.col("event_id").cast("string")), F.col("user_id").cast("string")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('[{"code":"S101","filename":"'), f, F.lit('","message":"m","location":{"row":'), u, F.lit("}}]")))
        .when(F.col("event_id") % 4 == 1, F.concat(f, F.lit(":"), u, F.lit(": error: no such thing  [attr-defined]\n"), f, F.lit(":1: note: see")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"results":[{"filename":"'), f, F.lit('","line_number":'), u, F.lit(',"test_id":"B1","issue_severity":"MEDIUM","issue_text":"t"}]}')))
        .otherwise(F.concat(F.lit('[{"filePath":"'), f, F.lit('","messages":[{"ruleId":"no-x","severity":2,"message":"m","line":'), u, F.lit("}]}]")))
    )
    tool = F.element_at(F.array(*[F.lit(t) for t in ("ruff", "mypy", "bandit", "eslint")]), (F.col("event_id") % 4 + 1).cast("int"))
    return A.findings(e.select(tool.alias("tool"), text.alias("text"))).select("tool", "file_path", *BIG("line_number"), "code", "severity", "category")


@query("src_languages", "WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'a/b.PY' WHEN 1 THEN 'x.tar.ts' WHEN 2 THEN 'noext' WHEN 3 THEN '.yaml' ELSE 'q/h.hpp' END AS path FROM part) SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 4 THEN 'cpp' ELSE 'unknown' END AS language FROM p")
def src_languages(spark, d):
    path = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'a/b.PY' WHEN 1 THEN 'x.tar.ts' WHEN 2 THEN 'noext' WHEN 3 THEN '.yaml' ELSE 'q/h.hpp' END")
    return table(spark, d, "part").select("p_partkey", X.language_of(path).alias("language"))


@query("src_page_links", "SELECT page_id, count(*) AS n_links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS l FROM pages) GROUP BY page_id")
def src_links(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("l"))
    return p.groupBy("page_id").agg(F.count("*").alias("n_links"))


@query("ret_code_chunks", "SELECT 'src/m' || p_partkey || '.py' AS path, t AS chunk_type, replace(n, '#', CAST(p_partkey AS VARCHAR)) AS name FROM part, (VALUES ('parent', 'C#'), ('child', 'C#'), ('parent', 'run'), ('child', 'run'), ('parent', 'f#'), ('child', 'f#'), ('leftover', NULL)) v(t, n)")
def ret_chunks(spark, d):
    c = _code(spark, d)
    return P.code_chunks(c, C.parse_python(c)).select("path", "chunk_type", "name")


@query("win_rst_sections", "SELECT p_partkey AS doc_id, CAST(s AS BIGINT) AS section, replace(t, '#', p_brand) AS title FROM part, (VALUES (0, ''), (1, '#'), (2, 'Second')) v(s, t)")
def win_rst(spark, d):
    text = F.concat(F.lit("An introduction that is long enough.\n\n"), "p_brand", F.lit("\n==========\nBody of the first section here.\n\nSecond\n------\nBody of the second section here.\n"))
    return P.rst(table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))).select("doc_id", *BIG("section"), "title")


@query("str_rate_limited", """WITH RECURSIVE e AS (SELECT user_id AS client, event_id AS request, epoch(ts) / 600 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 f AS (SELECT client, request, k, true AS admitted, [t] AS taken FROM e WHERE k = 1 UNION ALL
 SELECT e.client, e.request, e.k, len(list_filter(f.taken, lambda x: e.t - x < 600.0)) < 2, CASE WHEN len(list_filter(f.taken, lambda x: e.t - x < 600.0)) < 2 THEN list_append(list_filter(f.taken, lambda x: e.t - x < 600.0), e.t) ELSE list_filter(f.taken, lambda x: e.t - x < 600.0) END FROM f JOIN e ON e.client = f.client AND e.k = f.k + 1)
 SELECT client, request, admitted FROM f""")
def str_rate(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request"), (F.col("ts").cast("timestamp").cast("double") / 600).alias("at"))
    return rate_limited(e, 2, 600.0).select("client", "request", "admitted")


@query("flt_finding_validation", "SELECT event_id, CASE WHEN event_type IS NULL OR event_type = '' THEN 'severity' WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unknown severity' WHEN user_id % 7 = 0 THEN 'not in batch' WHEN value > 60 THEN 'line beyond file' END AS reason FROM events")
def flt_validation(spark, d):
    rules = [(F.col("event_type") != "", "severity"), (F.col("event_type").isin("click", "view", "purchase"), "unknown severity"), (F.col("user_id") % 7 != 0, "not in batch"), (F.col("value") <= 60, "line beyond file")]
    return table(spark, d, "events").select("event_id", V.invalid_reason(rules).alias("reason"))


@query("ret_rerank", "SELECT user_id AS q_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(CASE WHEN event_id % 5 <> 0 THEN value END, 5.0) DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def ret_rerank(spark, d):
    h = table(spark, d, "events").select(F.col("user_id").alias("q_id"), F.col("event_id").alias("position"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("score"))
    return T.rerank(h, 3).select("q_id", F.col("position").alias("event_id"), *BIG("rank"))


@query("agg_module_max_risk", "WITH a AS (SELECT p_brand, p_size, CASE WHEN p_size >= 45 THEN 'high' WHEN p_size >= 48 THEN 'critical' WHEN p_size >= 30 THEN 'moderate' ELSE 'none' END AS risk FROM part) SELECT p_brand AS module, CASE max(CASE risk WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'moderate' ELSE 'low' END AS risk FROM a GROUP BY 1")
def agg_max_risk(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("module"), F.expr("CASE WHEN p_size >= 45 THEN 'high' WHEN p_size >= 48 THEN 'critical' WHEN p_size >= 30 THEN 'moderate' ELSE 'none' END").alias("risk"))
    return V.max_risk(p, "module")


@query("win_big_movers", "WITH m AS (SELECT user_id, sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END) AS delta FROM events GROUP BY 1) SELECT user_id FROM m ORDER BY abs(round(delta, 4)) DESC, user_id LIMIT 5")
def win_movers(spark, d):
    m = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum(F.expr("CASE WHEN event_id % 2 = 0 THEN value ELSE -value END")), 4).alias("delta"))
    return m.orderBy(F.abs("delta").desc(), "user_id").limit(5).select("user_id")


@query("jn_golden_match", "WITH e AS (SELECT event_type AS file_path, event_id AS expected_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE event_id % 3 = 0), f AS (SELECT event_type AS file_path, event_id AS finding_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE event_id % 4 = 1) SELECT e.file_path, expected_id, finding_id FROM e JOIN f ON e.file_path = f.file_path AND e.k = f.k WHERE e.k <= 100")
def jn_golden(spark, d):
    e = table(spark, d, "events")
    base = lambda cond, name: R.top_per_group(e.filter(cond).select(F.col("event_type").alias("file_path"), F.col("event_id").alias(name)), ["file_path"], 100, F.asc(name)).drop("rn")
    exp = base("event_id % 3 = 0", "expected_id").select("*", F.lit(None).cast("int").alias("line_number"), F.lit("bug").alias("category"), F.lit("t").alias("title_part"))
    fnd = base("event_id % 4 = 1", "finding_id").select("*", F.lit(1).alias("line_number"), F.lit("bug").alias("category"), F.lit("A Title").alias("title"))
    return V.greedy_match(exp, fnd)


@query("win_tour_steps", f"WITH {S.FILES}, p AS (SELECT module, min(file_id) AS first FROM files GROUP BY module) SELECT module, first, row_number() OVER (ORDER BY first, module) AS step, CAST(floor((row_number() OVER (ORDER BY first, module) - 1) / 3) AS BIGINT) AS batch FROM p")
def win_tour(spark, d):
    from loomgraph.operators.windows import position

    p = S.files(spark, d).groupBy("module").agg(F.min("file_id").alias("first"))
    return position(p, F.asc("first"), F.asc("module")).select("module", "first", F.col("position").alias("step"), F.floor((F.col("position") - 1) / 3).alias("batch"))


@query("agg_risk_per_batch", "SELECT CAST(l_orderkey % 50 AS BIGINT) AS batch, round(max(2 * ln(1 + l_quantity) + 3 * l_discount), 6) AS risk, count(*) AS n FROM lineitem GROUP BY 1")
def agg_batch_risk(spark, d):
    score = X.risk_score(F.col("l_quantity"), F.col("l_discount"), F.lit(0), F.lit(0))
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("batch")).agg(F.round(F.max(score), 6).alias("risk"), F.count("*").alias("n"))


@query("win_import_block", f"WITH {S.LINES}, m AS (SELECT doc_id, line, min(CASE WHEN length(content) > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS keep FROM lines) SELECT doc_id, count(*) AS n FROM m WHERE keep = 1 GROUP BY doc_id")
def win_import_block(spark, d):
    w = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    m = S.lines(spark, d).withColumn("keep", F.min((F.length("content") > 40).cast("int")).over(w))
    return m.filter("keep = 1").groupBy("doc_id").agg(F.count("*").alias("n"))
