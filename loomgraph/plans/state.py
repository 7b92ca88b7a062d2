"""Registered queries over versions, streams, caches, splits and condensed graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import splitting as T
from loomgraph.plans import standins as S
from loomgraph.plans.catalogue import query
from loomgraph.session import table
from loomgraph.storage import cut, shared_dir
from loomgraph.streaming import cache as C
from loomgraph.streaming import indexing as I
from loomgraph.tablelog import SESSION, Sessions, TableLog, counted


def _fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("snk_findings_log", "SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS source, count(*) AS n FROM events WHERE user_id % 10 <> 0 GROUP BY 1, 2")
def snk_findings_log(spark, d):
    """Events as findings, in batches of which each comes twice; sessions of every tenth user go."""
    e, s = table(spark, d, "events"), Sessions(spark, _fresh(spark, "sessions"))
    user = F.col("user_id").cast("string")
    s.save(e.groupBy(user.alias("session_id")).agg(F.min("event_type").alias("folder"), F.max(F.col("ts").cast("timestamp")).alias("at")).withColumn("status", F.lit("active")).withColumn("phase", F.lit("scan")).selectExpr(*[c.split()[0] for c in SESSION.split(", ")]))
    rows = e.select(user.alias("session_id"), F.col("event_type").alias("source"), F.lit("scan").alias("phase"), F.col("event_id").alias("ordinal"), F.col("props").alias("finding"), "event_id")
    for batch in (0, 1, 1, 2, 0, 2):
        s.append_findings(rows.filter(F.col("event_id") % 3 == batch), "events", batch)
    for name in ("findings", "sessions"):
        s.log.update(name, lambda df: df.filter(F.col("session_id").cast("bigint") % 10 != 0))
    return counted(s).join(s.states().select("session_id"), "session_id", "left_semi")


@query("str_index_stream", "SELECT 'c' || o_custkey AS path, max_by('h' || o_orderkey, (o_orderdate, o_orderkey)) AS hash FROM orders GROUP BY o_custkey HAVING max_by(o_orderstatus, (o_orderdate, o_orderkey)) <> 'F'")
def str_index_stream(spark, d):
    """Orders as versions of their customer's file, streamed two files a trigger; those of status F delete it."""
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey"))
    rows = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("path"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("hash"), F.lit(False).alias("blank"), (F.col("o_orderstatus") == "F").alias("deleted"), at.alias("at"))
    folder, log = _fresh(spark, "arrivals"), TableLog(spark, _fresh(spark, "index"))
    rows.repartition(6).write.parquet(folder)
    I.index_stream(I.files_stream(spark, folder, rows.schema, files=2), log, _fresh(spark, "progress")).awaitTermination()
    return I.indexed(log)


HOURS = 6


@query("str_ttl_cache", f"""WITH RECURSIVE t AS (SELECT DISTINCT user_id, ts FROM events),
nxt AS (SELECT a.user_id, a.ts, min(b.ts) AS n FROM t a JOIN t b ON a.user_id = b.user_id AND b.ts >= a.ts + INTERVAL {HOURS} HOUR GROUP BY a.user_id, a.ts),
c AS (SELECT user_id, min(ts) AS ts FROM t GROUP BY user_id UNION ALL SELECT nxt.user_id, nxt.n FROM c JOIN nxt ON nxt.user_id = c.user_id AND nxt.ts = c.ts),
r AS (SELECT user_id, count(*) AS k FROM c GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS requests, count(*) - any_value(k) AS hits FROM events JOIN r USING (user_id) GROUP BY user_id""")
def str_ttl_cache(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request"), F.col("ts").cast("timestamp").alias("at"))
    return C.summary(C.cached(e, HOURS * 3600.0))


def _cut_sql(k: int, sep: str) -> str:
    return f"p{k + 1} AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {T.LIMIT} THEN [x] ELSE list_filter(list_transform(string_split(x, {sep}), lambda y, i: CASE WHEN i = 1 THEN y ELSE {sep} || y END), lambda y: y <> '') END)) AS p FROM p{k})"


SPLIT = f"""WITH RECURSIVE p0 AS (SELECT doc_id, text, [text] AS p FROM documents WHERE text <> ''),
{_cut_sql(0, "chr(10) || chr(10)")}, {_cut_sql(1, "chr(10)")}, {_cut_sql(2, "' '")},
p4 AS (SELECT doc_id, flatten(list_transform(p, lambda x: list_transform(range(0, (length(x) + {T.LIMIT - 1}) // {T.LIMIT}), lambda k: substring(x, CAST(1 + {T.LIMIT} * k AS BIGINT), {T.LIMIT})))) AS p FROM p3),
n AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS i, length(unnest(p)) AS n FROM p4),
o AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS s, sum(n) OVER (PARTITION BY doc_id) AS total, count(*) OVER (PARTITION BY doc_id) AS size FROM n),
a AS (SELECT *, CASE WHEN total - s <= {T.LIMIT} THEN size ELSE max(i) OVER (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND {T.LIMIT} FOLLOWING) END AS e FROM o),
nxt AS (SELECT x.doc_id, x.i, min(y.i) AS j FROM a x JOIN a z ON z.doc_id = x.doc_id AND z.i = x.e JOIN a y ON y.doc_id = x.doc_id AND y.i > x.i AND y.i <= x.e AND (y.i = x.e OR (y.s >= z.s - {T.OVERLAP} AND y.e > x.e)) GROUP BY x.doc_id, x.i),
c AS (SELECT doc_id, i FROM a WHERE i = 0 UNION ALL SELECT nxt.doc_id, nxt.j FROM c JOIN nxt ON nxt.doc_id = c.doc_id AND nxt.i = c.i),
r AS (SELECT a.doc_id, a.i, a.s, coalesce(z.s, a.total) - a.s AS n FROM c JOIN a ON a.doc_id = c.doc_id AND a.i = c.i LEFT JOIN a z ON z.doc_id = a.doc_id AND z.i = a.e)
SELECT r.doc_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY r.i) - 1 AS piece, CAST(r.s AS BIGINT) AS start, md5(substring(p0.text, CAST(r.s + 1 AS BIGINT), CAST(r.n AS BIGINT))) AS digest FROM r JOIN p0 ON p0.doc_id = r.doc_id"""


@query("ret_split_texts", SPLIT)
def ret_split_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("language"))
    return T.split_texts(docs).select("doc_id", F.col("piece").cast("bigint").alias("piece"), "start", F.md5("text").alias("digest"))


@query("gr_condensed_levels")
def gr_condensed_levels(spark, d):
    """Levels of the graph of all orders' edges, which has cycles; SQL can't follow, brute force does on fixtures."""
    return _condensed(cut(S.edges(spark, d), "edges"))


def _condensed(edges):
    return G.condensed_levels(edges).select("id", "component", F.col("level").cast("bigint").alias("level"))


@query("gr_condensed_proof", f"WITH {S.edges_sql()}, v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges) SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM edges) AS edges, 0::BIGINT AS unplaced, 0::BIGINT AS backward, 0::BIGINT AS misnamed")
def gr_condensed_proof(spark, d):
    """One row: all vertices placed, no edge between components that doesn't lead to a higher level, and every component named by its smallest vertex."""
    edges = cut(S.edges(spark, d), "edges")
    lv = cut(_condensed(edges), "levels")
    ends = [lv.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"), F.col("level").alias(f"l_{x}")).hint("merge") for x in ("src", "dst")]
    met = edges.join(ends[0], "src").join(ends[1], "dst")
    backward = F.count_if((F.col("c_src") != F.col("c_dst")) & (F.col("l_src") >= F.col("l_dst")))
    one = met.agg(F.count("*").alias("edges"), backward.alias("backward"))
    names = lv.groupBy("component").agg(F.min("id").alias("least"))
    two = lv.agg(F.count("*").alias("vertices"), F.count_if(F.col("level").isNull() | (F.col("level") < 0)).alias("unplaced"))
    three = names.agg(F.count_if(F.col("least") != F.col("component")).alias("misnamed"))
    return two.join(one).join(three).select("vertices", "edges", "unplaced", "backward", "misnamed")
