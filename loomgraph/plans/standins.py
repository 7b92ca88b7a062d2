"""The given tables in the shapes of the code graph, as DataFrames and as SQL of the same meaning.

files: parts (path brand/type/key). edges: consecutive parts of every order's lines; tree and
jumps: a graph without and one with cycles over all parts, for what DuckDB can't follow on
the edges. calls: lines of suppliers and parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.session import table


def files(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("file_id"), F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("module"), F.col("p_type").alias("language"))


FILES = "files AS (SELECT p_partkey AS file_id, p_brand || '/' || p_type || '/' || CAST(p_partkey AS VARCHAR) AS path, p_brand AS module, p_type AS language FROM part)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive parts of every order's lines."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "src")
    return li.select("src", F.lead("src").over(w).alias("dst")).filter("dst IS NOT NULL AND src <> dst").distinct()


def edges_sql() -> str:
    return "edges AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"


HALF, THIRD = "CAST(floor(p_partkey / 2) AS BIGINT)", "CAST(floor(p_partkey / 3) AS BIGINT)"


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Every part imports those of half and a third of its number: no cycles, depth the logarithm of the parts."""
    p = table(spark, d, "part")
    return p.selectExpr("p_partkey AS src", f"{HALF} AS dst").unionByName(p.selectExpr("p_partkey AS src", f"{THIRD} AS dst")).filter("dst > 0").distinct()


TREE = f"edges AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, {HALF} AS dst FROM part UNION ALL SELECT p_partkey, {THIRD} FROM part) WHERE dst > 0)"
NEXT = "p_partkey * p_size % 101 + 1"


def jumps(spark: SparkSession, d: str) -> DataFrame:
    """Every part imports one other, so that paths end in cycles."""
    return table(spark, d, "part").selectExpr("p_partkey AS src", f"{NEXT} AS dst").filter("src <> dst").distinct()


JUMPS = f"edges AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, {NEXT} AS dst FROM part) WHERE src <> dst)"


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), F.col("l_linenumber").alias("line")).distinct()


CALLS = "calls AS (SELECT DISTINCT l_suppkey AS caller, l_partkey AS callee, l_linenumber AS line FROM lineitem)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line, content), lines counted from 1."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "content"))
    return docs.select("doc_id", (F.col("p") + 1).cast("bigint").alias("line"), "content")


LINES = "lines AS (SELECT doc_id, CAST(i AS BIGINT) AS line, string_split(text, chr(10))[i] AS content FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
