"""Change review and evaluation: findings, summaries, agreement, precision, matching, run comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.expressions import RISK_LEVELS

SEVERITIES = ("blocker", "error", "suggestion")
COMMENT_PREFIXES = ("//", "#", "--", "/*", "*")


def risk_histogram(df: DataFrame) -> DataFrame:
    """A count for each risk level, also where it is 0."""
    return df.agg(*[F.count(F.when(F.col("risk") == r, 1)).alias(f"n_{r}") for r in RISK_LEVELS])


def max_risk(df: DataFrame, key: str) -> DataFrame:
    """The highest level of each key, low at least."""
    rank = F.array_position(F.array(*[F.lit(r) for r in RISK_LEVELS]), F.col("risk"))
    return df.groupBy(key).agg(F.greatest(F.max(rank), F.lit(2)).alias("r")).select(key, F.element_at(F.array(*[F.lit(r) for r in RISK_LEVELS]), F.col("r").cast("int")).alias("risk"))


def summary(findings: DataFrame, by: str) -> DataFrame:
    """(by, n, blocking, total value) of findings."""
    return findings.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("blocking").cast("int")).alias("blocking"))


def commented_keywords(lines: DataFrame, keywords: list[str], prefixes: tuple[str, ...] = COMMENT_PREFIXES) -> DataFrame:
    """lines (file_id, line, content) that are comments with a keyword: one row for each file and keyword, its first line.

    Keywords are tried in the order given, so a line reports the first it holds.
    """
    text = F.trim(F.col("content"))
    comment = F.lit(False)
    for p in prefixes:
        comment = comment | F.startswith(text, F.lit(p))
    word = F.lit(None).cast("string")
    for k in reversed(keywords):
        word = F.when(F.contains(F.lower(text), F.lit(k.lower())), k).otherwise(word)
    found = lines.filter(comment).withColumn("keyword", word).filter(F.col("keyword").isNotNull())
    return found.groupBy("file_id", "keyword").agg(F.min("line").alias("line"))


def invalid_reason(rules: list[tuple[Column, str]]) -> Column:
    """The first rule that a row breaks, or null: rules are (condition that must hold, reason)."""
    out = F.lit(None).cast("string")
    for holds, why in reversed(rules):
        out = F.when(~F.coalesce(holds, F.lit(False)), why).otherwise(out)
    return out


def agreement(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, agreement, false_positives, false_negatives) of score >= threshold against a 0/1 truth, in one pass."""
    each = df.select(score, truth, F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    said, true = F.col(score) >= F.col("threshold"), F.col(truth) == 1
    return each.groupBy("threshold").agg(
        F.count("*").alias("n"), F.avg((said == true).cast("double")).alias("agreement"),
        F.sum((said & ~true).cast("int")).alias("false_positives"), F.sum((~said & true).cast("int")).alias("false_negatives"))


def precision_recall(df: DataFrame, found: Column, expected: Column) -> DataFrame:
    """precision and recall; 1.0 where the denominator is empty."""
    both = F.sum((found & expected).cast("int"))
    safe = lambda n: F.coalesce(both / F.nullif(F.sum(n.cast("int")), F.lit(0)), F.lit(1.0))
    return df.agg(safe(found).alias("precision"), safe(expected).alias("recall"))


def greedy_match(expected: DataFrame, findings: DataFrame) -> DataFrame:
    """(file_path, expected_id, finding_id) one-to-one, in order of expected id: each takes the first finding left that fits.

    Fits: same path; line equal where the expectation has one; its title part inside the
    finding's title; same category. Greedy state stays inside one file's rows.
    """

    def run(key, e: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        f = f.sort_values("finding_id")
        for x in e.sort_values("expected_id").itertuples():
            for y in f.itertuples():
                line = x.line_number is None or pd.isna(x.line_number) or x.line_number == y.line_number
                if y.finding_id not in used and line and x.category == y.category and (x.title_part or "").lower() in (y.title or "").lower():
                    used.add(y.finding_id)
                    out.append((key[0], x.expected_id, y.finding_id))
                    break
        return pd.DataFrame(out, columns=["file_path", "expected_id", "finding_id"])

    return expected.groupBy("file_path").cogroup(findings.groupBy("file_path")).applyInPandas(run, "file_path string, expected_id bigint, finding_id bigint")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, before, after, delta) over the metrics of either run; missing ones are 0."""
    met = a.select("metric", F.col("value").alias("before")).join(b.select("metric", F.col("value").alias("after")), "metric", "full").na.fill(0.0, ["before", "after"])
    return met.withColumn("delta", F.col("after") - F.col("before"))


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, id): node ids that occur twice, and edge ends without a node."""
    twice = nodes.groupBy("id").count().filter("count > 1").select(F.lit("duplicate_node").alias("problem"), "id")
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return twice.unionByName(ends.join(nodes, "id", "left_anti").select(F.lit("dangling_edge").alias("problem"), "id"))
