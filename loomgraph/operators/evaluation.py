"""Evaluation of retrieval and of reviews: runs compared, swept, merged and counted.

A run is a function of its parameters; nothing global is patched. Variants are runs whose
rows carry a label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.relational import first_of


# Words for the branch that is checked out.
CURRENT = ("current", "current-branch", ".")


def dataset_counts(samples: DataFrame) -> DataFrame:
    """(kind, name, n) of samples (file, category) by file and by category, in one pass."""
    both = samples.select(F.explode(F.array(F.struct(F.lit("file").alias("kind"), F.col("file").alias("name")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")))).alias("x"))
    return both.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def of_category(samples: DataFrame, category: str | None = None, tool: str | None = None) -> DataFrame:
    """The samples of a category or of a tool, or of both."""
    out = samples if category is None else samples.filter(F.col("category") == category)
    return out if tool is None else out.filter(F.col("tool") == tool)


def variants(runs: dict[str, DataFrame], label: str = "variant") -> DataFrame:
    """Rows of several runs under their labels."""
    out = None
    for name, df in runs.items():
        one = df.withColumn(label, F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def sweep(run: Callable[..., DataFrame], parameter: str, values: Iterable, **fixed) -> DataFrame:
    """Rows of ``run`` for each value of a parameter, with ``value`` and its ``ordinal``."""
    out = None
    for i, v in enumerate(values):
        one = run(**fixed, **{parameter: v}).withColumn("value", F.lit(v)).withColumn("ordinal", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def best_value(scores: DataFrame) -> DataFrame:
    """One row (value, mean): the swept value (ordinal, value, score) of the highest mean, the first of equals."""
    means = scores.groupBy("ordinal", "value").agg(F.avg("score").alias("mean"))
    return means.orderBy(F.desc("mean"), "ordinal").limit(1).select("value", "mean")


def merged_queries(parts: DataFrame, key: str) -> DataFrame:
    """(key, confident, confidence, chunks, retries) of a question's searches: any, highest, and sums."""
    return parts.groupBy(key).agg(F.bool_or("confident").alias("confident"), F.max("confidence").alias("confidence"), F.sum("chunks").alias("chunks"), F.sum("retries").alias("retries"))


def with_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows (ordinal, ...) with the score of the same position, null beyond their end."""
    return rows.join(scores.select("ordinal", "score"), "ordinal", "left")


def question_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(ordinal, question, delta) of two runs (ordinal, question, score) where both have the same question at a position."""
    b = before.select("ordinal", "question", F.col("score").alias("was"))
    return b.join(after.select("ordinal", "question", "score"), ["ordinal", "question"]).select("ordinal", "question", (F.col("score") - F.col("was")).alias("delta"))


def metric_comparison(runs: DataFrame, base: str, metrics: list[str]) -> DataFrame:
    """(variant, metric, mean, gain) of labelled runs: each metric's mean and how far it is above the base variant's."""
    long = runs.groupBy("variant").agg(*[F.avg(m).alias(m) for m in metrics])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean")) for m in metrics])
    long = long.select("variant", F.explode(pairs).alias("x")).select("variant", "x.*")
    ref = long.filter(F.col("variant") == base).select("metric", F.col("mean").alias("base"))
    return long.join(ref, "metric").select("variant", "metric", "mean", (F.col("mean") - F.col("base")).alias("gain"))


def layer_counters(hits: DataFrame, key: str, layers: dict[str, Column]) -> DataFrame:
    """Each question's rows that reach each layer, in order: a row counts in a layer if it passed those before."""
    passed, aggs = F.lit(True), []
    for name, cond in layers.items():
        passed = passed & F.coalesce(cond, F.lit(False))
        aggs.append(F.count(F.when(passed, 1)).alias(name))
    return hits.groupBy(key).agg(F.count("*").alias("found"), *aggs)


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of a run (confidence, kept, retries, expanded): questions, mean confidence, those without result, retries, expansions."""
    return rows.agg(
        F.count("*").alias("questions"), F.avg("confidence").alias("avg_confidence"), F.sum((F.col("kept") == 0).cast("int")).alias("without"),
        F.sum("retries").alias("retries"), F.sum(F.col("expanded").cast("int")).alias("expansions"),
    )


def unmatched(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(side, key): expected ones that weren't found, and found ones that weren't expected."""
    missed = expected.select(key).join(found.select(key), key, "left_anti").select(F.lit("missed").alias("side"), key)
    return missed.unionByName(found.select(key).join(expected.select(key), key, "left_anti").select(F.lit("extra").alias("side"), key))


def keep_ungraded(chunks: DataFrame, graded: DataFrame) -> DataFrame:
    """Chunks (q_id, position) that grading (q_id, position, relevant) found relevant or left out."""
    met = chunks.select("q_id", "position").join(graded.select("q_id", "position", "relevant"), ["q_id", "position"], "left")
    return met.filter(F.coalesce("relevant", F.lit(True))).select("q_id", "position")


def repeated_queries(searches: DataFrame, least: int = 2) -> DataFrame:
    """(session, query, n) of queries that a session asked at least ``least`` times, blanks and case aside."""
    return searches.groupBy("session", F.trim(F.lower("query")).alias("query")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def gathered(parts: list[DataFrame]) -> DataFrame:
    """Findings (id, text) of several researchers, the first of each id, by id."""
    out = None
    for i, p in enumerate(parts):
        one = p.select("id", "text").withColumn("_p", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return first_of(out, ["id"], F.asc("_p"), F.asc("text")).drop("_p").orderBy("id")


def first_appearance(hits: DataFrame) -> DataFrame:
    """Hits (query_ix, rank, doc, chunk) of several queries: each chunk where it first appears, in that order."""
    first = hits.groupBy("doc", "chunk").agg(F.min(F.struct("query_ix", "rank")).alias("m"))
    return first.select("doc", "chunk", "m.query_ix", "m.rank").orderBy("query_ix", "rank", "doc", "chunk")


def parsed_issues(issues: DataFrame, categories: list[str], severities: list[str]) -> DataFrame:
    """Issues (id, file_path, title, category, severity, line) as findings: what is missing gets a default, rows of an unknown category or severity go."""
    filled = {"file_path": "unknown", "title": "Untitled", "category": "bug", "severity": "error"}
    out = issues.select("id", *[F.coalesce(k, F.lit(v)).alias(k) for k, v in filled.items()], "line")
    return out.filter(F.col("category").isin(categories) & F.col("severity").isin(severities))


def known_or(value: Column, known: list[str], otherwise: str) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(known), low).otherwise(otherwise)


def tolerant_json(text: Column, schema: str) -> Column:
    """Issues of a model's JSON answer, whose code fence is taken off: a list, or an object with the list under ``issues``; null for no JSON."""
    bare = F.trim(F.regexp_replace(F.trim(text), "(?i)^`+(?:json)?|`+$", ""))
    whole = F.from_json(bare, f"issues {schema}")["issues"]
    return F.when(F.startswith(bare, F.lit("{")), whole).otherwise(F.from_json(bare, schema))


def at_position(findings: Column, index: Column) -> Column:
    """The finding at a position counted from 0; null out of range."""
    return F.when(index >= 0, F.get(findings, index.cast("int")))


def target_alias(target: Column) -> Column:
    """The branch to compare with; null, which means the local changes, for none, blanks and words for the current branch."""
    bare = F.trim(target)
    return F.when((bare != "") & ~F.lower(bare).isin(*CURRENT), bare)
