"""Index state: versions, staleness, repositories, sessions, caches, manifests, graph export."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.relational import upsert
from loomgraph.operators.review import graph_violations


def next_version(index: DataFrame) -> DataFrame:
    """(repo, version): one more than the newest, or 1."""
    return index.groupBy("repo").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))


def stale(repos: DataFrame) -> DataFrame:
    """repos (repo, indexed_version, newest_version, indexed_sha, head_sha) with why an index is behind, or null."""
    why = F.when(F.col("indexed_version").isNull(), "not indexed").when(F.col("indexed_version") < F.col("newest_version"), "version behind").when(F.col("indexed_sha") != F.col("head_sha"), "commit behind")
    return repos.withColumn("stale", why)


def version_key(version: Column) -> Column:
    """Comparable form of a dotted version; parts that are no numbers count as 0."""
    return F.transform(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(0)))


def outdated(installed: DataFrame, latest: str) -> DataFrame:
    return installed.withColumn("outdated", version_key(F.col("version")) < version_key(F.lit(latest)))


def register(repos: DataFrame, new: DataFrame) -> DataFrame:
    """Repositories with ``new`` ones put in or replaced by full name."""
    return upsert(repos, new, ["full_name"])


def abandon(sessions: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Open sessions without a change for ``hours`` become abandoned."""
    old = (F.col("status") == "open") & (F.col("updated_at") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return sessions.withColumn("status", F.when(old, "abandoned").otherwise(F.col("status")))


def last_session(sessions: DataFrame, branch: str | None = None) -> DataFrame:
    found = sessions.filter(F.col("branch") == branch) if branch else sessions
    return found.orderBy(F.desc("updated_at"), "session_id").limit(1)


def cache_key(*parts: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def collection_name(slug: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(slug), "[^a-z0-9_-]+", "_"), "^_+|_+$", "")


def branch_allowed(branch: Column, patterns: list[str]) -> Column:
    from loomgraph.functions.expressions import glob_regex

    out = F.lit(False)
    for p in patterns:
        out = out | branch.rlike(glob_regex(p))
    return out


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes (id, ...) and edges (src, dst, ...) as JSON lines under ``path``; a graph with violations is refused."""
    bad = graph_violations(nodes, edges).limit(5).collect()
    if bad:
        raise ValueError("graph not exported: " + json.dumps([list(r) for r in bad]))
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def save_run(metrics: DataFrame, path: str) -> None:
    """A run's metrics appended to the history."""
    metrics.write.mode("append").json(path)


def route_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (id, parent_id, ...) to parents, those that others name, and children, all others."""
    named = chunks.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    return chunks.join(named, "id", "left_semi"), chunks.join(named, "id", "left_anti")


def without_file(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Chunks of files that aren't in ``gone`` (path)."""
    return chunks.join(gone.select("path"), "path", "left_anti")
