"""Change detection, staleness, queue views, retention and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.tablelog import TableLog


def changes(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(path, state) of disk (path, hash, blank) against index (path, hash): new, changed, unchanged, skipped or deleted."""
    met = disk.select("path", F.col("hash").alias("now"), "blank").join(index.select("path", F.col("hash").alias("was")), "path", "full")
    state = (
        F.when(F.col("now").isNull(), "deleted")
        .when(F.col("blank"), "skipped")
        .when(F.col("was").isNull(), "new")
        .when(F.col("was") != F.col("now"), "changed")
        .otherwise("unchanged")
    )
    return met.select("path", state.alias("state"))


def in_scope(df: DataFrame, scopes: list[str]) -> DataFrame:
    """Rows whose path is a scope or lies under one; deletions outside a scope are none of its business."""
    cond = F.lit(False)
    for s in scopes:
        cond = cond | (F.col("path") == s) | F.startswith("path", F.lit(s.rstrip("/") + "/"))
    return df.filter(cond)


def supersede(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The newest value of each key, with how many it supersedes."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias("latest"), (F.count("*") - 1).alias("superseded"))


def stuck(jobs: DataFrame, at: str, minutes: int, now) -> DataFrame:
    return jobs.filter(F.col(at) < F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES"))


def index_complete(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """(expected, missing, complete): complete if all expected paths are indexed and there are some."""
    missing = expected.join(indexed, "path", "left_anti").agg(F.count("*").alias("missing"))
    return expected.agg(F.count("*").alias("expected")).join(missing).withColumn("complete", (F.col("expected") > 0) & (F.col("missing") == 0))


def publish(tables: dict[str, DataFrame], root: str, keep: int = 3) -> int:
    """A new version of the tables under ``root``, seen whole or not at all; older versions but ``keep`` go."""
    log = TableLog(next(iter(tables.values())).sparkSession, root)
    version = log.replace(tables)
    log.vacuum(keep)
    return version


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return TableLog(spark, root).read(name)
