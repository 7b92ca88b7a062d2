"""Indexing as a stream: bounded triggers, an idempotent sink, and its progress as a table.

A trigger takes a bounded number of files. What it changes is appended to the index as rows
with the batch's number, once for each batch, so a query that is killed between the sink's
commit and its own takes nothing twice. The index is the newest row of each path; blank and
deleted files leave it. ``compact`` folds the history into one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from loomgraph.tablelog import TableLog

#: files that one trigger takes
FILES = 10


def files_stream(spark: SparkSession, folder: str, schema, files: int = FILES) -> DataFrame:
    """Rows of the Parquet files under ``folder``, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def newest(rows: DataFrame, order: list[str]) -> DataFrame:
    """The last row of each path."""
    rest = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("path", *[F.col("r")[c].alias(c) for c in rest])


def index_stream(files: DataFrame, log: TableLog, checkpoint: str, writer: str = "index") -> StreamingQuery:
    """Start indexing files (path, hash, blank, deleted, at) into the log's table ``index``; takes what there is, then stops."""

    def sink(batch: DataFrame, number: int) -> None:
        last = newest(batch, ["at", "hash"]).withColumn("batch", F.lit(number).cast("bigint"))
        log.append("index", last.select("path", "hash", "blank", "deleted", "at", "batch"), writer, number)

    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(log: TableLog) -> DataFrame:
    """(path, hash) of what is indexed now."""
    return newest(log.read("index"), ["at", "batch"]).filter("NOT blank AND NOT deleted").select("path", "hash")


def compact(log: TableLog) -> int:
    """The index's history as its newest rows, deletions left out."""
    return log.update("index", lambda df: newest(df, ["at", "batch"]).filter("NOT deleted").select(*df.columns))


def observed(rows: DataFrame, name: str, phases: list[str]) -> DataFrame:
    """``rows`` (phase, ...) with counts by phase as metrics of the query that runs over them."""
    return rows.observe(name, F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("phase") == p).alias(f"phase_{p}") for p in phases])


class Progress(StreamingQueryListener):
    """Writes what ``observed`` counts, batch by batch, to a table of the log: (query, batch, metric, value)."""

    def __init__(self, log: TableLog, table: str = "progress"):
        self.log, self.table = log, table

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(str(p.id), p.batchId, f"{name}.{k}", int(v)) for name, row in p.observedMetrics.items() for k, v in row.asDict().items()]
        if rows:
            self.log.append(self.table, self.log.spark.createDataFrame(rows, "query string, batch bigint, metric string, value bigint"), f"progress/{p.id}", p.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
