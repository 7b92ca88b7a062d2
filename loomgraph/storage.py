"""Intermediate tables in the folder that all executors share.

``cut`` writes a DataFrame there as Parquet and reads it again, which ends its
lineage: a lost executor costs a reread, not a recomputation. Tables stay until they are
dropped: by who made them, or all since a ``mark`` once a result has been written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which an execution deletes its shuffle files when it ends
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine if all runs on it, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written to the shared folder and read back; the write's own shuffle files go as soon as it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` made and nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, {f.rpartition("/")[0] for f in df.inputFiles()})


def _delete(spark: SparkSession, folders) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    for folder in folders:
        if root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    gone = {f.split(":", 1)[-1].lstrip("/") for f in folders}
    _made[:] = [p for p in _made if p.split(":", 1)[-1].lstrip("/") not in gone]


def mark() -> int:
    """A point in this session's list of tables, for ``drop_since``."""
    return len(_made)


def drop_since(at: int, *keep: DataFrame) -> None:
    """Delete what ``cut`` made since ``mark`` gave ``at``, but for the tables to keep; for when a result has been written."""
    kept = {f.rpartition("/")[0].split(":", 1)[-1].lstrip("/") for df in keep for f in df.inputFiles()}
    old = [p for p in _made[at:] if p.split(":", 1)[-1].lstrip("/") not in kept]
    if keep and old:
        _delete(keep[0].sparkSession, old)
