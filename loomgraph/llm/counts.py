"""A count table of fixed size for the shingles of any number of sets, and the order by it."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: counters of the table, and the parts it travels in
COUNTERS, PARTS = 1 << 20, 64


def count_parts(table: np.ndarray) -> pd.DataFrame:
    """The parts (part, salt, counts) of a task's table that have counts."""
    pid = TaskContext.get().partitionId() % 64
    parts = np.split(table, PARTS)
    some = [i for i in range(PARTS) if parts[i].any()]
    return pd.DataFrame({"part": pd.array(some, "Int32"), "salt": pd.array([pid] * len(some), "Int32"), "counts": [zlib.compress(parts[i].astype("<u8").tobytes(), 1) for i in some]})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(c), "<u8") for c in pdf["counts"])
    return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "salt": 0, "counts": [zlib.compress(total.tobytes(), 1)]})


def count_table(scanned: DataFrame) -> np.ndarray:
    """The summed count table: COUNTERS numbers, whatever the corpus. Summed in two levels."""
    kind = "part int, salt int, counts binary"
    parts = scanned.filter(F.col("part").isNotNull()).select("part", "salt", "counts")
    parts = parts.groupBy("part", "salt").applyInPandas(_add, kind).groupBy("part").applyInPandas(_add, kind)
    table = np.zeros((PARTS, COUNTERS // PARTS), np.uint64)
    for row in parts.collect():  # at most PARTS rows of COUNTERS / PARTS numbers
        table[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), "<u8")
    return table.ravel()


def rare_first(shingles: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The shingles by count, then hash: one order for all documents. ``shingles`` is sorted."""
    often = np.minimum(table[shingles & np.uint64(COUNTERS - 1)], np.uint64((1 << 24) - 1))
    return shingles[np.argsort((often << np.uint64(40)) | (shingles >> np.uint64(24)), kind="stable")]


def set_counts(frames):
    """The parts of a task's table over sets (shingles, sorted 64-bit hashes)."""
    table = np.zeros(COUNTERS, np.uint32)
    for pdf in frames:
        for shingles in pdf["shingles"]:
            table[np.frombuffer(shingles, np.uint64) & np.uint64(COUNTERS - 1)] += 1
    yield count_parts(table)
