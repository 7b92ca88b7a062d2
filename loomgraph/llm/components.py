"""Connected components of an edge table, and the small union-find that tasks use.

Distributed: the large-star and small-star steps alternate until no edge changes. Each
step is a partial aggregate and a join, so a vertex with many edges needs no task of
its own; rounds are cut through the shared folder. What each task's edges connect is
first reduced to stars, which shortens long chains.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.memory import released
from loomgraph.storage import cut, drop

EDGE = "a bigint, b bigint"


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) of the edges a-b, without the smallest themselves."""
    both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    n = len(a)
    x, y = at[:n], at[n:]
    label = np.arange(len(both))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(both))
    return both[keep], both[label[keep]]


def _local(edges: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            a, b = stars(np.concatenate([a, x]), np.concatenate([b, y]))
            if len(a) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a, b = a[:0], b[:0]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(released(run), EDGE)


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) of every vertex with an edge to another; component is its smallest vertex.

    ``edges`` has columns a and b; loops, repeats and either direction are allowed, and
    rows with a null are no edges.
    """
    now = cut(_local(edges.filter("a <> b")), "cc")  # a > b: each vertex under the smallest that its task saw
    for _ in range(max_rounds):
        # large star: neighbours above u go under the smallest of u and its neighbours
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: neighbours below u, and u, go under the smallest of them
        large = cut(large, "cc")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("top"))
        moved = large.join(low.filter("m < top"), "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(_local(low.select("a", F.col("m").alias("b")).unionByName(moved)), "cc")
        settled = _print(new) == _print(now)  # only stars stay as they are
        drop(now, large)
        now = new
        if settled:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
