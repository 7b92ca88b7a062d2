"""Centroid clustering by plain Lloyd rounds in whole numbers, so that every run gives the same result.

A component x counts as the integer floor(scale * x). Each round broadcasts the centroids
(``k`` rows of ``width`` integers), tasks compute squared differences in NumPy and take the
nearest centroid, the lowest number of equals; each task's sums and counts, one row for a
centroid, are added by a partial aggregate, and only those ``k`` sums come to the driver.
Vectors are never shuffled, so a cluster that holds most of them costs no task more.

Defined results: vectors that are null, of another width, or hold null or non-finite
components are left out; a repeated vec_id is one vector for each of its rows; a null
vec_id is hashed as the empty string, and its vector is clustered as others are; seeds of
equal hash are ordered by their integers; with fewer vectors than ``k`` there are as many
centroids as vectors, and an empty table gives an empty result; empty centroids stay where
they are. Integers beyond 2**26 count as 2**26, so that squared distances of up to 256
components are exact in 64 bits; sums of distances that no 64-bit integer holds are null.
Other columns are left alone.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.memory import released
from loomgraph.storage import cut

#: integers beyond this count as this; rows that are compared at once
MOST, STRIP = 1 << 26, 2048


def _kept(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part."""
    v = F.col("embedding")
    fine = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").filter(F.coalesce(v.isNotNull() & fine, F.lit(False)))


def integers(values, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as rows of 64-bit integers."""
    x = np.empty((len(values), width))
    for row, v in zip(x, values):
        row[:] = v
    with np.errstate(over="ignore"):
        x *= scale
    return np.clip(np.floor(x), -MOST, MOST).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the lowest number of equals, and the squared distance."""
    apart = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        step = x - c
        apart[:, k] = np.einsum("ij,ij->i", step, step)
    at = apart.argmin(1)
    return at, apart[np.arange(len(x)), at]


def _strips(frames, width: int, scale: int, centroids: np.ndarray):
    for pdf in frames:
        for a in range(0, len(pdf), STRIP):
            part = pdf.iloc[a : a + STRIP]
            x = integers(part["embedding"], width, scale)
            yield part, x, *nearest(x, centroids)


def _sums(width: int, scale: int, shared):
    """A task's number of vectors and sums of components for each centroid that has any."""

    def run(frames):
        centroids = shared.value
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64)
        for _, x, at, _ in _strips(frames, width, scale, centroids):
            n += np.bincount(at, minlength=len(n))
            for j in np.flatnonzero(np.bincount(at)):
                total[j] += x[at == j].sum(0)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "total": list(total[some])})

    return run


def _assigned(width: int, scale: int, shared):
    def run(frames):
        for part, _, at, apart in _strips(frames, width, scale, shared.value):
            yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy(), "cluster": at.astype(np.int32), "distance": apart})

    return run


def seeds(kept: DataFrame, k: int, width: int, scale: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``1:<vec_id>``, in that order."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    whole = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)))
    rows = kept.select(key.alias("key"), whole.alias("v")).orderBy("key", "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, width)


def lloyd(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the cluster's centroid of every vector that takes part.

    ``vectors``: (vec_id, embedding). ``distance`` is squared; cluster_inertia and inertia
    are its sums over the cluster and over all.
    """
    if width > 256:
        raise ValueError("squared distances of more than 256 components don't fit in 64 bits")
    spark, kept = vectors.sparkSession, _kept(vectors, width)
    centroids = seeds(kept, k, width, scale)
    for _ in range(rounds if len(centroids) else 0):
        shared = spark.sparkContext.broadcast(centroids)
        parts = kept.select("embedding").mapInPandas(released(_sums(width, scale, shared)), "cluster int, n bigint, total array<bigint>")
        whole = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
        centroids = centroids.copy()
        for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect():  # a row for each centroid
            centroids[row["cluster"]] = [int(row[f"t{i}"]) // row["n"] for i in range(width)]
        shared.unpersist()
    shared = spark.sparkContext.broadcast(centroids)
    found = kept.mapInPandas(released(_assigned(width, scale, shared)), "vec_id bigint, cluster int, distance bigint") if len(centroids) else kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    found = cut(found, "assigned")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    all_ = sum(map(int, sums.values()))
    fit = lambda s: int(s) if int(s) < 1 << 63 else None
    rows = [(j, fit(sums.get(j, 0)), fit(all_), c.tolist()) for j, c in enumerate(centroids)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")  # k rows
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster of 16 after three rounds, and the digest of its centroid."""
    out = lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda x: x.cast("string"))), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _round_sql(k: int) -> str:
    """Round ``k`` as CTEs: c<k> are the centroids before it, a<k> the assignment by them."""
    return f"""
    d{k} AS (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x))::HUGEINT AS d FROM parts v JOIN c{k} c USING (i) GROUP BY v.r, c.c),
    a{k} AS (SELECT r, (min(d * 1024 + c) % 1024)::INT AS c, (min(d * 1024 + c) // 1024)::HUGEINT AS d FROM d{k} GROUP BY r),
    s{k} AS (SELECT a.c, v.i, sum(v.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM parts v JOIN a{k} a USING (r) GROUP BY a.c, v.i),
    c{k + 1} AS (SELECT c.c, c.i, CASE WHEN s.n IS NULL THEN c.x ELSE ((s.s - ((s.s % s.n) + s.n) % s.n) // s.n)::BIGINT END AS x FROM c{k} c LEFT JOIN s{k} s USING (c, i))"""


ORACLE = f"""
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: greatest(least(floor(64 * x::DOUBLE), {MOST}), -{MOST})::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept),
seeds AS (SELECT r, (row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS c FROM kept QUALIFY c < 16),
c0 AS (SELECT s.c, p.i, p.x FROM seeds s JOIN parts p USING (r)),
{",".join(_round_sql(k) for k in range(4))},
inertia AS (SELECT c, sum(d) AS s, sum(sum(d)) OVER () AS total FROM a3 GROUP BY c),
digests AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS digest FROM c3 GROUP BY c)
SELECT k.vec_id, a.c AS cluster, a.d::BIGINT AS distance, t.s::BIGINT AS cluster_inertia, t.total::BIGINT AS inertia, g.digest AS centroid_sha256
FROM kept k JOIN a3 a USING (r) JOIN inertia t ON t.c = a.c JOIN digests g ON g.c = a.c
"""
