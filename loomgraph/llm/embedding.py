"""Embedding near-duplicates: cells by spherical k-means, cosines within cells.

Equal directions are collapsed first. About half as many centres as the square root of
the vectors are trained on a bounded sample; every vector is then assigned to the nearest.
A pair in two cells has the plane between their centres in its middle. A vector so near to
a plane that a step of the search radius may cross it is sent to the other cell too, as a
guest, so the pair meets there; it is counted in one cell. A step in any of d dimensions
moves along the plane's normal by the radius over the square root of d, as a standard
deviation; SIGMAS of these are allowed for, and never more than the radius itself, which
makes the search exact up to SIGMAS squared dimensions. d is not the vectors' width but how
many dimensions their spread within cells fills, by the training sample; and if of the near
pairs in that sample any but a few in a thousand would not meet, the whole radius is used.
Recall against brute force is tested, for vectors that fill few dimensions too. Cells of any size are compared in blocks; tasks return counts and a spanning
forest, never the pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components link
with nothing and are kept; vectors of different widths don't link; rows with equal vectors
are linked; a repeated vec_id is one vector for each of its rows; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.components import components, stars
from loomgraph.llm.memory import released
from loomgraph.storage import cut

#: sample rows for training; most centres; rows of a block; deviations of a step across a plane
SAMPLE, MOST_CELLS, BLOCK, SIGMAS = 10_000, 2048, 4096, 3.0


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """``k`` unit centres of the unit rows ``x``; a centre without rows moves to the row worst served."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        scores = x @ c.T
        at = scores.argmax(1)
        best = scores[np.arange(len(x)), at]
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        norm = np.linalg.norm(new, axis=1)
        empty = np.flatnonzero(norm < 1e-12)
        new[empty] = x[np.argsort(best)[: len(empty)]]
        norm[empty] = 1.0
        c = new / norm[:, None]
    return c


def _clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of usable vectors."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("v"))


def _unit(values, dim: int) -> np.ndarray:
    """Unit rows; shorter vectors are filled up with zeros."""
    x = np.zeros((len(values), dim))
    for row, a in zip(x, values):
        row[: len(a)] = a
    x /= np.abs(x).max(1)[:, None]  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1))[:, None]


def free_dimensions(x: np.ndarray, centres: np.ndarray, least: int = 16, quantile: float = 0.1) -> float:
    """How many dimensions the rows ``x`` fill around their centres: (sum of variances)^2 / (sum of their squares), corrected for the sample's size.

    A low quantile over cells, by rows; 1 where no cell has ``least`` rows.
    """
    at = (x @ centres.T).argmax(1)
    found = []
    for c in range(len(centres)):
        r = x[at == c]
        n = len(r) - 1
        if n + 1 < least:
            continue
        r = r - r.mean(0)
        one, two = (r * r).sum() / n, ((r @ r.T) ** 2).sum() / n**2
        if one < 1e-12:  # all alike
            continue
        squares = (two - one**2 / n) * n**2 / ((n - 1) * (n + 2))
        found.append((one**2 / squares if squares > one**2 / x.shape[1] else x.shape[1], n + 1))
    if not found:
        return 1.0
    d, n = (np.array(v) for v in zip(*sorted(found)))
    return float(max(1.0, d[np.searchsorted(np.cumsum(n), quantile * n.sum())]))


def missed(x: np.ndarray, centres: np.ndarray, step: float, threshold: float, queries: int = 2000) -> float:
    """The share of near pairs of the sample ``x``, those of its first rows with any, that would not meet in a cell."""
    home, near = _cells(x, centres, gaps(centres), step)
    a, b = np.nonzero(x[:queries] @ x.T >= threshold)
    a, b = a[a != b], b[a != b]
    return float(((home[a] != home[b]) & ~near[a, home[b]] & ~near[b, home[a]]).mean()) if len(a) else 0.0


def reach(radius: float, dim: float, sigmas: float = SIGMAS) -> float:
    """How far a step of ``radius`` is taken to go along a plane's normal."""
    return radius * min(1.0, sigmas / math.sqrt(dim))


def step_of(train: np.ndarray, centres: np.ndarray, radius: float, threshold: float, sigmas: float = SIGMAS, most_missed: float = 0.005) -> float:
    """How far a step of ``radius`` is taken to go along a plane's normal, for vectors such as the sample's."""
    step = reach(radius, free_dimensions(train, centres), sigmas)
    return radius if missed(train, centres, step, threshold) > most_missed else step


def _cells(x: np.ndarray, centres: np.ndarray, gap: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit row's home cell, and which others it visits: those whose plane between the centres (``gap`` apart) is within half the step."""
    scores = x @ centres.T
    home = scores.argmax(1)
    near = scores[np.arange(len(x)), home][:, None] - scores <= step / 2 * gap[home] + 1e-9
    near[np.arange(len(x)), home] = False
    return home, near


def gaps(centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))


def cells_for(n: int, most_cells: int = MOST_CELLS) -> int:
    """A power of two about half the square root of ``n``; one only for fewer than 16 vectors."""
    k = 1
    while k < most_cells and (2 * k) ** 2 * 4 <= n:
        k *= 2
    return k


def _guests(centres: np.ndarray, step: float, rows: int = 1000):
    def run(frames):
        gap = gaps(centres)
        for pdf in frames:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                home, near = _cells(_unit(part["v"], centres.shape[1]), centres, gap, step)
                row, cell = np.nonzero(near)
                row = np.concatenate([np.arange(len(part)), row])
                lower = [np.flatnonzero(near[i, : home[i]]).astype(np.int32) for i in range(len(part))]
                yield pd.DataFrame({
                    "cell": np.concatenate([home, cell]).astype(np.int32), "home": home[row].astype(np.int32), "lower": [*lower, *[None] * len(cell)],
                    "rep": part["rep"].to_numpy()[row], "n": part["n"].to_numpy()[row], "v": part["v"].to_numpy()[row],
                })

    return run


def _compare(threshold: float, cells: int, dim: int):
    """Pairs within a cell's block, or between two blocks: per vector its links (weighed by copies), and forest edges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iat[0]), int(pdf["j"].iat[0])
        cell = int(pdf["cell"].iat[0])
        left, right = pdf[pdf["b"] == i], pdf[pdf["b"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
        parts = []
        for side in (left, right):
            home = side["home"].to_numpy()
            visits = np.zeros((len(side), cells), bool)
            for k, lower in enumerate(side["lower"]):
                if lower is not None and home[k] == cell:
                    visits[k, np.asarray(lower, int)] = True
            parts.append((home, visits, side["rep"].to_numpy(), side["n"].to_numpy(), side["v"].map(len).to_numpy()))
        (ha, va, ra, na, wa), (hb, vb, rb, nb, wb) = parts
        ga, gb = ha != cell, hb != cell
        a, b = _unit(left["v"], dim), _unit(right["v"], dim).T
        links_a, links_b, out = np.zeros(len(a)), np.zeros(b.shape[1]), []
        for k in range(0, len(a), 512):  # in strips, so that a block of copies needs little memory
            x, y = np.nonzero(a[k : k + 512] @ b >= threshold)
            x += k
            good = ~(ga[x] & gb[y]) & (wa[x] == wb[y])  # two guests meet elsewhere
            # a pair whose two members visit each other counts in the lower of their cells
            good &= ~(va[x, hb[y]] & gb[y]) & ~(vb[y, ha[x]] & ga[x])
            if i == j:
                good &= x < y
            x, y = x[good], y[good]
            links_a += np.bincount(x, weights=nb[y], minlength=len(ra))
            links_b += np.bincount(y, weights=na[x], minlength=len(rb))
            if len(x):
                v, root = stars(ra[x], rb[y])
                out.append(pd.DataFrame({"a": v, "b": root, "links": 0}))
        out += [pd.DataFrame({"a": ra, "b": ra, "links": links_a}), pd.DataFrame({"a": rb, "b": rb, "links": links_b})]
        out = pd.concat(out)
        return out[(out["links"] > 0) | (out["a"] != out["b"])].astype("int64")

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, sample: int = SAMPLE, most_cells: int = MOST_CELLS, block: int = BLOCK, sigmas: float = SIGMAS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding)."""
    src = vectors.select("vec_id", "embedding")
    good = _clean(src)
    # equal vectors: one row for all, with their number and smallest id
    key = F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x.cast("double") + F.lit(0.0)).cast("string"))), 256)
    keyed = cut(good.select("vec_id", key.alias("key"), "v"), "vectors")
    reps = cut(keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("v").alias("v")), "reps")
    total, dim = reps.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return src.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    train = [r["v"] for r in reps.orderBy(F.xxhash64("rep")).select("v").limit(sample).collect()]
    # |x - y| for two unit vectors with this cosine
    radius, train = float(np.sqrt(max(0.0, 2 - 2 * threshold))), _unit(train, dim)
    centres = spherical_kmeans(train, cells_for(total, most_cells))
    step = step_of(train, centres, radius, threshold, sigmas)
    kind = keyed.schema["v"].dataType.simpleString()
    cells = reps.select("rep", "n", "v").mapInPandas(released(_guests(centres, step)), f"cell int, home int, lower array<int>, rep bigint, n bigint, v {kind}")
    cells = cut(cells, "cells")
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("blocks"))  # at most ``most_cells`` rows
    placed = cells.join(F.broadcast(sizes), "cell").withColumn("b", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    pairs = placed.withColumn("o", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).select("cell", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "home", "lower", "rep", "n", "v")
    found = cut(pairs.groupBy("cell", "i", "j").applyInPandas(_compare(threshold, len(centres), dim), "a bigint, b bigint, links bigint"), "links")
    links = found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(found.filter("a <> b").select("a", "b")).select(F.col("vertex").alias("rep"), "component")
    classes = reps.select("key", "rep", "n").join(links, "rep", "left").join(groups, "rep", "left")
    by_key = classes.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    done = keyed.select("vec_id", "key").join(by_key, "key").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = src.select("vec_id").join(done, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links, component and whether it is kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
