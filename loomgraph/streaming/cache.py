"""A cache whose entries live for a while: which requests it answers, and which refresh it.

A key's first request refreshes; those within ``seconds`` after a refresh are answered from the
cache, the first one later refreshes again. Requests of a key are in order of time, then
number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SECONDS = 45.0
OUT = "key string, request bigint, at timestamp, hit boolean"


def hits(at: np.ndarray, refreshed: int | None, seconds: float = SECONDS) -> tuple[np.ndarray, int | None]:
    """Which requests at these ordered times (microseconds) are answered, and the last refresh. A step for each refresh."""
    out, life, i = np.ones(len(at), bool), int(seconds * 1e6), 0
    if refreshed is not None:
        i = int(np.searchsorted(at, refreshed + life))
    while i < len(at):
        out[i], refreshed = False, int(at[i])
        i = int(np.searchsorted(at, refreshed + life))
    return out, refreshed


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def cached(requests: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """Batch form: requests (key, request, at) with ``hit``. Keys are dealt and sorted; a task keeps one key's last refresh."""

    def run(frames):
        key, refreshed = None, None
        for pdf in frames:
            at, keys = _micros(pdf["at"]), pdf["key"].to_numpy()
            hit = np.empty(len(pdf), bool)
            edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else [0]
            for a, b in zip(edges, edges[1:]):
                hit[a:b], refreshed = hits(at[a:b], refreshed if keys[a] == key else None, seconds)
                key = keys[a]
            yield pdf.assign(hit=hit)

    dealt = requests.select("key", "request", "at").repartition("key").sortWithinPartitions("key", "at", "request")
    return dealt.mapInPandas(run, OUT)


def cached_stream(requests: DataFrame, seconds: float = SECONDS, late: str = "10 seconds") -> DataFrame:
    """Stream form. A key's state is its last refresh, and leaves the store once the watermark has passed its life."""

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        refreshed = state.get[0] if state.exists else None
        pdf = pd.concat(list(frames)).sort_values(["at", "request"])
        hit, refreshed = hits(_micros(pdf["at"]), refreshed, seconds)
        over = (refreshed + int(seconds * 1e6)) // 1000 + 1
        if over > state.getCurrentWatermarkMs():
            state.update((refreshed,))
            state.setTimeoutTimestamp(over)
        elif state.exists:
            state.remove()
        yield pdf.assign(hit=hit)[["key", "request", "at", "hit"]]

    return requests.withWatermark("at", late).groupBy("key").applyInPandasWithState(run, OUT, "refreshed bigint", "append", GroupStateTimeout.EventTimeTimeout)


def summary(answered: DataFrame) -> DataFrame:
    """(key, requests, hits) of answered requests."""
    return answered.groupBy("key").agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits"))
