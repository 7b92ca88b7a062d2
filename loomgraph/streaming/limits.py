"""Stateful streams: the sliding-window rate limiter, newest pushes, stuck jobs, and change capture.

Event-time windows and sessions are an extension beyond what the queries need.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST, SECONDS = 60, 60.0


def admit(times, taken: list[float], most: int = MOST, seconds: float = SECONDS) -> tuple[list[bool], list[float]]:
    """Which requests at ordered times are let in: fewer than ``most`` admissions within the last ``seconds``; refused ones aren't recorded."""
    out = []
    for t in times:
        taken = [x for x in taken if t - x < seconds]
        out.append(len(taken) < most)
        if out[-1]:
            taken.append(t)
    return out, taken


#: added to times in the stream form, whose watermark begins at the epoch: rows at it would be late
DAY = 86_400
OUT = "client bigint, request bigint, at double, admitted boolean"


def rate_limited(requests: DataFrame, most: int = MOST, seconds: float = SECONDS) -> DataFrame:
    """Batch form: requests (client, request, at) with ``admitted``. State is one client's admissions in the window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "request"])
        return pdf.assign(admitted=admit(pdf["at"], [], most, seconds)[0])[["client", "request", "at", "admitted"]]

    return requests.groupBy("client").applyInPandas(run, OUT)


def rate_limited_stream(requests: DataFrame, most: int = MOST, seconds: float = SECONDS, late: str = "10 seconds") -> DataFrame:
    """Stream form, exact over micro batches that arrive in order.

    A client leaves the state store once the watermark has passed its last admission's window.
    """

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values(["at", "request"])
        admitted, taken = admit(pdf["at"], taken, most, seconds)
        over = int((DAY + max(taken) + seconds) * 1000) + 1
        if over > state.getCurrentWatermarkMs():
            state.update((taken,))
            state.setTimeoutTimestamp(over)
        elif state.exists:
            state.remove()
        yield pdf.assign(admitted=admitted)[["client", "request", "at", "admitted"]]

    timed = requests.select("client", "request", "at", F.timestamp_seconds(DAY + F.col("at")).alias("ts")).withWatermark("ts", late)
    return timed.groupBy("client").applyInPandasWithState(run, OUT, "taken array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def newest_pushes(pushes: DataFrame) -> DataFrame:
    """Newest commit of each repository so far (update mode): later pushes supersede."""
    return pushes.groupBy("repo").agg(F.max_by("commit", "at").alias("commit"), F.max("at").alias("at"))


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Watermarked window counts by type (extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Watermarked sessions by user (extension)."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
