"""Indexing that survives a kill, a cache whose keys expire, progress as a table."""

import datetime
import random
import time

import pytest

from loomgraph.streaming import cache, indexing, limits
from loomgraph.tablelog import TableLog

T0 = datetime.datetime(2024, 1, 1)
FILES = "path string, hash string, blank boolean, deleted boolean, at timestamp"


def write_files(spark, folder, n=12):
    rng, rows = random.Random(4), []
    for k in range(n):
        part = [(f"p{rng.randrange(9)}", f"h{rng.randrange(50)}", rng.random() < 0.1, rng.random() < 0.2, T0 + datetime.timedelta(seconds=100 * k + i)) for i in range(7)]
        spark.createDataFrame(part, FILES).coalesce(1).write.mode("append").parquet(folder)
        rows += part
        time.sleep(0.02)
    last = {}
    for r in sorted(rows, key=lambda r: r[4]):
        last[r[0]] = r
    return {(p, r[1]) for p, r in last.items() if not r[2] and not r[3]}


def test_killed_and_restarted_indexing(spark, tmp_path, monkeypatch):
    folder, log = str(tmp_path / "in"), TableLog(spark, str(tmp_path / "log"))
    want = write_files(spark, folder)
    stream = indexing.files_stream(spark, folder, FILES, files=2)
    plain, calls = TableLog.append, []

    def dies(self, table, df, writer=None, batch=None):
        done = plain(self, table, df, writer, batch)
        calls.append(batch)
        if batch == 2 and calls.count(2) == 1:  # after the sink's commit, before the query's own
            raise OSError("killed")
        return done

    monkeypatch.setattr(TableLog, "append", dies)
    with pytest.raises(Exception, match="killed"):
        indexing.index_stream(stream, log, str(tmp_path / "cp")).awaitTermination()
    assert log.version().batches == {"index": 2}
    again = indexing.index_stream(stream, log, str(tmp_path / "cp"))
    again.awaitTermination()
    assert calls.count(2) == 2 and log.read("index").filter("batch = 2").count() == log.read("index", 3).filter("batch = 2").count()
    assert log.version().number == len(set(calls)) == 6
    assert {tuple(r) for r in indexing.indexed(log).collect()} == want
    indexing.compact(log)
    assert {tuple(r) for r in indexing.indexed(log).collect()} == want and log.read("index").filter("deleted").isEmpty()


def drained(rows, checkpoint):
    """All rows of what a stream has waiting, and how many keys its state holds then."""
    out = []
    q = rows.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return out, q.lastProgress["stateOperators"][0]["numRowsTotal"]


def brute_cache(rows, seconds=45):
    last, out = {}, set()
    for key, request, at in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        hit = key in last and (at - last[key]).total_seconds() < seconds
        if not hit:
            last[key] = at
        out.add((key, request, hit))
    return out


def test_cache_batch(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(4) if rng.random() < 0.5 else 0}", i, T0 + datetime.timedelta(milliseconds=rng.randrange(600_000))) for i in range(3000)]
    rows += [("z", 9000 + i, T0 + datetime.timedelta(seconds=45 * i)) for i in range(3)]  # exactly the life
    got = cache.cached(spark.createDataFrame(rows, "key string, request bigint, at timestamp")).collect()
    assert {(r.key, r.request, r.hit) for r in got} == brute_cache(rows)
    assert cache.cached(spark.createDataFrame([], "key string, request bigint, at timestamp")).count() == 0


def test_cache_keys_leave_the_store(spark, tmp_path):
    folder, rows = str(tmp_path / "in"), []
    schema = "key string, request bigint, at timestamp"

    def arrive(k, keys):
        part = [(key, 10 * k + i, T0 + datetime.timedelta(seconds=40 * k + i)) for i, key in enumerate(keys)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        rows.extend(part)

    arrive(0, ["a", "b", "c", "a"])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got, held = set(), []
    for k, keys in enumerate([None, ["a", "b"], ["b"], ["b"], ["b"], ["b"]]):
        if keys:
            arrive(k, keys)
        done, state = drained(cache.cached_stream(stream), str(tmp_path / "cp"))
        got |= {(r.key, r.request, r.hit) for r in done}
        held.append(state)
    assert got == brute_cache(rows)
    assert held[0] == 3 and held[-1] <= 1  # only b is asked any more


def test_rate_limiter_forgets_silent_clients(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "client bigint, request bigint, at double"
    spark.createDataFrame([(c, c, 0.0) for c in range(5)], schema).coalesce(1).write.parquet(folder)
    limited = limits.rate_limited_stream(spark.readStream.schema(schema).parquet(folder), 2, 5.0)
    rows, held = drained(limited, str(tmp_path / "cp"))
    assert held == 5
    for k in range(2):
        spark.createDataFrame([(9, 90 + k, 100.0 + k)], schema).coalesce(1).write.mode("append").parquet(folder)
        more, held = drained(limited, str(tmp_path / "cp"))
        rows += more
    assert len(rows) == 7 and held <= 1


def test_progress_table(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "phase string, item bigint"
    for k in range(4):
        spark.createDataFrame([(p, k) for p in ["scan"] * (k + 1) + ["review"] * 2], schema).coalesce(1).write.mode("append").parquet(folder)
    log = TableLog(spark, str(tmp_path / "log"))
    watch = indexing.Progress(log)
    spark.streams.addListener(watch)
    try:
        rows = indexing.observed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), "items", ["scan", "review", "done"])
        rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if log.version().number >= 4:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    got = {r.metric: r.n for r in log.read("progress").groupBy("metric").agg({"value": "sum"}).withColumnRenamed("sum(value)", "n").collect()}
    batch = {r.phase: r["count"] for r in spark.read.parquet(folder).groupBy("phase").count().collect()}
    assert got == {"items.total": sum(batch.values()), "items.phase_scan": batch["scan"], "items.phase_review": batch["review"], "items.phase_done": 0}
