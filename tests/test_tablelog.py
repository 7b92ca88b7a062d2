"""Versions under racing and crashing writers, and sessions on top."""

import datetime
import threading

import pytest

from loomgraph.tablelog import Conflict, Sessions, TableLog, Version, counted


def test_versions_and_time_travel(spark, tmp_path):
    log = TableLog(spark, str(tmp_path))
    assert log.version().number == 0
    with pytest.raises(LookupError):
        log.read("t")
    assert log.append("t", spark.range(3)) == 1 and log.append("t", spark.range(2)) == 2
    assert log.replace({"t": spark.range(1), "u": spark.range(4)}) == 3
    assert log.update("t", lambda df: df.unionByName(spark.range(5, 7))) == 4
    assert [log.read("t", n).count() for n in (1, 2, 3, 4)] == [3, 5, 1, 3] and log.read("u").count() == 4
    assert log.update("t", lambda df: None) == 4
    with pytest.raises(ValueError):
        log.append("t", spark.range(1).withColumnRenamed("id", "other"))
    assert log.compact("t") == 5 and len(log.version().tables["t"]["parts"]) == 1
    gone = log.vacuum(keep=1, hours=0)
    assert gone and log.versions() == [5] and log.read("t").count() == 3 and log.read("u").count() == 4
    with pytest.raises(LookupError):
        log.read("t", 2)


def test_racing_writers_lose_nothing(spark, tmp_path):
    root, errors = str(tmp_path), []
    TableLog(spark, root).append("t", spark.range(0))

    def work(k):
        try:
            log = TableLog(spark, root)
            for i in range(4):
                if k % 2:
                    log.append("t", spark.range(k * 100 + i, k * 100 + i + 1))
                else:  # depends on what it reads
                    log.update("t", lambda df: df.unionByName(spark.range(k * 100 + i, k * 100 + i + 1)))  # noqa: B023
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = TableLog(spark, root)
    assert not errors
    assert sorted(r.id for r in log.read("t").collect()) == sorted(k * 100 + i for k in range(4) for i in range(4))
    assert log.versions() == list(range(1, 18))


def test_crash_before_the_commit_leaves_the_old_version(spark, tmp_path, monkeypatch):
    log = TableLog(spark, str(tmp_path))
    log.append("t", spark.range(3))

    def crash(self, version):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(TableLog, "_claim", crash)
        with pytest.raises(OSError):
            log.append("t", spark.range(10))
    assert log.version().number == 1 and log.read("t").count() == 3
    assert len(log.vacuum(keep=3, hours=0)) == 1  # the crashed writer's part
    with monkeypatch.context() as m:
        m.setattr(TableLog, "_claim", lambda self, version: False)
        with pytest.raises(Conflict):
            log.commit(lambda v: Version(0, v.tables, v.batches), tries=2)
    assert log.append("t", spark.range(1)) == 2 and log.read("t").count() == 4


def test_batches_come_in_once(spark, tmp_path):
    log = TableLog(spark, str(tmp_path))
    for batch in (0, 1, 1, 0, 2, 2):
        log.append("t", spark.range(batch, batch + 1), "stream", batch)
    assert sorted(r.id for r in log.read("t").collect()) == [0, 1, 2] and log.version().number == 3


def test_sessions(spark, tmp_path):
    s = Sessions(spark, str(tmp_path))
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    row = lambda *r: spark.createDataFrame([r], "session_id string, folder string, status string, phase string, at timestamp")
    s.save(row("a", "main-1", "active", "scan", at(1)))
    s.save(row("b", "dev-2", "active", "scan", at(2)))
    s.save(row("a", "main-1", "active", "review", at(3)))
    assert {(r.session_id, r.phase) for r in s.states().collect()} == {("a", "review"), ("b", "scan")}
    assert [r.session_id for r in s.find("dev-2").collect()] == ["b"] and s.find("zz").isEmpty()
    s.abandon_others("a", at(5))
    assert {r.session_id: r.status for r in s.states().collect()} == {"a": "active", "b": "abandoned"}
    found = spark.createDataFrame([(None, None, "x", k, f"f{k}") for k in range(3)], "session_id string, source string, phase string, ordinal bigint, finding string")
    assert s.static_findings_once("a", found) and not s.static_findings_once("a", found)
    s.checkpoint("a", "review", found)
    s.checkpoint("a", "review", found.filter("ordinal = 0"))
    s.checkpoint("a", "plan", found)
    s.append_findings(found.selectExpr("'a' AS session_id", "'model' AS source", "phase", "ordinal", "finding"))
    assert {(r.session_id, r.source): r.n for r in counted(s).collect()} == {("a", "static"): 3, ("a", "checkpoint"): 4, ("a", "model"): 3}
    assert s.delete("a") and not s.delete("a") and counted(s).isEmpty()
    assert [r.session_id for r in Sessions(spark, str(tmp_path)).states().collect()] == ["b"]
