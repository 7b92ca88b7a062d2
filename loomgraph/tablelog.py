"""Named tables under one folder, changed in versions: a log that writers race for and readers trust.

``root/log/<number>.json`` lists every table's parts at that version; ``root/data`` has the
parts, Parquet folders written before the entry that names them. An entry is written beside
the log and then put under its number by one atomic step that fails if the number is taken,
so a version is there whole or not at all: a crash leaves the version before it, and the loser
of a race reads the newer version, looks again at what it wants to change, and tries the next
number. Readers take the highest number; what they read is never rewritten.

Appends carry over from any version. Changes that depend on what they read (``update``) are
computed again from the newer version when they lose. An append can carry a writer's name and
batch number, and is left out if that batch is in already, which makes a stream's sink
idempotent.

The atomic step is a hard link on local and mounted file systems, and elsewhere a rename that
refuses to replace, as HDFS has it; stores without either can't hold the log.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """A change lost against others more often than it was to be tried."""


@dataclass
class Version:
    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)  # name: {"schema": json, "parts": [folder]}
    batches: dict[str, int] = field(default_factory=dict)  # writer: last batch


class TableLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        for folder in ("log", "data", "new"):
            self.fs.mkdirs(self._path(folder))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # --- reading ---------------------------------------------------------

    def versions(self) -> list[int]:
        found = (s.getPath().getName() for s in self.fs.listStatus(self._path("log")))
        return sorted(int(n[:-5]) for n in found if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of a number; the empty one before the first."""
        found = self.versions()
        if number is None:
            number = found[-1] if found else 0
        if not number:
            return Version()
        if number not in found:
            raise LookupError(f"no version {number}")
        stream = self.fs.open(self._path(f"log/{number:020d}.json"))
        try:
            body = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, body["tables"], body["batches"])

    def read(self, table: str, number: int | None = None) -> DataFrame:
        return self._frame(self.version(number), table)

    def _frame(self, version: Version, table: str) -> DataFrame:
        if table not in version.tables:
            raise LookupError(f"no table {table} in version {version.number}")
        from pyspark.sql.types import StructType

        known = version.tables[table]
        schema = StructType.fromJson(known["schema"])
        parts = [f"{self.root}/{p}" for p in known["parts"]]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    # --- changing --------------------------------------------------------

    def _write(self, table: str, df: DataFrame) -> str:
        part = f"data/{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{part}")
        return part

    def _claim(self, version: Version) -> bool:
        """Put an entry under its number; False if that is taken."""
        beside, own = self._path(f"new/{uuid.uuid4().hex}"), self._path(f"log/{version.number:020d}.json")
        out = self.fs.create(beside, False)
        out.write(bytearray(json.dumps({"tables": version.tables, "batches": version.batches}).encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                local = lambda p: self.jvm.java.nio.file.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0))
                try:
                    self.jvm.java.nio.file.Files.createLink(local(own), local(beside))
                    return True
                except Exception as e:  # py4j wraps what Java throws
                    if "FileAlreadyExists" in str(e):
                        return False
                    raise
            return bool(self.fs.rename(beside, own))
        finally:
            self.fs.delete(beside, False)

    def commit(self, make: Callable[[Version], Version | None], tries: int = 20) -> int:
        """Turn the newest version into another, as often as others come first; None from ``make`` leaves it. Returns the version that holds."""
        for k in range(tries):
            now = self.version()
            new = make(Version(now.number, json.loads(json.dumps(now.tables)), dict(now.batches)))
            if new is None:
                return now.number
            new.number = now.number + 1
            if self._claim(new):
                return new.number
            time.sleep(random.random() * min(0.05 * 2**k, 2.0))
        raise Conflict(f"{tries} tries lost")

    def append(self, table: str, df: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """Add rows; with a writer and a batch number, once for each."""
        done = lambda v: writer is not None and batch is not None and v.batches.get(writer, -1) >= batch
        if done(now := self.version()):
            return now.number
        part, schema = self._write(table, df), json.loads(df.schema.json())

        def make(v: Version) -> Version | None:
            if done(v):
                return None
            known = v.tables.setdefault(table, {"schema": schema, "parts": []})
            if [f["name"] for f in known["schema"]["fields"]] != [f["name"] for f in schema["fields"]]:
                raise ValueError(f"columns of {table} differ")
            known["parts"].append(part)
            if writer is not None and batch is not None:
                v.batches[writer] = batch
            return v

        return self.commit(make)

    def replace(self, tables: dict[str, DataFrame]) -> int:
        """Set several tables at once, whatever they were."""
        new = {name: {"schema": json.loads(df.schema.json()), "parts": [self._write(name, df)]} for name, df in tables.items()}

        def make(v: Version) -> Version:
            v.tables.update(new)
            return v

        return self.commit(make)

    def update(self, table: str, change: Callable[[DataFrame], DataFrame | None]) -> int:
        """Replace a table by a function of itself, computed anew if the table has changed meanwhile; None leaves it."""
        held: dict = {}

        def make(v: Version) -> Version | None:
            before = v.tables.get(table, {}).get("parts")
            if held.get("before", self) != before:
                df = change(self._frame(v, table))
                if df is None:
                    return None
                held.update(before=before, new={"schema": json.loads(df.schema.json()), "parts": [self._write(table, df)]})
            v.tables[table] = held["new"]
            return v

        return self.commit(make)

    def compact(self, table: str, files: int = 1) -> int:
        """One part instead of many."""
        return self.update(table, lambda df: df.repartition(files))

    def vacuum(self, keep: int = 3, hours: float = 24.0) -> list[str]:
        """Drop versions but the newest ``keep``, parts that only they name, and unnamed parts older than ``hours`` (crashed writers')."""
        found = self.versions()
        old, kept = found[:-keep], found[-keep:]
        named = {p for n in kept for t in self.version(n).tables.values() for p in t["parts"]}
        gone = {p for n in old for t in self.version(n).tables.values() for p in t["parts"]} - named
        for n in old:
            self.fs.delete(self._path(f"log/{n:020d}.json"), False)
        limit = (time.time() - hours * 3600) * 1000
        for t in self.fs.listStatus(self._path("data")):
            for s in self.fs.listStatus(t.getPath()):
                part = f"data/{t.getPath().getName()}/{s.getPath().getName()}"
                if part not in named and s.getModificationTime() < limit:
                    gone.add(part)
        for part in gone:
            self.fs.delete(self._path(part), True)
        return sorted(gone)


# --- sessions --------------------------------------------------------------

SESSION = "session_id string, folder string, status string, phase string, at timestamp"
FINDING = "session_id string, source string, phase string, ordinal bigint, finding string"


class Sessions:
    """Review sessions and their findings in a table log.

    Saving a session or a finding appends; the newest row of a session is its state, a later
    one of equal times by its place. Static findings come in once a session, findings of a
    phase replace those of the same phase, a deleted session goes with all it had.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.log, self.spark = TableLog(spark, root), spark
        missing = {n: spark.createDataFrame([], s) for n, s in (("sessions", SESSION), ("findings", FINDING)) if n not in self.log.version().tables}

        def make(v: Version) -> Version | None:
            new = {n: {"schema": json.loads(df.schema.json()), "parts": []} for n, df in missing.items() if n not in v.tables}
            v.tables.update(new)
            return v if new else None

        self.log.commit(make)

    def save(self, rows: DataFrame) -> int:
        return self.log.append("sessions", rows.select(*[c.split()[0] for c in SESSION.split(", ")]))

    def states(self) -> DataFrame:
        """The newest row of each session."""
        rows = self.log.read("sessions")
        order = F.struct("at", "phase", "status", "folder")
        return rows.groupBy("session_id").agg(F.max_by(F.struct("folder", "status", "phase", "at"), order).alias("s")).select("session_id", "s.*")

    def find(self, name: str) -> DataFrame:
        """A session by its id, or else by its folder."""
        all_ = self.states()
        exact = all_.filter(F.col("session_id") == name)
        return exact if not exact.isEmpty() else all_.filter(F.col("folder") == name)

    def abandon_others(self, keep: str, at) -> int:
        """Every other active session becomes abandoned."""
        return self.save(self.states().filter((F.col("session_id") != keep) & (F.col("status") == "active")).withColumn("status", F.lit("abandoned")).withColumn("at", F.lit(at).cast("timestamp")))

    def append_findings(self, rows: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        return self.log.append("findings", rows.select(*[c.split()[0] for c in FINDING.split(", ")]), writer, batch)

    def static_findings_once(self, session: str, rows: DataFrame) -> bool:
        """Static findings of a session, unless it has some; whether they went in."""
        writer = f"static/{session}"
        before = self.log.version().batches.get(writer)
        self.append_findings(rows.withColumn("session_id", F.lit(session)).withColumn("source", F.lit("static")), writer, 0)
        return before is None

    def checkpoint(self, session: str, phase: str, rows: DataFrame) -> int:
        """Findings of a phase, instead of those it had."""
        own = (F.col("session_id") == session) & (F.col("source") == "checkpoint") & (F.col("phase") == phase)
        new = rows.withColumn("session_id", F.lit(session)).withColumn("source", F.lit("checkpoint")).withColumn("phase", F.lit(phase))
        return self.log.update("findings", lambda df: df.filter(~F.coalesce(own, F.lit(False))).unionByName(new.select(*df.columns)))

    def delete(self, session: str) -> bool:
        """Drop a session and its findings in one version each; whether there was one."""
        if self.states().filter(F.col("session_id") == session).isEmpty():
            return False
        for table in ("findings", "sessions"):
            self.log.update(table, lambda df: df.filter(F.col("session_id") != session))
        return True


def counted(sessions: Sessions) -> DataFrame:
    """Findings of each session by source."""
    return sessions.log.read("findings").groupBy("session_id", "source").agg(F.count("*").alias("n"))
