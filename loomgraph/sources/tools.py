"""Analyzer outputs, one parser for each tool, all to one schema; and JSON sources of runs, sessions and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = ["tool", "file_path", "line_number", "code", "severity", "category", "message"]


def _row(tool, path, line, code, severity, category, message):
    return [F.lit(tool).alias("tool"), path.alias("file_path"), line.cast("int").alias("line_number"), code.alias("code"), severity.alias("severity"), category.alias("category"), message.alias("message")]


def ruff(raw: DataFrame) -> DataFrame:
    """A JSON array in each row's text."""
    x = raw.select(F.explode(F.from_json("text", "array<struct<code: string, filename: string, message: string, location: struct<row: int>>>")).alias("x"))
    code = F.col("x.code")
    security = F.startswith(code, F.lit("S"))
    return x.select(*_row("ruff", F.col("x.filename"), F.col("x.location.row"), code, F.when(security | F.startswith(code, F.lit("F")), "error").otherwise("suggestion"), F.when(security, "security").when(F.startswith(code, F.lit("F")), "bug").otherwise("style"), F.col("x.message")))


def mypy(raw: DataFrame) -> DataFrame:
    """Lines path:line: level: message [code]."""
    p = r"^([^:]+):(\d+):(?:\d+:)? (error|warning|note): (.*?)(?:\s+\[([\w-]+)\])?$"
    x = raw.select(F.explode(F.split("text", "\n")).alias("l")).filter(F.col("l").rlike(p))
    g = lambda k: F.regexp_extract("l", p, k)
    return x.filter(g(3) != "note").select(*_row("mypy", g(1), g(2), F.nullif(g(5), F.lit("")), F.when(g(3) == "error", "error").otherwise("suggestion"), F.lit("type"), g(4)))


def bandit(raw: DataFrame) -> DataFrame:
    x = raw.select(F.explode(F.from_json("text", "results array<struct<filename: string, line_number: int, test_id: string, issue_severity: string, issue_text: string>>")["results"]).alias("x"))
    s = F.upper("x.issue_severity")
    return x.select(*_row("bandit", F.col("x.filename"), F.col("x.line_number"), F.col("x.test_id"), F.when(s == "HIGH", "blocker").when(s == "MEDIUM", "error").otherwise("suggestion"), F.lit("security"), F.col("x.issue_text")))


def eslint(raw: DataFrame) -> DataFrame:
    x = raw.select(F.explode(F.from_json("text", "array<struct<filePath: string, messages: array<struct<ruleId: string, severity: int, message: string, line: int>>>>")).alias("f"))
    x = x.select(F.col("f.filePath").alias("path"), F.explode("f.messages").alias("m"))
    return x.select(*_row("eslint", F.col("path"), F.col("m.line"), F.col("m.ruleId"), F.when(F.col("m.severity") == 2, "error").otherwise("suggestion"), F.lit("style"), F.col("m.message")))


def cargo(raw: DataFrame) -> DataFrame:
    """JSON lines; those that aren't compiler messages fall."""
    kind = "reason string, message struct<level: string, message: string, code: struct<code: string>, spans: array<struct<file_name: string, line_start: int, is_primary: boolean>>>"
    x = raw.select(F.explode(F.split("text", "\n")).alias("l")).select(F.from_json("l", kind).alias("x")).filter("x.reason = 'compiler-message'")
    x = x.select("x.message", F.get(F.filter("x.message.spans", lambda s: s["is_primary"]), F.lit(0)).alias("s"))
    return x.select(*_row("cargo", F.col("s.file_name"), F.col("s.line_start"), F.col("message.code.code"), F.when(F.col("message.level") == "error", "error").otherwise("suggestion"), F.lit("bug"), F.col("message.message")))


def generic(raw: DataFrame, tool: str = "other") -> DataFrame:
    x = raw.select(F.explode(F.split("text", "\n")).alias("l")).filter("trim(l) <> ''")
    return x.select(*_row(tool, F.lit(None).cast("string"), F.lit(None), F.lit(None).cast("string"), F.lit("suggestion"), F.lit("style"), F.col("l")))


PARSERS = {"ruff": ruff, "mypy": mypy, "bandit": bandit, "eslint": eslint, "cargo": cargo}


def findings(raw: DataFrame) -> DataFrame:
    """raw (tool, text) of all tools, each by its parser; unknown tools line by line."""
    out = generic(raw.filter(~F.col("tool").isin(*PARSERS)))
    for name, parser in PARSERS.items():
        out = out.unionByName(parser(raw.filter(F.col("tool") == name)))
    return out.select(*OUT)


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a folder, each with the name of its file."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("source_file", F.col("_metadata.file_name"))


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of an exported graph."""
    kind = "nodes array<struct<id: string, type: string, name: string>>, edges array<struct<source: string, target: string, type: string, weight: double>>"
    doc = spark.read.schema(kind).option("multiLine", True).json(path)
    return doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode("edges").alias("e")).select("e.*")
