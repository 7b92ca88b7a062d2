"""File listings and the rules that keep or drop paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.expressions import basename, glob_regex, language_of, suffix_last

KEEP_DOT_DIRS = (".github",)


def scan_directory(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(file_path, language, size_bytes) of all files under ``root``; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rel = F.regexp_replace(F.col("path"), "^.*?" + _quote(root.rstrip("/")) + "/", "")
    return reader.load(root).select(rel.alias("file_path"), "length").select("file_path", language_of(F.col("file_path")).alias("language"), F.col("length").alias("size_bytes"))


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r"\.+^$(){}|[]*?" else c for c in text)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Ignore-file rules: ``name/`` drops a directory, a glob drops by path or name, a plain word drops by path segment."""
    out = F.lit(False)
    parts = F.split(path, "/")
    for p in patterns:
        if p.endswith("/"):
            out = out | F.array_contains(parts, p.rstrip("/"))
        else:
            out = out | path.rlike(glob_regex(p)) | basename(path).rlike(glob_regex(p))
            if "/" not in p:
                out = out | F.array_contains(parts, p)
    return out


def core_skip(path: Column, dirs: tuple[str, ...], extensions: tuple[str, ...], names: tuple[str, ...], suffixes: tuple[str, ...]) -> Column:
    """Whether a file is hidden, in a hidden or junk directory, or of a skipped extension, name or suffix."""
    parts = F.split(path, "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    out = F.exists(above, lambda x: F.startswith(x, F.lit(".")) & ~x.isin(*KEEP_DOT_DIRS)) | F.startswith(basename(path), F.lit("."))
    out = out | F.exists(parts, lambda x: x.isin(*dirs)) | suffix_last(path).isin(*extensions) | basename(path).isin(*names)
    for s in suffixes:
        out = out | F.endswith(path, F.lit(s))
    return out


def matches_rule(path: Column, rules: list[str]) -> Column:
    """A configured rule: a glob on the path, the path itself, a directory above it, or a file name."""
    out = F.lit(False)
    for r in rules:
        out = out | path.rlike(glob_regex(r)) | (path == r) | F.startswith(path, F.lit(r.rstrip("/") + "/")) | (basename(path) == r)
    return out


def indexed(path: Column, core: Column, include: list[str], exclude: list[str]) -> Column:
    """Include rules win over core skips, which win over exclude rules."""
    return F.when(matches_rule(path, include), True).when(core, False).otherwise(~matches_rule(path, exclude))
