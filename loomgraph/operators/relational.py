"""Joins, aggregates, set operations and top-k over the code graph's relations.

Relations are DataFrames: files (file_id, path, module, language), edges (src, dst),
calls (caller, callee, line), symbols, chunks. All joins are equi joins, so Spark picks
their strategy; none is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def import_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges as (source_path, target_path)."""
    s, t = files.select(F.col("file_id").alias("src"), F.col("path").alias("source_path")), files.select(F.col("file_id").alias("dst"), F.col("path").alias("target_path"))
    return edges.join(s, "src").join(t, "dst").select("source_path", "target_path")


def importers(edges: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """(file_id, importer path) of those that import the targets (file_id)."""
    return edges.join(targets.select(F.col("file_id").alias("dst")), "dst", "left_semi").join(files, F.col("src") == F.col("file_id")).select(F.col("dst").alias("file_id"), "path")


def imports_of(edges: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, imported path) of what the sources (file_id) import."""
    return edges.join(sources.select(F.col("file_id").alias("src")), "src", "left_semi").join(files, F.col("dst") == F.col("file_id")).select(F.col("src").alias("file_id"), "path")


def neighbours_outside(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct targets of the seeds (id) that are no seeds themselves."""
    out = edges.join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    return out.join(seeds.select(F.col("id").alias("dst")), "dst", "left_anti").select("dst").distinct()


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with both ends among ``nodes`` (id)."""
    both = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return both.select("src", "dst").distinct()


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits groups before it shuffles them."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n)


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (call_id, file_id, name) to symbols (symbol_id, file_id, name): one of the same file if any, else the first.

    Only the first symbol of each name, and of each name in each file, can be an answer, so
    a call meets two rows at most, however many symbols share its name.
    """
    any_file = symbols.filter("name IS NOT NULL").groupBy("name").agg(F.min("symbol_id").alias("any_id"))
    own_file = symbols.filter("name IS NOT NULL AND file_id IS NOT NULL").groupBy("name", "file_id").agg(F.min("symbol_id").alias("own_id"), F.lit(1).alias("own"))
    met = first_of(calls.join(any_file, "name").join(own_file, ["name", "file_id"], "left"), ["call_id"], F.coalesce("own", F.lit(0)).desc(), F.when(F.col("own") == 1, F.col("own_id")).otherwise(F.col("any_id")))
    return met.select("call_id", F.when(F.col("own") == 1, F.col("own_id")).otherwise(F.col("any_id")).alias("symbol_id"), F.coalesce("own", F.lit(0)).alias("same_file"))


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Spans inner (file_id, id, start, end) to the first outer span (ordinal) that holds them; equi join on the file first."""
    o = outer.select("file_id", F.col("id").alias("outer_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), "ordinal")
    met = inner.join(o, "file_id").filter((F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end")))
    return first_of(met, ["file_id", "id"], F.col("ordinal")).select("file_id", "id", "outer_id")


def uncovered_lines(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """lines (file_id, line) in no range (file_id, start, end): a range anti join behind an equality on the file."""
    r = ranges.select(F.col("file_id").alias("r_file"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return lines.join(r, (F.col("file_id") == F.col("r_file")) & F.col("line").between(F.col("r_start"), F.col("r_end")), "left_anti")


def suffix_candidates(paths: DataFrame) -> DataFrame:
    """(id, path) to (id, suffix, priority): the whole path first, then ever shorter ends of it."""
    parts = paths.withColumn("p", F.split("path", "/"))
    return parts.select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("priority", "suffix"))


def resolve_by_suffix(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Wanted (id, path) to the known (key, suffix) of the longest matching end; the smallest key of equals."""
    met = suffix_candidates(wanted).join(known, "suffix")
    return met.groupBy("id").agg(F.min(F.struct("priority", "key")).alias("m")).select("id", F.col("m.priority").alias("priority"), F.col("m.key").alias("key"))


def latest_per_group(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return first_of(df, [key], *order)


def pairs_of_first(df: DataFrame, key: str, item: str, n: int = 12) -> DataFrame:
    """(key, a, b) of the first ``n`` items of each key, a before b: no more than n * (n - 1) / 2 for a key."""
    top = top_per_group(df.select(key, item).distinct(), [key], n, F.col(item))
    a, b = top.select(key, F.col(item).alias("a"), F.col("rn").alias("i")), top.select(key, F.col(item).alias("b"), F.col("rn").alias("j"))
    return a.join(b, key).filter("i < j").select(key, "a", "b")


def best_per_parent(hits: DataFrame) -> DataFrame:
    """hits (parent, child, distance) to the nearest child of each parent, the smallest id of equals."""
    return hits.groupBy("parent").agg(F.min(F.struct("distance", "child")).alias("m")).select("parent", F.col("m.distance").alias("distance"), F.col("m.child").alias("child"))


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))


def module_languages(files: DataFrame) -> DataFrame:
    """(module, file_count, languages) with languages as name:count, in order of name."""
    each = files.groupBy("module", "language").agg(F.count("*").alias("n"))
    return each.groupBy("module").agg(F.sum("n").alias("file_count"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "language", "n"))), ",").alias("languages"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) of every vertex, in one aggregate."""
    both = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def module_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Each edge with both modules."""
    s, t = files.select(F.col("file_id").alias("src"), F.col("module").alias("source")), files.select(F.col("file_id").alias("dst"), F.col("module").alias("target"))
    return edges.join(s, "src").join(t, "dst")


def module_deps(edges: DataFrame, files: DataFrame) -> DataFrame:
    return module_edges(edges, files).filter("source <> target").select("source", "target").distinct()


def coupling(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(module, outgoing, incoming) counts of edges that cross modules."""
    cross = module_edges(edges, files).filter("source <> target")
    both = cross.select(F.col("source").alias("module"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(cross.select(F.col("target").alias("module"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("module").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def entry_modules(deps: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules that no other depends on."""
    return modules.join(deps.select(F.col("target").alias("module")), "module", "left_anti")


def core_modules(deps: DataFrame, n: int = 3) -> DataFrame:
    return deps.groupBy(F.col("target").alias("module")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(n)


def nearest_rank(df: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """sorted[min(int(n * p / 100), n - 1)] for each p, by rank over counts of distinct values.

    Counts are range-partitioned by value; the partitions' totals, a row each, say in which
    one a rank lies, and only within that one are running sums compared.
    """
    from loomgraph.storage import cut

    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    parts = cut(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("part").agg(F.sum("c").alias("c"))
    totals = totals.withColumn("below", F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("c"))
    n = parts.agg(F.sum("c").alias("n"))
    asked = n.select("n", F.explode(F.array(*[F.lit(p) for p in percents])).alias("p")).select("p", F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1).alias("k"))
    placed = asked.join(totals, (F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("c"))).select("p", "k", "part", "below")
    running = parts.withColumn("hi", F.sum("c").over(W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    return running.join(placed, "part").filter(F.col("hi") + F.col("below") > F.col("k")).groupBy("p").agg(F.min("v").alias("value"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order of columns; a partial aggregate, so a key with most rows costs no task more."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def hide_rejected(findings: DataFrame, rejected: DataFrame) -> DataFrame:
    return findings.join(rejected.select("id"), "id", "left_anti")


def first_source(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several ordered sources, the first source of each key kept."""
    ranked = [p.select(key).withColumn("source", F.lit(i)) for i, p in enumerate(parts)]
    out = ranked[0]
    for p in ranked[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.min("source").alias("source"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` over ``old``: rows of equal keys are replaced."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
