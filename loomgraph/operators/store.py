"""Rows of the code graph's tables: files, symbols, hierarchy, members, modules, chunks, manifest, jobs.

Inputs are DataFrames as the parsers give them; each function returns the rows to write.
What the tables call insert-or-ignore is ``distinct`` on the key here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.expressions import entry_kind, http_method, quoted
from loomgraph.operators.relational import import_edges, module_deps, pairs_of_first, upsert


def file_rows(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files (file_id, path, ...) with their module (file_id, module), ``root`` for those of none."""
    return files.drop("module").join(modules.select("file_id", "module"), "file_id", "left").withColumn("module", F.coalesce("module", F.lit("root")))


def _classes(symbols: DataFrame) -> DataFrame:
    """(file_id, class_name, class_id): the last class of a name in a file."""
    return symbols.filter("type = 'class'").groupBy("file_id", F.col("name").alias("class_name")).agg(F.max("symbol_id").alias("class_id"))


def hierarchy(symbols: DataFrame) -> DataFrame:
    """(class_id, parent_id) of classes (with ``bases``) and those of their bases that the same file defines."""
    bases = symbols.filter("type = 'class'").select(F.col("symbol_id").alias("child"), "file_id", F.explode("bases").alias("class_name"))
    met = bases.join(_classes(symbols), ["file_id", "class_name"]).filter("child <> class_id")
    return met.select(F.col("child").alias("class_id"), F.col("class_id").alias("parent_id")).distinct()


def members(symbols: DataFrame) -> DataFrame:
    """(class_id, member_id) of symbols whose parent class the same file defines."""
    own = symbols.filter("parent_class IS NOT NULL").select(F.col("symbol_id").alias("member_id"), "file_id", F.col("parent_class").alias("class_name"))
    return own.join(_classes(symbols), ["file_id", "class_name"]).select("class_id", "member_id").distinct()


def class_nodes(symbols: DataFrame, chosen: DataFrame) -> DataFrame:
    """(symbol_id, class_id) of the chosen symbols (symbol_id): the chosen class of the same file that is their parent, else null."""
    own = symbols.join(chosen.select("symbol_id"), "symbol_id", "left_semi")
    return own.select("symbol_id", "file_id", F.col("parent_class").alias("class_name")).join(_classes(own), ["file_id", "class_name"], "left").select("symbol_id", "class_id")


def metadata_rows(symbols: DataFrame) -> DataFrame:
    """Symbols (symbol_id, name, type, bases, decorators) with kind, http_method and http_path; those of no kind are left out."""
    text = F.array_join("decorators", " ")
    kind = entry_kind(F.col("decorators"), F.col("name"), F.col("type"), F.col("bases"))
    rows = symbols.withColumn("kind", kind).filter("kind IS NOT NULL")
    route = F.col("kind") == "route"
    return rows.select("symbol_id", "kind", F.when(route, http_method(text)).alias("http_method"), F.when(route, quoted(text)).alias("http_path"))


def module_rows(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Modules (module, files, depends_on) to (module, file_id) and (module, target)."""
    return modules.select("module", F.explode("files").alias("file_id")), modules.select("module", F.explode("depends_on").alias("target")).filter("module <> target").distinct()


def chunk_rows(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks (chunk_id, file_id, symbol_name) with the last symbol of that name in the file, or none; a repeated chunk_id is ignored."""
    last = symbols.groupBy("file_id", F.col("name").alias("symbol_name")).agg(F.max("symbol_id").alias("symbol_id"))
    first = chunks.groupBy("chunk_id").agg(F.min(F.struct("file_id", "symbol_name")).alias("c")).select("chunk_id", "c.*")
    return first.join(last, ["file_id", "symbol_name"], "left").select("chunk_id", "file_id", "symbol_name", "symbol_id")


def backfilled(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The chunks; where there are none, what the vectors' metadata says of them."""
    return vectors.select(*chunks.columns) if chunks.isEmpty() else chunks


def cleared(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """Empty tables of the same columns."""
    return tuple(t.limit(0) for t in tables)


def document_rows(old: DataFrame, new: DataFrame, most: int = 15_000) -> DataFrame:
    """Documents (doc_id, text) put in or replaced, their texts cut at ``most`` characters; the longest come first, as embedding takes them."""
    cut = new.select("doc_id", F.substring("text", 1, most).alias("text"))
    return upsert(old.select("doc_id", "text"), cut, ["doc_id"]).orderBy(F.char_length("text").desc(), "doc_id")


def manifest(files: DataFrame, chunks: DataFrame, version: int) -> DataFrame:
    """One row: version, numbers of files and chunks, and the languages in order."""
    a = files.agg(F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))
    return a.join(chunks.agg(F.count("*").alias("chunks"))).select(F.lit(version).alias("version"), "files", "chunks", "languages")


def with_graph(manifest_row: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The manifest with the graph's two counts put in or replaced."""
    row = manifest_row.drop("graph_nodes", "graph_edges")
    return row.join(nodes.agg(F.count("*").alias("graph_nodes"))).join(edges.agg(F.count("*").alias("graph_edges")))


def indexed_paths(chunks: DataFrame) -> DataFrame:
    return chunks.select("path").distinct()


def first_hashes(chunks: DataFrame) -> DataFrame:
    """(path, hash): the hash of each file's first chunk (path, ordinal, hash)."""
    return chunks.groupBy("path").agg(F.min(F.struct("ordinal", "hash")).alias("m")).select("path", F.col("m.hash").alias("hash"))


def symbols_of(symbols: DataFrame, file_id) -> DataFrame:
    """A file's symbols by start line."""
    return symbols.filter(F.col("file_id") == file_id).orderBy("start_line", "symbol_id")


def symbols_by_file(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, names) of the asked files (file_id): names joined by commas, by start line."""
    own = symbols.join(files.select("file_id"), "file_id", "left_semi")
    at = F.sort_array(F.collect_list(F.struct("start_line", "symbol_id", "name")))
    return own.groupBy("file_id").agg(F.array_join(F.transform(at, lambda x: x["name"]), ",").alias("names"))


def rows_by_id(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of the wanted ids; ids that there are none of are passed over."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def fan_in(files: DataFrame, symbols: DataFrame, calls: DataFrame, reached: DataFrame) -> DataFrame:
    """(file_id, fan_in): files reached (file_id, affected); where none is, the most callers of one of its symbols; else changed lines up to 50.

    ``files`` has file_id and changed, ``calls`` callee and caller.
    """
    each = calls.join(symbols.select(F.col("symbol_id").alias("callee"), "file_id"), "callee").groupBy("file_id", "callee").agg(F.count_distinct("caller").alias("n"))
    most = each.groupBy("file_id").agg(F.max("n").alias("n"))
    met = files.select("file_id", "changed").join(reached.select("file_id", "affected"), "file_id", "left").join(most, "file_id", "left")
    some = lambda c: F.nullif(F.col(c), F.lit(0))
    return met.select("file_id", F.coalesce(some("affected"), some("n"), F.least("changed", F.lit(50))).cast("bigint").alias("fan_in"))


def annotations(files: DataFrame, ranks: DataFrame, cycles: DataFrame) -> DataFrame:
    """Files (file_id, fan_in, added, removed) with page rank, betweenness, cycle membership and risk score.

    ``ranks`` has file_id, pagerank and betweenness; without a rank, fan_in / 500 up to 1
    stands for it.
    """
    met = files.join(ranks.select("file_id", "pagerank", "betweenness"), "file_id", "left").join(cycles.select("file_id", F.lit(True).alias("in_cycle")), "file_id", "left")
    met = met.withColumn("pagerank", F.coalesce("pagerank", F.least(F.col("fan_in") / 500, F.lit(1.0)))).withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    score = 2 * F.log1p(F.col("fan_in").cast("double")) + 3 * F.col("pagerank") + 1.5 * F.log1p((F.col("added") + F.col("removed")).cast("double"))
    return met.select("file_id", "fan_in", "pagerank", "betweenness", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"), score.alias("score"))


def risk_text(path: Column, affected: Column, callers: Column, pagerank: Column, cyclic: Column, bottleneck: Column) -> Column:
    """Why a file needs care, in words; empty where nothing does. ``callers`` and ``pagerank`` are null unless high."""
    parts = F.concat_ws(
        ", ", F.when(affected > 0, F.concat(affected.cast("string"), F.lit(" affected file(s)"))), F.concat(callers.cast("string"), F.lit(" direct callers")),
        F.concat(F.lit("PageRank "), F.format_number(pagerank, 2)), F.when(cyclic, "in circular dependency"), F.when(bottleneck, "architectural bottleneck"),
    )
    return F.when(parts == "", "").otherwise(F.concat(F.lit("⚠️ HIGH BLAST RADIUS ("), path, F.lit("): "), parts, F.lit(". Review with extra care.")))


def summary_text(kind: Column, method: Column, path: Column, event: Column, command: Column) -> Column:
    """What a symbol is for, from its metadata."""
    return (
        F.when(method.isNotNull() & path.isNotNull(), F.concat_ws(" ", method, path))
        .when(path.isNotNull(), F.concat(F.lit("route "), path))
        .when(command.isNotNull(), F.concat(F.lit("CLI: "), command))
        .when(event.isNotNull(), F.concat(F.lit("Event: "), event))
        .otherwise(F.coalesce(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit("")))
    )


def open_jobs(jobs: DataFrame) -> DataFrame:
    """One row: queued and running jobs, and repositories with a running one."""
    running = F.col("status") == "running"
    return jobs.agg(F.count(F.when(F.col("status").isin("queued", "running"), 1)).alias("open_jobs"), F.count_distinct(F.when(running, F.col("repo"))).alias("indexing"))


def queue_head(jobs: DataFrame) -> DataFrame:
    """The oldest queued job; ids break ties."""
    return jobs.filter("status = 'queued'").orderBy("queued_at", "job_id").limit(1)


def claim(jobs: DataFrame, now: Column) -> DataFrame:
    """The jobs with the oldest queued one running since ``now``: what one poll of a worker does."""
    head = queue_head(jobs).select("job_id", F.lit(True).alias("_head"))
    met = jobs.join(head, "job_id", "left")
    return met.withColumn("status", F.when(F.col("_head"), "running").otherwise(F.col("status"))).withColumn("started_at", F.when(F.col("_head"), now)).drop("_head")


# Weights of the typed edges.
WEIGHTS = {"exports": 0.9, "extends": 0.8, "member": 0.85, "related": 0.6, "module_file": 0.5, "imports": 1.0, "calls": 0.8, "module_dep": 0.7}


def typed_edges(files: DataFrame, symbols: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """(source, target, type, weight) of the knowledge graph between files, modules and symbols whose file is known.

    ``symbols`` has bases; ids are ``file:path``, ``module:name`` and ``type:name``.
    """
    file_id = files.select("file_id", F.concat(F.lit("file:"), "path").alias("node"))
    known = symbols.join(files.select("file_id"), "file_id", "left_semi")
    ids = known.select("symbol_id", "file_id", F.concat_ws(":", "type", "qualified_name").alias("node"))

    def between(pairs: DataFrame, kind: str, weight: str) -> DataFrame:
        a, b = ids.select(F.col("symbol_id").alias("a"), F.col("node").alias("source")), ids.select(F.col("symbol_id").alias("b"), F.col("node").alias("target"))
        return pairs.join(a, "a").join(b, "b").select("source", "target", F.lit(kind).alias("type"), F.lit(WEIGHTS[weight]).alias("weight"))

    def plain(df: DataFrame, source: Column, target: Column, kind: str, weight: str) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(WEIGHTS[weight]).alias("weight"))

    prefixed = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    first = pairs_of_first(known.select("file_id", F.struct("start_line", "symbol_id").alias("item")), "file_id", "item")
    parts = [
        plain(ids.join(file_id.withColumnRenamed("node", "file"), "file_id"), F.col("file"), F.col("node"), "exports", "exports"),
        between(hierarchy(known).select(F.col("class_id").alias("a"), F.col("parent_id").alias("b")), "extends", "extends"),
        between(members(known).select(F.col("class_id").alias("a"), F.col("member_id").alias("b")), "contains", "member"),
        between(first.select(F.col("a.symbol_id").alias("a"), F.col("b.symbol_id").alias("b")), "related", "related"),
        plain(files, prefixed("module", "module"), prefixed("file", "path"), "contains", "module_file"),
        plain(import_edges(edges, files), prefixed("file", "source_path"), prefixed("file", "target_path"), "imports", "imports"),
        between(calls.select(F.col("caller").alias("a"), F.col("callee").alias("b")).distinct(), "calls", "calls"),
        plain(module_deps(edges, files), prefixed("module", "source"), prefixed("module", "target"), "module_dep", "module_dep"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def layers(files: DataFrame) -> DataFrame:
    """(layer, nodes): each module's file nodes in order and, last, its own node."""
    own = files.groupBy("module").agg(F.sort_array(F.collect_list(F.concat(F.lit("file:"), "path"))).alias("f"))
    return own.select(F.concat(F.lit("layer:"), "module").alias("layer"), F.concat("f", F.array(F.concat(F.lit("module:"), "module"))).alias("nodes"))


def find_node(nodes: DataFrame, query: str) -> DataFrame:
    """The first node (ordinal, id, name, qualified_name, path) that has the text in its name, qualified name or path, case aside."""
    text = F.lower(F.concat_ws(" ", "name", "qualified_name", "path"))
    return nodes.filter(F.contains(text, F.lit(query.lower()))).orderBy("ordinal").limit(1)


def module_named(modules: DataFrame, files: DataFrame, asked: DataFrame, source_root: str = "") -> DataFrame:
    """(asked, module, as_feature): the module of that name, case aside; else the first with files in a folder of that name right below it."""
    known = modules.select("module", F.lower("module").alias("low"))
    want = asked.select("asked", F.lower("asked").alias("low"))
    exact = want.join(known, "low").groupBy("asked").agg(F.min("module").alias("module"))
    root = f"{source_root.lower()}/" if source_root else ""
    folder = files.select("module", F.lower(F.expr(f"substring(path, {len(root) + 1})")).alias("p"), F.lower("path").alias("whole")).filter(F.startswith("whole", F.lit(root)))
    parts = F.split("p", "/")
    folder = folder.filter((F.size(parts) > 2) & (parts[0] == F.lower("module"))).select("module", parts[1].alias("low")).distinct()
    rest = want.join(exact, "asked", "left_anti").join(folder, "low").groupBy("asked").agg(F.min("module").alias("module"))
    return exact.withColumn("as_feature", F.lit(False)).unionByName(rest.withColumn("as_feature", F.lit(True)))


def detected_modules(files: DataFrame, depth: int, most: int = 20) -> DataFrame:
    """(file_id, module) by the first ``depth`` folders of the path; by the first one where these give more than ``most`` modules; root for files in none."""
    parts = F.split("path", "/")
    at = lambda n: F.when(F.size(parts) <= 1, "root").otherwise(F.array_join(F.slice(parts, 1, F.least(F.lit(n), F.size(parts) - 1)), "/"))
    both = files.select("file_id", at(depth).alias("deep"), at(1).alias("flat"))
    n = both.agg(F.count_distinct("deep").alias("n"))  # one row
    return both.join(F.broadcast(n), F.lit(True)).select("file_id", F.when(F.col("n") > most, F.col("flat")).otherwise(F.col("deep")).alias("module"))


def layered_layout(levels: DataFrame) -> DataFrame:
    """(id, x, y) of vertices (id, level): levels 240 apart, each one's vertices 70 apart around zero."""
    w = W.partitionBy("level")
    i, n = F.row_number().over(w.orderBy("id")), F.count("*").over(w)
    return levels.select("id", (F.col("level") * 240).alias("x"), ((i - 1 - (n - 1) / 2) * 70).alias("y"))


def high_impact(rows: DataFrame, least: int = 10) -> DataFrame:
    """Annotations of files that many depend on, that stand in a cycle or that are bottlenecks."""
    return rows.filter((F.col("affected") >= least) | F.col("in_cycle") | F.col("bottleneck"))


def architecture_flags(rows: DataFrame) -> DataFrame:
    """One row (bottlenecks, cycles): paths of the files so flagged, each joined by commas in order."""
    named = lambda flag: F.array_join(F.sort_array(F.collect_set(F.when(F.col(flag), F.col("path")))), ",")
    return rows.agg(named("bottleneck").alias("bottlenecks"), named("in_cycle").alias("cycles"))


def related_findings(findings: DataFrame, changed: DataFrame, most: int = 50) -> DataFrame:
    """Earlier findings (id, path) in the changed files, the newest ``most``."""
    return findings.join(changed.select("path").distinct(), "path", "left_semi").orderBy(F.desc("id")).limit(most)


def tech_stack(paths: DataFrame, markers: dict[str, str]) -> DataFrame:
    """(repo, stack): what a repository's root files (repo, path) stand for, each once, in order, joined by commas."""
    table = F.create_map(*[F.lit(x) for kv in markers.items() for x in kv])
    found = paths.select("repo", F.try_element_at(table, F.col("path")).alias("tech")).filter("tech IS NOT NULL")
    return found.groupBy("repo").agg(F.array_join(F.sort_array(F.collect_set("tech")), ",").alias("stack"))


def context_header(path: Column, name: Column, kind: Column, start: Column, end: Column) -> Column:
    """The line above a chunk in a prompt: path, symbol and lines, as far as known."""
    known = F.coalesce(name, F.lit("")) != ""
    return F.concat(F.lit("--- "), path, F.when(known, F.concat(F.lit(" | "), kind, F.lit(": "), name)).otherwise(""), F.when(F.coalesce(start, F.lit(0)) != 0, F.concat(F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")"))).otherwise(""), F.lit(" ---"))


def staleness_status(repos: DataFrame) -> DataFrame:
    """(repo, index_stale, software_stale, build_stale, has_updates) of repos (repo, version, newest, behind, build)."""
    from loomgraph.operators.control import version_key

    newest = version_key(F.col("newest"))
    out = repos.select("repo", (F.col("behind") > 0).alias("index_stale"), (version_key(F.col("version")) < newest).alias("software_stale"), (version_key(F.col("build")) < version_key(F.col("version"))).alias("build_stale"))
    return out.withColumn("has_updates", F.col("index_stale") | F.col("software_stale") | F.col("build_stale"))


def next_batches(sessions: DataFrame, batches: DataFrame, done: DataFrame) -> DataFrame:
    """(session, batch, left): each session's first batch (session, batch) without findings yet (session, batch), and how many are left; null when none is."""
    open_ = batches.join(done.select("session", "batch").distinct(), ["session", "batch"], "left_anti").groupBy("session").agg(F.min("batch").alias("batch"), F.count("*").alias("left"))
    return sessions.select("session").join(open_, "session", "left").select("session", "batch", F.coalesce("left", F.lit(0)).alias("left"))
