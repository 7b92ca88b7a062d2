"""Review inputs: batches of changed files, and the snippets around them.

Files of a directory keep their order of arrival; a source file brings its test along;
batches close at a number of files and are then split by tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.expressions import basename, dirname
from loomgraph.operators.windows import number_runs

# What a test's path holds, and the extensions of code.
BATCH_TEST_MARKS = ("_test.", ".test.", ".spec.", "/test/", "/tests/", "/test_")
CODE_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".rb", ".php", ".c", ".cpp", ".h", ".hpp", ".cs", ".kt", ".swift", ".dart")
FILE_TOKENS, DIFF_TOKENS, FIXED_TOKENS, CHARS_PER_TOKEN = 40_000, 20_000, 50, 3


def is_batch_test(path: Column) -> Column:
    """Whether batching takes a path for a test."""
    low = F.lower(path)
    out = F.startswith(low, F.lit("test/")) | F.startswith(low, F.lit("tests/"))
    for m in BATCH_TEST_MARKS:
        out = out | F.contains(low, F.lit(m))
    return out


def is_snippet_test(path: Column) -> Column:
    """Whether a snippet's path is a test's."""
    low = F.lower(path)
    return F.contains(low, F.lit(".test.")) | F.contains(low, F.lit(".spec.")) | F.startswith(low, F.lit("test_")) | F.endswith(low, F.lit("_test.py"))


def is_code(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)).isin(*CODE_EXTENSIONS)


def is_noisy(name: Column) -> Column:
    """Private names, which diagrams leave out."""
    return F.startswith(name, F.lit("_"))


def stem(path: Column) -> Column:
    """A name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def prompt_tokens(added: Column, removed: Column, is_new: Column, diff_chars: Column) -> Column:
    """Estimated tokens of a file in a review's prompt: its text, and for files that aren't new its diff, each up to a cap."""
    text = F.least(F.lit(FILE_TOKENS), (added + removed + 200) * 5)
    diff = F.least(F.lit(DIFF_TOKENS), F.floor(diff_chars / CHARS_PER_TOKEN))
    return (text + F.when(is_new, 0).otherwise(diff) + FIXED_TOKENS).cast("bigint")


def test_pairs(files: DataFrame) -> DataFrame:
    """Files (ordinal, path) to (source, test): to each source, in order, the first test of its stem that no earlier source has.

    The n-th source of a stem gets the n-th test that fits it, so one row number on either
    side decides; a test fits one stem only.
    """
    own = files.select("ordinal", "path", stem(F.col("path")).alias("stem"), is_batch_test(F.col("path")).alias("test"))
    bare = F.regexp_replace("stem", r"^test_|(_test|\.test|_spec)$", "")
    nth = F.row_number().over(W.partitionBy("key").orderBy("ordinal"))
    sources = own.filter("NOT test").select("ordinal", F.col("path").alias("source"), F.col("stem").alias("key")).withColumn("n", nth)
    tests = own.filter("test").select("ordinal", F.col("path").alias("test_path"), bare.alias("key"), "stem").filter("key <> stem").withColumn("n", nth)
    return sources.join(tests.select("key", "n", "test_path"), ["key", "n"]).select("source", F.col("test_path").alias("test"))


def review_batches(files: DataFrame, most: int = 5) -> DataFrame:
    """(folder, batch, path) of files (ordinal, path): by folder, each source with its test, closed once ``most`` files are in; tests of no source under folder null.

    A source takes one or two places, so a batch closes at the first source with which it
    reaches ``most``: a window of as many rows tells how many one that opens there holds.
    """
    pairs = test_pairs(files)
    own = files.select("ordinal", "path", is_batch_test(F.col("path")).alias("is_test"))
    sources = own.filter("NOT is_test").join(pairs.withColumnRenamed("source", "path"), "path", "left").withColumn("folder", dirname(F.col("path")))
    sources = sources.withColumn("size", F.when(F.col("test").isNull(), 1).otherwise(2))
    loose = own.filter("is_test").join(pairs.select(F.col("test").alias("path")), "path", "left_anti").select("ordinal", "path", F.lit(None).cast("string").alias("test"), F.lit(None).cast("string").alias("folder"), F.lit(1).alias("size"))
    every = sources.select("ordinal", "path", "test", "folder", "size").unionByName(loose)
    w = W.partitionBy("folder").orderBy("ordinal", "path", "test")

    def step(acc: Column, x: Column) -> Column:
        takes = (acc["used"] < most).cast("int")
        return F.struct((acc["used"] + x * takes).alias("used"), (acc["n"] + takes).alias("n"))

    ahead = F.collect_list("size").over(w.rowsBetween(0, most - 1))
    rows = every.withColumn("k", F.row_number().over(w) - 1).withColumn("take", F.aggregate(ahead, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), step)["n"])
    flat = number_runs(rows.select("folder", "path", "test", "k", "take"), "folder", most)
    return flat.select("folder", "batch", F.explode(F.array_compact(F.array("path", "test"))).alias("path"))


def split_by_tokens(batches: DataFrame, budget: int, base: int = 0) -> DataFrame:
    """Batches (batch, ordinal, tokens) with part: a new part begins where a file would exceed the budget, which ``base`` tokens are taken from.

    One file is never split; a part holds at least one.
    """
    row = F.struct("ordinal", "tokens")
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("part"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc["used"] > 0) & (acc["used"] + x["tokens"] > budget - base)
        part = acc["part"] + over.cast("int")
        return F.struct((F.when(over, 0).otherwise(acc["used"]) + x["tokens"]).cast("bigint").alias("used"), part.alias("part"), F.concat(acc["out"], F.array(part)).alias("out"))

    lists = batches.groupBy("batch").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # a batch holds a few files
    return lists.withColumn("p", F.aggregate("rows", start, step)["out"]).select("batch", F.explode(F.arrays_zip("rows", "p")).alias("r")).select("batch", "r.rows.ordinal", F.col("r.p").cast("bigint").alias("part"))


def caller_snippets(calls: DataFrame, symbols: DataFrame, changed: DataFrame, deep: bool = False) -> DataFrame:
    """(file_id, caller_file, start, end) around the first calls of each changed file's symbols: 5 callers and lines -5 to +25, or 10 and -10 to +50 when ``deep``."""
    most, before, after = (10, 10, 50) if deep else (5, 5, 25)
    where = symbols.select("symbol_id", "file_id")
    own = calls.join(where.select(F.col("symbol_id").alias("callee"), "file_id"), "callee").join(changed.select("file_id"), "file_id", "left_semi")
    own = own.join(where.select(F.col("symbol_id").alias("caller"), F.col("file_id").alias("caller_file")), "caller")
    rank = F.row_number().over(W.partitionBy("callee").orderBy("line", "caller_file", "caller"))
    return own.withColumn("rn", rank).filter(F.col("rn") <= most).select("file_id", "caller_file", F.greatest(F.lit(1), F.col("line") - before).cast("bigint").alias("start"), (F.col("line") + after).cast("bigint").alias("end")).distinct()


def tests_near(files: DataFrame, changed: DataFrame, most: int = 5) -> DataFrame:
    """(path, test): the first ``most`` files named after each changed one (path), as ``stem.test.x`` or ``stem.spec.x``."""
    found = files.select(F.col("path").alias("test"), F.regexp_extract(basename(F.col("path")), r"^(.+?)\.(?:test|spec)\..*$", 1).alias("stem")).filter("stem <> ''")
    met = changed.select("path", stem(F.col("path")).alias("stem")).join(found, "stem")
    return met.withColumn("rn", F.row_number().over(W.partitionBy("path").orderBy("test"))).filter(F.col("rn") <= most).select("path", "test")


def interfaces(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = (".ts", ".tsx", ".js", ".jsx")) -> DataFrame:
    """(path, target) of relative imports (path, module): the first of module + extension and module/index + extension, in order of extensions, that there is."""
    folder = F.when(dirname(F.col("path")) == "", F.lit("")).otherwise(F.concat(dirname(F.col("path")), F.lit("/")))
    at = imports.filter("module LIKE './%'").select("path", "module", F.concat(folder, F.expr("substring(module, 3)")).alias("base"))
    tries = F.array(*[x for i, e in enumerate(extensions) for x in (F.struct(F.lit(2 * i).alias("k"), F.concat("base", F.lit(e)).alias("target")), F.struct(F.lit(2 * i + 1).alias("k"), F.concat("base", F.lit("/index" + e)).alias("target")))])
    met = at.select("path", "module", F.explode(tries).alias("t")).select("path", "module", "t.*").join(files.select(F.col("path").alias("target")), "target")
    return met.groupBy("path", "module").agg(F.min(F.struct("k", "target")).alias("m")).select("path", F.col("m.target").alias("target")).distinct()


def snippet_priority(path: Column, source: Column, changed: Column) -> Column:
    """0 for changed files, 1 for tests, 2 for callers, 3 for the rest."""
    return F.when(changed, 0).when((source == "test") | is_snippet_test(path), 1).when(source == "caller", 2).otherwise(3)


def neighbourhood(snippets: DataFrame, changed: DataFrame, most: int = 20, budget: int = 30_000) -> DataFrame:
    """Snippets (review, ordinal, path, source, content), the first of each path and source, by priority: ``most`` of them, up to the first that exceeds the token budget."""
    first = snippets.withColumn("_n", F.row_number().over(W.partitionBy("review", "path", "source").orderBy("ordinal"))).filter("_n = 1").drop("_n")
    known = changed.select("path", F.lit(True).alias("_changed")).distinct()
    own = first.join(known, "path", "left").withColumn("priority", snippet_priority(F.col("path"), F.col("source"), F.coalesce("_changed", F.lit(False))))
    order = W.partitionBy("review").orderBy("priority", "ordinal")
    top = own.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).withColumn("tokens", F.floor(F.char_length("content") / CHARS_PER_TOKEN))
    used = top.withColumn("used", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return used.filter(F.col("used") <= budget).select("review", "rn", "path", "source", "priority", "used")


def import_names(text: Column) -> Column:
    """Distinct modules of lines that begin with import or from and hold one ``from``; relative ones are passed over."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("import ")) | F.startswith(x, F.lit("from ")))
    parts = F.filter(F.transform(lines, lambda x: F.split(x, "from")), lambda p: F.size(p) == 2)
    names = F.transform(parts, lambda p: F.regexp_replace(F.trim(p[1]), "^[\"';]+|[\"';]+$", ""))
    return F.array_distinct(F.filter(names, lambda n: ~F.startswith(n, F.lit("."))))


def lines_of(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1, both included; never fewer than the first of them."""
    lo = F.greatest(F.lit(1), start)
    return F.array_join(F.slice(F.split(text, "\n"), lo.cast("int"), F.greatest(end - lo + 1, F.lit(1)).cast("int")), "\n")


def excerpt(lines: DataFrame, hunks: DataFrame, budget: int, contexts: tuple[int, ...] = (20, 10, 5, 2, 0)) -> DataFrame:
    """(file_id, context, n_lines): the widest context around a file's hunks (file_id, start, end) whose lines (file_id, line, content) stay in the token budget, else the narrowest.

    All contexts are tried at once: an equi join on the file and a range, then one aggregate.
    """
    wide = hunks.select("file_id", "start", "end", F.explode(F.array(*[F.lit(c) for c in contexts])).alias("context"))
    met = lines.join(wide, "file_id").filter(F.col("line").between(F.col("start") - F.col("context"), F.col("end") + F.col("context")))
    each = met.select("file_id", "context", "line", "content").distinct().groupBy("file_id", "context").agg(F.count("*").alias("n_lines"), F.sum(F.char_length("content") + 1).alias("chars"))
    fits = F.floor(F.col("chars") / CHARS_PER_TOKEN) <= budget
    best = each.groupBy("file_id").agg(F.max(F.when(fits, F.struct("context", "n_lines"))).alias("a"), F.min(F.struct("context", "n_lines")).alias("b"))
    return best.select("file_id", F.coalesce("a", "b").alias("m")).select("file_id", F.col("m.context").cast("bigint").alias("context"), "m.n_lines")
