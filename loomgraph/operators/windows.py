"""Window-like operators. Each declares a total order, so results don't depend on arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.storage import cut


def position(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with their place in a global order, numbered without one task sorting all.

    Rows are range-partitioned by the order and sorted in their partitions.
    """
    return numbered(df.repartitionByRange(*order).sortWithinPartitions(*order))


def numbered(df: DataFrame) -> DataFrame:
    """Rows with their place, of a DataFrame whose partitions are in order, one after the other and each in itself.

    Each partition is numbered as it is written and shifted by the sizes of those before it,
    so rows are not shuffled for it; sent to every task is a row for each partition.
    """
    rows = cut(df.withColumn("_n", F.monotonically_increasing_id()), "ranges")  # partition in the upper bits, row in the lower 33
    rows = rows.withColumn("_p", F.shiftright("_n", 33))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("c"))
    shift = sizes.select("_p", (F.sum("c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("c")).alias("shift"))
    place = F.col("_n").bitwiseAND((1 << 33) - 1) + 1 + F.col("shift")
    return rows.join(F.broadcast(shift), "_p").withColumn("position", place.cast("bigint")).drop("_p", "_n", "shift")


def trend(df: DataFrame, series: str, at: str, value: str) -> DataFrame:
    """Change to the previous non-null value of a series in time order."""
    w = W.partitionBy(series).orderBy(at)
    return df.filter(F.col(value).isNotNull()).withColumn("delta", F.col(value) - F.lag(value).over(w))


def budget_prefix(df: DataFrame, group: str, cost: str, budget: int, *order: Column) -> DataFrame:
    """Rows of each group up to the first that would overflow the budget."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(cost).over(w)).withColumn("_o", F.max((F.col("used") > budget).cast("int")).over(w)).filter("_o = 0").drop("_o")


def char_windows(docs: DataFrame, size: int = 5000, overlap: int = 400) -> DataFrame:
    """(doc_id, chunk, text) of overlapping windows; a text of up to ``size`` is one; blank pieces fall."""
    n = F.char_length("text")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)))
    cut_up = docs.select("doc_id", "text", F.posexplode(starts).alias("chunk", "start"))
    return cut_up.select("doc_id", "chunk", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text")).filter(F.length(F.trim("text")) > 0)


def merge_ranges(df: DataFrame, group: str) -> DataFrame:
    """(group, start, end) of ranges joined where they overlap or touch."""
    w = W.partitionBy(group).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = df.withColumn("new", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int"))
    numbered = flagged.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(group, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def sections(docs: DataFrame, heading: str, least: int = 20) -> DataFrame:
    """(doc_id, section, title, n_chars) of texts cut before lines that match ``heading``.

    Array functions cut each text where it stands. Sections under ``least`` characters
    fall, and their numbers stay unused.
    """
    marked = F.transform(F.split("text", "\n"), lambda line: F.when(line.rlike(heading), F.concat(F.lit("\u0000"), line)).otherwise(line))
    parts = F.split(F.array_join(marked, "\n"), "\u0000")
    cut_up = docs.select("doc_id", F.posexplode(parts).alias("section", "body"))
    title = F.when(F.col("section") > 0, F.regexp_extract("body", "^([^\n]*)", 1)).otherwise("")
    return cut_up.select("doc_id", "section", title.alias("title"), F.char_length(F.trim(F.regexp_replace("body", "\n+$", ""))).alias("n_chars")).filter(F.col("n_chars") >= least)


def newest_versions(df: DataFrame, group: str, version: str, keep: int = 3, active: str | None = None) -> DataFrame:
    """The newest ``keep`` versions of each group, and the active one."""
    ranked = df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(F.desc(version))))
    cond = F.col("_n") <= keep
    return ranked.filter(cond | F.col(active) if active else cond).drop("_n")


BLOCK = 512


def number_runs(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Rows (group, k, take, ...) with batch, from 0: ``k`` counts a group's rows from 0, ``take`` (1 to ``most``) is how many rows a batch that opens at one holds.

    Batches hang together as a chain through their group. Blocks of rows are gone through
    apart, from each of the ``most`` rows at which a block's first batch may open; what
    comes out, some numbers a block, is chained by group, and each block numbers its rows.
    """
    rest = [c for c in rows.columns if c not in (group, "k", "take")]
    block = F.floor(F.col("k") / max(BLOCK, most)).alias("block")
    lists = cut(rows.groupBy(group, block).agg(F.sort_array(F.collect_list(F.struct("k", "take", *rest))).alias("rows")), "blocks")

    def back(later: Column, x: Column) -> Column:
        """Before the outcomes (offset in the next block, batches) of later rows that of a batch that opens here."""
        met = F.get(later, x["take"] - 1)
        exit_ = F.coalesce(met["exit"], x["take"] - 1 - F.size(later)).cast("int").alias("exit")
        return F.slice(F.concat(F.array(F.struct(exit_, (F.coalesce(met["n"], F.lit(0)) + 1).cast("int").alias("n"))), later), 1, most)

    ways = lists.select(group, "block", F.aggregate(F.reverse("rows"), F.array().cast("array<struct<exit:int,n:int>>"), back).alias("ways"))
    chain = "struct<at:int,n:bigint,out:array<struct<block:bigint,entry:int,first:bigint>>>"

    def follow(s: Column, x: Column) -> Column:
        way = F.get(x["ways"], s["at"])
        out = F.concat(s["out"], F.array(F.struct(x["block"].alias("block"), s["at"].alias("entry"), s["n"].alias("first"))))
        return F.struct(F.coalesce(way["exit"], F.lit(0)).alias("at"), (s["n"] + F.coalesce(way["n"], F.lit(0))).alias("n"), out.alias("out")).cast(chain)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().alias("out")).cast(chain)
    placed = ways.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("block", "ways"))).alias("w")).select(F.col(group).alias("_g"), F.explode(F.aggregate("w", start, follow)["out"]).alias("p"))
    placed = placed.select("_g", F.col("p.block").alias("_b"), "p.entry", "p.first")

    state = "struct<at:int,n:bigint,out:array<bigint>>"

    def number(s: Column, x: Column) -> Column:
        opens = s["at"] == 0
        n = s["n"] + opens.cast("int")
        return F.struct((F.when(opens, x["take"]).otherwise(s["at"]) - 1).alias("at"), n.alias("n"), F.concat(s["out"], F.array(n)).alias("out")).cast(state)

    met = lists.join(placed, F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b")))
    open_ = F.struct(F.col("entry").alias("at"), (F.col("first") - 1).alias("n"), F.array().alias("out")).cast(state)
    flat = met.select(group, "rows", F.aggregate("rows", open_, number)["out"].alias("b")).select(group, F.explode(F.arrays_zip("rows", "b")).alias("x"))
    return flat.select(group, *[F.col(f"x.rows.{c}").alias(c) for c in rest], F.col("x.b").alias("batch"))


def pack_batches(items: DataFrame, group: str, cost: str, budget: int, most: int, *order: str) -> DataFrame:
    """(group, item, batch): items in order fill a batch until cost or number would overflow; an item over budget is alone.

    A batch holds at most ``most`` items, so a window of as many tells how many one that
    opens at an item would hold; ``number_runs`` finds which do.
    """
    own = items.select(group, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(cost).cast("bigint").alias("c"), F.col("item").cast("bigint").alias("item"))
    w = W.partitionBy(group).orderBy(*[f"_o{i}" for i in range(len(order))], "c", "item")
    state = "struct<used:bigint,n:int,open:boolean>"

    def step(s: Column, x: Column) -> Column:
        full = (s["n"] > 0) & (s["used"] + x["c"] > budget)
        takes = s["open"] & ~F.coalesce(full, F.lit(False))
        return F.struct((s["used"] + x["c"]).alias("used"), (s["n"] + takes.cast("int")).alias("n"), takes.alias("open")).cast(state)

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open")).cast(state)
    ahead = F.collect_list(F.struct("c")).over(w.rowsBetween(0, most - 1))
    rows = own.select(group, "item", (F.row_number().over(w) - 1).alias("k"), ahead.alias("ahead"))
    rows = rows.select(group, "item", "k", F.aggregate("ahead", start, step)["n"].alias("take"))
    return number_runs(rows, group, most).select(group, "item", (F.col("batch") + 1).cast("int").alias("batch"))


def diff_cap(lines: DataFrame, group: str, budget: int, *order: str) -> DataFrame:
    """Lines (line, n_chars, always) kept under a budget: some always, others only while they fit; later short ones still may."""
    state = "struct<used: bigint, out: array<bigint>>"
    ordered = lines.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*order, F.col("n_chars").cast("bigint").alias("c"), "always", F.col("line").cast("bigint").alias("i")))).alias("a"))

    def step(s: Column, x: Column) -> Column:
        keep = x["always"] | (s["used"] + x["c"] + 1 <= budget)
        return F.struct(F.when(keep, s["used"] + x["c"] + 1).otherwise(s["used"]).alias("used"), F.when(keep, F.concat(s["out"], F.array(x["i"]))).otherwise(s["out"]).alias("out"))

    start = F.from_json(F.lit('{"used":0,"out":[]}'), state)
    folded = ordered.select(group, F.aggregate("a", start.cast(state), lambda s, x: step(s, x).cast(state), lambda s: s["out"]).alias("o"))
    return folded.select(group, F.explode("o").alias("line"))
