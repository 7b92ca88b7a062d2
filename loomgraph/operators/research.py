"""Research diagrams: what of the code graph belongs to a question's files, under caps, by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.operators.windows import position
from loomgraph.storage import cut

MOST_FILES, PER_FILE, MOST_NODES = 16, 8, 120


def places(files: DataFrame) -> DataFrame:
    """(file_id, place) of files (file_id, path): numbers in the order of their paths, the same for the same path."""
    rows = position(files.select("file_id", "path"), F.col("path"), F.col("file_id"))
    return cut(rows.select("file_id", F.min("position").over(W.partitionBy("path")).alias("place")), "places")


def chosen_files(seeds: DataFrame, placed: DataFrame, edges: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(q_id, file_id, place, seed): all seeds (q_id, file_id) that are files (file_id, place), then neighbours in either direction by place, up to ``most``."""
    own = cut(seeds.distinct().join(placed, "file_id").select("q_id", "file_id", "place"), "seeds")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both.join(own.select(F.col("file_id").alias("src")), "src", "left_semi").join(placed.select(F.col("file_id").alias("dst"), "place"), "dst")
    # of a file's neighbours the first ``most`` are enough: before one that stays, there are only seeds and others that stay
    first = F.dense_rank().over(W.partitionBy("src").orderBy("place", "dst"))
    near = near.withColumn("k", first).filter(F.col("k") <= most).select("src", "dst", "place").distinct()
    found = own.select("q_id", F.col("file_id").alias("src")).join(near, "src").select("q_id", F.col("dst").alias("file_id"), "place", F.lit(False).alias("seed"))
    met = own.withColumn("seed", F.lit(True)).unionByName(found).repartition("q_id").groupBy("q_id", "file_id").agg(F.min("place").alias("place"), F.max("seed").alias("seed"))
    met = met.withColumn("rn", F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("seed"), "place", "file_id")))
    return met.filter(F.col("seed") | (F.col("rn") <= most)).select("q_id", "file_id", "place", "seed")


def chosen_symbols(chosen: DataFrame, symbols: DataFrame, per_file: int = PER_FILE, most: int = MOST_NODES) -> DataFrame:
    """(q_id, symbol_id, file_id) of the chosen files' symbols (symbol_id, file_id, type, start): classes, then by start, so many a file; those of seeds first, up to ``most`` nodes with the files.

    A file's symbols go to its questions as one list of up to ``per_file``.
    """
    later = (F.col("type") != "class").cast("int")
    own = symbols.withColumn("k", F.row_number().over(W.partitionBy("file_id").orderBy(later, "start", "symbol_id"))).filter(F.col("k") <= per_file)
    lists = own.groupBy("file_id").agg(F.collect_list(F.struct(later.alias("later"), "start", "symbol_id")).alias("symbols"))
    met = chosen.join(lists, "file_id", "left").repartition("q_id")
    met = met.withColumn("room", F.lit(most) - F.count("*").over(W.partitionBy("q_id")))
    met = met.select("q_id", "file_id", "place", "seed", "room", F.explode("symbols").alias("s")).select("q_id", "file_id", "place", "seed", "room", "s.*")
    order = W.partitionBy("q_id").orderBy(F.desc("seed"), "later", "place", "start", "symbol_id")
    ranked = met.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).filter("rn <= room")
    return ranked.select("q_id", "symbol_id", "file_id")


def diagram(seeds: DataFrame, files: DataFrame, edges: DataFrame, symbols: DataFrame, calls: DataFrame, most_files: int = MOST_FILES, per_file: int = PER_FILE, most: int = MOST_NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes (q_id, kind, id, parent) and edges (q_id, kind, src, dst) of each question's diagram.

    Edges are imports between chosen files and ``calls`` (src, dst) between chosen symbols; both may repeat.
    """
    chosen = cut(chosen_files(seeds, places(files), edges, most_files), "chosen")
    inside = cut(chosen_symbols(chosen, symbols, per_file, most), "inside")
    text = lambda c: F.col(c).cast("string")
    nodes = chosen.select("q_id", F.when(F.col("seed"), "seed").otherwise("file").alias("kind"), text("file_id").alias("id"), F.lit(None).cast("string").alias("parent"))
    nodes = nodes.unionByName(inside.select("q_id", F.lit("symbol").alias("kind"), text("symbol_id").alias("id"), text("file_id").alias("parent")))

    def between(rows: DataFrame, ends: DataFrame, kind: str) -> DataFrame:
        src, dst = ends.select("q_id", F.col("id").alias("src")), ends.select("q_id", F.col("id").alias("dst"))
        # rows with an end that no question has go before questions come in
        rows = rows.select("src", "dst").join(dst.select("dst").distinct(), "dst", "left_semi").join(src.select("src").distinct(), "src", "left_semi").distinct()
        return rows.join(src, "src").join(dst, ["q_id", "dst"]).select("q_id", F.lit(kind).alias("kind"), text("src").alias("src"), text("dst").alias("dst"))

    links = between(edges, chosen.select("q_id", F.col("file_id").alias("id")), "import")
    return nodes, links.unionByName(between(calls, inside.select("q_id", F.col("symbol_id").alias("id")), "call"))
