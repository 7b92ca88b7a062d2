"""Prose documents to chunks: Markdown and RST sections, overlapping windows of plain text; code chunks by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.expressions import suffix_last
from loomgraph.operators.windows import char_windows, sections
from loomgraph.storage import cut

LEAST = 20


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(doc_path, text) of .md, .txt and .rst files under ``root``."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt,rst}").text(root)
    return read.select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text"))


def markdown(docs: DataFrame) -> DataFrame:
    """Sections (doc_id, section, title, n_chars) before # headings."""
    return sections(docs, r"^#{1,6}\s+\S", LEAST)


def rst(docs: DataFrame) -> DataFrame:
    """Sections of texts whose headings are underlined: a line over one of as many equal marks begins a section."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = W.partitionBy("doc_id").orderBy("i")
    below = F.lead("line").over(w)
    head = below.rlike(r"^([=\-~^\"'`#*+.:_])\1{2,}\s*$") & (F.length(F.trim("line")) > 0) & (F.length(F.rtrim(below)) >= F.length(F.rtrim("line"))) & ~F.col("line").rlike(r"^([=\-~^\"'`#*+.:_])\1{2,}\s*$")
    cut_up = lines.withColumn("head", head.cast("int")).withColumn("section", F.sum(F.coalesce("head", F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    whole = cut_up.groupBy("doc_id", "section").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("a"), F.max(F.when(F.col("head") == 1, F.trim("line"))).alias("title"))  # one document's lines
    body = F.array_join(F.transform("a", lambda x: x["line"]), "\n")
    return whole.select("doc_id", "section", F.coalesce("title", F.lit("")).alias("title"), F.char_length(F.trim(body)).alias("n_chars")).filter(F.col("n_chars") >= LEAST)


def plain(docs: DataFrame) -> DataFrame:
    """Windows of 5000 characters, 400 shared, labelled as the whole document or a part."""
    kept = docs.filter(F.char_length(F.trim("text")) >= LEAST)
    parts = char_windows(kept)
    n = F.count("*").over(W.partitionBy("doc_id"))
    return parts.withColumn("label", F.when(n == 1, "(full document)").otherwise(F.concat(F.lit("Part "), (F.col("chunk") + 1).cast("string"))))


def parse_all(docs: DataFrame) -> DataFrame:
    """docs (doc_id, doc_path, text) by extension: (doc_id, section, title)."""
    ext = F.lower(suffix_last(F.col("doc_path")))
    text = plain(docs.filter(~ext.isin(".md", ".rst")).select("doc_id", "text")).select("doc_id", F.col("chunk").alias("section"), F.col("label").alias("title"))
    return markdown(docs.filter(ext == ".md")).select("doc_id", "section", "title").unionByName(rst(docs.filter(ext == ".rst")).select("doc_id", "section", "title")).unionByName(text)


def code_chunks(files: DataFrame, symbols: DataFrame, most: int = 3000, overlap: int = 400) -> DataFrame:
    """(path, chunk_type, name, piece, text): each symbol as a parent, and its code in child pieces of up to ``most`` characters.

    Symbols are written once, so that three readers don't parse all files three times.
    """
    symbols = cut(symbols.select("path", "name", "code", "start_line", "end_line"), "symbols")
    parent = symbols.select("path", F.lit("parent").alias("chunk_type"), "name", F.lit(0).alias("piece"), F.col("code").alias("text"))
    n = F.char_length("code")
    starts = F.when(n <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(most - overlap)))
    child = symbols.select("path", "name", "code", F.posexplode(starts).alias("piece", "s")).select("path", F.lit("child").alias("chunk_type"), "name", "piece", F.substring("code", F.col("s") + 1, F.lit(most)).alias("text"))
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line")).withColumn("n", F.col("i") + 1)
    cover = symbols.select(F.col("path").alias("p"), "start_line", "end_line")
    left = lines.join(cover, (F.col("path") == F.col("p")) & F.col("n").between(F.col("start_line"), F.col("end_line")), "left_anti")
    left = left.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))  # one file's lines
    left = left.filter(F.length(F.trim("text")) > 0).select("path", F.lit("leftover").alias("chunk_type"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("piece"), "text")
    return parent.unionByName(child).unionByName(left)
