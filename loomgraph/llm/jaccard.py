"""N-gram Jaccard join: documents whose word-shingle sets overlap enough, in classes.

Rare-first prefix filtering: shingles are ordered by how many documents have them (as a
count table of fixed size tells, so that any corpus fits), and two linked sets must
share one of the first few in that order. Length and position prune within a shingle's
documents, a parity sketch of the sets bounds their difference (the suffix filter), and
what remains is verified exactly. Equal sets are one from the start.

Defined results: documents without words have no shingles and link with nothing; with
fewer words than a shingle takes, the whole sequence is the one shingle; rows with a
null id link with nothing and have no component; repeated rows are listed again, and
different texts under one id are judged apart; texts of any length are taken whole; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.counts import COUNTERS, count_parts, count_table, rare_first
from loomgraph.llm.linking import HEAVY, link, prefix_length
from loomgraph.llm.memory import released
from loomgraph.llm.shingles import mix, parity, shingle_set
from loomgraph.storage import cut, drop


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set of shingles, as signed integers."""
    a = np.bitwise_xor.reduce(mix(shingles)) if len(shingles) else np.uint64(0)
    b = np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D))) if len(shingles) else np.uint64(0)
    return int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))


def _scan(k: int):
    """One row for each document, then the parts of the task's count table."""
    schema = "doc_id bigint, digest bigint, size int, h1 bigint, h2 bigint, sketch binary, part int, salt int, counts binary"

    def run(frames):
        table = np.zeros(COUNTERS, np.uint32)
        for pdf in frames:
            rows = []
            for doc, digest, text in zip(pdf["doc_id"], pdf["digest"], pdf["text"]):
                s = shingle_set(text, k)
                table[s & np.uint64(COUNTERS - 1)] += 1  # a document counts once for a counter
                rows.append((doc, digest, len(s), *set_hash(s), parity(s) if len(s) else b""))
            out = pd.DataFrame(rows, columns=["doc_id", "digest", "size", "h1", "h2", "sketch"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(part=pd.array([None] * len(out), "Int32"), salt=pd.array([None] * len(out), "Int32"), counts=None)
        counts = count_parts(table)
        none, small = pd.array([None] * len(counts), "Int64"), pd.array([None] * len(counts), "Int32")
        yield counts.assign(doc_id=none, digest=none, size=small, h1=none, h2=none, sketch=None)[["doc_id", "digest", "size", "h1", "h2", "sketch", "part", "salt", "counts"]]

    return run, schema


def salts(shingles: np.ndarray, h1: int, table: np.ndarray, usual: int, heavy: int = HEAVY) -> np.ndarray:
    """0, or for shingles whose counter stands out from the ``usual`` one by more than ``heavy`` one of as many salts as give each about that many documents."""
    n = np.maximum(table[shingles & np.uint64(COUNTERS - 1)].astype(np.int64) - usual, 0) // heavy
    return np.where(n > 0, 1 + (h1 & 0x7FFFFFFFFFFFFFFF) % (n + 1), 0).astype(np.int32)


def _prefixes(k: int, num: int, den: int, shared):
    def run(frames):
        table, seen = shared.value, set()
        usual = int(np.median(table))
        for pdf in frames:
            keys, salt, items, sizes, at = [], [], [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, k)
                if not len(s):
                    continue
                h1, h2 = set_hash(s)
                if (h1, h2) in seen:  # equal sets need stand in the index once
                    continue
                if len(seen) < 100_000:
                    seen.add((h1, h2))
                p = prefix_length(len(s), num, den)
                rare = rare_first(s, table)[:p]
                keys.append(rare.view(np.int64))
                salt.append(salts(rare, h1, table, usual))
                items.append(np.full(p, h1, np.int64))
                sizes.append(np.full(p, len(s), np.int32))
                at.append(np.arange(p, dtype=np.int32))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "salt": np.concatenate(salt), "item": np.concatenate(items), "size": np.concatenate(sizes), "pos": np.concatenate(at)})

    return run


def _sets(k: int):
    def run(frames):
        for pdf in frames:
            sets = [shingle_set(t, k) for t in pdf["text"]]
            own = [set_hash(s) == h for s, h in zip(sets, zip(pdf["h1"], pdf["h2"]))]  # another text under the same id is another node
            yield pd.DataFrame({"node": pdf["node"], "shingles": [s.tobytes() for s in sets]})[own]

    return run


def text_digest(text: Column | str = "text") -> Column:
    """What tells rows of one id apart: a 64-bit hash of the text."""
    return F.xxhash64(text)


def document_classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, digest (of the text), class, n_shingles and component_id of each row; links have den * intersection >= num * union.

    class is null for rows without an id or without shingles; it tells classes apart even
    where an id stands on several texts, which component_id, a class's smallest doc_id,
    can't.
    """
    spark = docs.sparkSession
    src = docs.select("doc_id", "text", text_digest().alias("digest"))
    run, schema = _scan(k)
    scanned = cut(src.mapInPandas(released(run), schema), "scan")
    shared = spark.sparkContext.broadcast(count_table(scanned))
    info = scanned.filter(F.col("part").isNull()).select("doc_id", "digest", "size", "h1", "h2", "sketch")
    full = info.filter((F.col("size") > 0) & F.col("doc_id").isNotNull())
    reps = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    keys = src.filter(F.col("doc_id").isNotNull()).mapInPandas(released(_prefixes(k, num, den, shared)), "key bigint, salt int, item bigint, size int, pos int")

    def sets(needed: DataFrame) -> DataFrame:
        met = needed.join(reps.select("node", "doc_id", "h1", "h2"), "node").join(src, "doc_id")
        return met.select("node", "h1", "h2", "text").mapInPandas(released(_sets(k)), "node bigint, shingles binary")

    linked = link(keys, reps.select(F.col("h1").alias("item"), "node", "size", "sketch"), sets, num, den)
    classes = reps.select("h1", "h2", "node", "doc_id").join(linked.withColumnRenamed("vertex", "node"), "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = classes.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    classes = classes.join(least, "component", "left").select("h1", "h2", "class", F.coalesce("least", "doc_id").alias("component"))
    out = full.select("doc_id", "digest", "size", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "digest", "class", F.col("size").cast("bigint").alias("n_shingles"), F.col("component").alias("component_id"))
    rest = info.filter((F.col("size") == 0) | F.col("doc_id").isNull()).select("doc_id", "digest", F.lit(None).cast("bigint").alias("class"), F.col("size").cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of each document; links have den * intersection >= num * union."""
    return document_classes(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id; rows without an id or without words all stay.

    Rows are told apart by id and text, so different texts of one id are judged each for
    itself; rows that repeat both are one, whichever of them stays.
    """
    found = cut(document_classes(docs, k, num, den).filter("class IS NOT NULL").groupBy("class", "doc_id", "digest").agg(F.count("*").alias("n")), "classes")
    best = found.groupBy("class").agg(F.min(F.struct("doc_id", "digest")).alias("b"))
    judged = found.join(best, "class").select("doc_id", F.col("digest").alias("_digest"), "n", ((F.col("doc_id") == F.col("b.doc_id")) & (F.col("digest") == F.col("b.digest"))).alias("best"))
    rows, key = docs.withColumn("_digest", text_digest()), ["doc_id", "_digest"]
    stay = rows.join(judged.filter("NOT best OR n > 1"), key, "left_anti")
    once = rows.join(judged.filter("best AND n > 1"), key, "left_semi").dropDuplicates(key)
    return stay.unionByName(once).select(*docs.columns)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class by three-word shingles and a similarity of 0.9 or more."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=9, den=10)
