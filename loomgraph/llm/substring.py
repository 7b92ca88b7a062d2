"""Substring dedup: repeated passages across documents, found by paragraph MinHash and anchored windows.

Paragraphs are lines of enough words, or runs of shorter ones. Each one's five-word shingles give a MinHash
signature whose bands bring similar paragraphs together; colliding ones are verified by
exact Jaccard similarity and clustered by connected components; the first paragraph of a
cluster stays. Passages inside longer lines surface as short paragraphs of their own:
windows of WINDOW words that begin at anchors, words whose hash is the smallest for
RADIUS words on both sides or in a run of places in a passage of SHARED words, so that
equal passages of that length have an equal window wherever they stand. A window's only band is its whole hash. Its first document keeps it.

Hashes are of words with A-Z lower-cased, so passages that differ in case alone are equal.

Defined results: null and empty texts have no paragraphs; rows with a null id are left
as they are; equal texts under different ids repeat each other, and rows that repeat an
id too are judged as one document; different texts of one id are cut each by its own spans
(rows are told apart by id and a hash of the text), but share passages freely; texts of any length are taken whole; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.jaccard import set_hash, text_digest
from loomgraph.llm.linking import link, salted
from loomgraph.llm.memory import released
from loomgraph.llm.shingles import mix, parity, run_hashes, shingle_hashes, word_hashes
from loomgraph.storage import cut, drop

WINDOW, RADIUS, MIN_WORDS = 24, 6, 20
#: words of a copied passage that has a window in common with its original for certain
SHARED = 51
SCHEMA = "doc_id bigint, start int, words int"


def tune_bands(threshold: float, recall: float = 0.99, rows: int = 2) -> int:
    """Fewest bands of ``rows`` values with which a pair of this similarity collides with at least this probability."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


def paragraphs(text: str | None, k: int = 5, least: int = MIN_WORDS) -> list[tuple[int, int, np.ndarray]]:
    """(first word, words, hashes of its k-word shingles) of each line with at least ``least`` words, of which there are k or more.

    Neighbouring shorter lines are joined: a paragraph of them ends, once it is long
    enough, before a line that its own words choose, so that equal lines after different
    ones soon fall into equal paragraphs; what is left at the end goes to the one before.
    """
    h, starts, _ = word_hashes(text, spans=True)
    if len(h) < least:
        return []
    raw, all_shingles = np.frombuffer((text or "").encode(), np.uint8), shingle_hashes(h, k)
    edge = [0, *np.searchsorted(starts, np.flatnonzero(raw == 10)).tolist(), len(h)]
    out: list[tuple[int, int]] = []
    run: list[tuple[int, int]] = []  # paragraphs of the short lines in hand

    def close() -> None:
        if len(run) > 1 and run[-1][1] - run[-1][0] < least:
            run[-2:] = [(run[-2][0], run[-1][1])]
        out.extend(x for x in run if x[1] - x[0] >= least)
        run.clear()

    for a, b in zip(edge, edge[1:]):
        if b - a >= least:
            close()
            out.append((a, b))
        elif b > a:
            long_enough = run and run[-1][1] - run[-1][0] >= least
            if not run or long_enough and (int(h[a] ^ h[b - 1]) & 1 or run[-1][1] - run[-1][0] >= 4 * least):
                run.append((a, b))
            else:
                run[-1] = (run[-1][0], b)
    close()
    return [(a, b - a, all_shingles[a : b - k + 1]) for a, b in out]


def anchors(h: np.ndarray, window: int = WINDOW, radius: int = RADIUS) -> np.ndarray:
    """Words, with a whole window behind them, whose mixed hash is least among ``radius`` on both sides, the first of equals, or in a run of SHARED - window + 1."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    # the hash of two words, so that a common word is no anchor wherever it stands
    own = np.concatenate([mix(h[:-1] * np.uint64(3) + h[1:]), mix(h[-1:])])
    before, after = np.full(n, top), np.full(n, top)
    for d in range(1, radius + 1):
        np.minimum(before[d:], own[:-d], out=before[d:])
        np.minimum(after[:-d], own[d:], out=after[:-d])
    local = np.flatnonzero((own < before) & (own <= after))
    # winnowing: the least of every run of places, the last of equals, so that passages of SHARED words have one in common
    last = n - window
    runs = np.lib.stride_tricks.sliding_window_view(own[: last + 1][::-1], min(SHARED - window + 1, last + 1))
    least = last - (np.arange(len(runs)) + runs.argmin(axis=1))
    return np.union1d(local[local <= last], least)


def _windows(window: int, radius: int):
    def run(frames):
        for pdf in frames:
            docs, digests, starts, one, two = [], [], [], [], []
            for doc, digest, text in zip(pdf["doc_id"], pdf["digest"], pdf["text"]):
                h = word_hashes(text)
                at = anchors(h, window, radius)
                if len(at):
                    docs.append(np.full(len(at), doc, np.int64))
                    digests.append(np.full(len(at), digest, np.int64))
                    starts.append(at.astype(np.int32))
                    one.append(run_hashes(h, at, window))
                    two.append(run_hashes(mix(h ^ np.uint64(0x2545F4914F6CDD1D)), at, window))
            if docs:
                yield pd.DataFrame({"h1": np.concatenate(one).view(np.int64), "h2": np.concatenate(two).view(np.int64), "doc_id": np.concatenate(docs), "digest": np.concatenate(digests), "start": np.concatenate(starts)})

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, radius: int = RADIUS) -> DataFrame:
    """(doc_id, start, words, class_doc, kept) of windows that stand in two documents or more."""
    rows = cut(docs.mapInPandas(released(_windows(window, radius)), "h1 bigint, h2 bigint, doc_id bigint, digest bigint, start int"), "all-windows")
    twice = rows.groupBy("h1").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h1")
    found = cut(rows.join(twice, "h1"), "windows")
    drop(rows)
    owner = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_doc"), F.max("doc_id").alias("hi")).filter("class_doc < hi").drop("hi")
    return found.join(owner, ["h1", "h2"]).select("doc_id", "digest", "start", F.lit(window).alias("words"), "class_doc", (F.col("doc_id") == F.col("class_doc")).alias("kept"))


def _signatures(shingles: np.ndarray, starts: np.ndarray, bands: int, rows: int, salt: np.ndarray) -> np.ndarray:
    """Band keys of each run of ``shingles`` that begins at ``starts``: mixed least values of salted hashes."""
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(starts), axis=0)
    for b in range(bands):
        for r in range(rows):
            low = np.minimum.reduceat(mix(shingles ^ salt[b * rows + r]), starts)
            key[:, b] = mix(key[:, b] * np.uint64(0xFF51AFD7ED558CCD) + low)
    return key


def _info(k: int, least: int, bands: int, rows: int, seed: int = 11, at_once: int = 400_000):
    """Rows of INFO for every paragraph; some ``at_once`` words are worked on together."""

    def made(held: list) -> pd.DataFrame:
        docs, digests, starts, words, parts = zip(*held)
        n = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), n)
        flat = np.concatenate(parts)
        order = np.lexsort((flat, owner))
        flat, owner = flat[order], owner[order]
        own = np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])])
        flat, owner = flat[own], owner[own]
        at = np.searchsorted(owner, np.arange(len(parts)))
        size = np.diff(np.concatenate([at, [len(flat)]]))
        h1 = np.bitwise_xor.reduceat(mix(flat), at).view(np.int64)
        h2 = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at).view(np.int64)
        bit = owner * 256 + ((flat >> np.uint64(7)) % np.uint64(256)).astype(np.int64)
        odd = (np.bincount(bit, minlength=256 * len(parts)) & 1).astype(np.uint8).reshape(-1, 256)
        sketch = [x.tobytes() for x in np.packbits(odd, axis=1, bitorder="little")]
        for i in np.flatnonzero(size > 256):
            sketch[i] = parity(flat[at[i] : at[i] + size[i]])
        salt = np.random.default_rng(seed).integers(1, 1 << 63, bands * rows, dtype=np.uint64)
        keys = _signatures(flat, at, bands, rows, salt).view(np.int64)
        return pd.DataFrame({"doc_id": docs, "digest": digests, "start": starts, "words": words, "size": size, "h1": h1, "h2": h2, "sketch": sketch, "bands": list(keys)})

    def run(frames):
        held, count = [], 0
        for pdf in frames:
            for doc, digest, text in zip(pdf["doc_id"], pdf["digest"], pdf["text"]):
                for start, words, shingles in paragraphs(text, k, least):
                    held.append((doc, digest, start, words, shingles))
                    count += words
                if count >= at_once:
                    yield made(held)
                    held, count = [], 0
        if held:
            yield made(held)

    return run


def _sets(k: int, least: int):
    def run(frames):
        for pdf in frames:
            out = []
            for text, needed in zip(pdf["text"], pdf["needed"]):
                own = {start: s for start, _, s in paragraphs(text, k, least)}
                for x in needed:
                    s = np.unique(own[x["start"]]) if x["start"] in own else None
                    if s is not None and set_hash(s) == (x["h1"], x["h2"]):
                        out.append((x["node"], s.tobytes()))
            yield pd.DataFrame(out, columns=["node", "shingles"])

    return run


def repeated_paragraphs(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, least: int = MIN_WORDS, recall: float = 0.99, rows: int = 2) -> DataFrame:
    """(doc_id, start, words, class_doc, kept) of paragraphs in clusters of two or more."""
    kind = "doc_id bigint, digest bigint, start int, words int, size int, h1 bigint, h2 bigint, sketch binary, bands array<bigint>"
    bands = tune_bands(num / den, recall, rows)
    info = cut(docs.mapInPandas(released(_info(k, least, bands, rows)), kind).withColumn("pid", F.monotonically_increasing_id()), "paragraphs")
    first = F.min(F.struct("doc_id", "digest", "start", "pid"))
    reps = info.groupBy("h1", "h2").agg(first.alias("f"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    reps = cut(reps.select("h1", "h2", "n", "size", "sketch", "bands", F.col("f.pid").alias("node"), F.col("f.doc_id").alias("doc_id"), F.col("f.digest").alias("digest"), F.col("f.start").alias("start")), "reps")
    keys = salted(reps.select(F.explode("bands").alias("key"), F.col("h1").alias("item"), "size", F.lit(0).alias("pos")))

    def sets(needed: DataFrame) -> DataFrame:
        at = needed.join(reps.select("node", "doc_id", "start", "h1", "h2"), "node")
        at = at.groupBy("doc_id").agg(F.collect_list(F.struct("node", "start", "h1", "h2")).alias("needed"))  # a document's own lines
        return docs.join(at, "doc_id").select("text", "needed").mapInPandas(released(_sets(k, least)), "node bigint, shingles binary")

    linked = link(keys, reps.select(F.col("h1").alias("item"), "node", "size", "sketch"), sets, num, den)
    classes = reps.join(linked.withColumnRenamed("vertex", "node"), "node", "left").withColumn("class", F.coalesce("component", "node"))
    owner = classes.groupBy("class").agg(F.min(F.struct("doc_id", "digest", "start")).alias("o"), F.sum("n").alias("all")).filter("`all` > 1")
    known = classes.select("h1", "h2", "class").join(owner, "class").select("h1", "h2", "o")
    own = (F.col("doc_id") == F.col("o.doc_id")) & (F.col("digest") == F.col("o.digest")) & (F.col("start") == F.col("o.start"))
    return info.select("doc_id", "digest", "start", "words", "h1", "h2").join(known, ["h1", "h2"]).select("doc_id", "digest", "start", "words", F.col("o.doc_id").alias("class_doc"), own.alias("kept"))


def repeats(docs: DataFrame) -> DataFrame:
    """Paragraphs and windows that repeat: (doc_id, digest of the text, start, words, class_doc, kept), words counted from 0."""
    src = docs.select("doc_id", "text", text_digest().alias("digest")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return repeated_paragraphs(src).unionByName(repeated_windows(src))


def merged(spans: DataFrame) -> DataFrame:
    """Spans of a document that overlap or touch and are alike kept or not, joined: (doc_id, digest, start, words, class_doc, kept)."""
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id", "digest", "kept").orderBy("start", F.desc("words"))
    reach = F.max(F.col("start") + F.col("words")).over(order.rowsBetween(W.unboundedPreceding, -1))
    at = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    at = at.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = at.groupBy("doc_id", "digest", "kept", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("words")).alias("end"), F.min("class_doc").alias("class_doc"))
    return joined.select("doc_id", "digest", "start", (F.col("end") - F.col("start")).alias("words"), "class_doc", "kept")


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of the spans that aren't kept, the blanks before each going too; documents left without words go."""
    names, schema = docs.columns, docs.schema
    cuts = spans.filter("NOT kept").groupBy("doc_id", F.col("digest").alias("_digest")).agg(F.collect_list(F.struct("start", "words")).alias("_cuts"))  # a document's own spans

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for text, spans in zip(texts, batch.column("_cuts").to_pylist()):
                out.append(without(text, [(s["start"], s["words"]) for s in spans]) if spans and text else text)
            new = {"text": pa.array(out, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(out, batch.column("n_chars").to_pylist())], pa.int64())
            rows = pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)
            gone = [bool(c) and not (t or "").strip() for c, t in zip(batch.column("_cuts").to_pylist(), out)]
            yield rows.filter(pa.array([not g for g in gone]))

    return docs.withColumn("_digest", text_digest()).join(cuts, ["doc_id", "_digest"], "left").select(*names, "_cuts").mapInArrow(released(run), schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (first word, words) and the blanks before each span."""
    _, starts, ends = word_hashes(text, spans=True)
    raw, parts, at, done = text.encode(), [], 0, 0
    for a, n in sorted(spans):
        a, b = max(a, done), min(a + n, len(ends))
        if b > a:
            parts.append(raw[at : ends[a - 1] if a else 0])
            at, done = int(ends[b - 1]), b
    return b"".join([*parts, raw[at:]]).decode()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's repeated spans: where they stand, which document holds the first, and whether this one stays."""
    return merged(repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("digest")
