"""Language-model scores by stupid backoff, with counts from all documents.

A word's score is count(context, word) / count(context) for the longest context that was
seen with it, times BACKOFF for each word of context given up; at last count(word) / N.
A document's own n-grams are taken off the counts first, or each would vouch for itself.

The relational plan is that of ORACLE: exploded n-grams joined to count tables, summed per
document. Its rows are packed: each input partition packs its documents into batches
(texts compressed, written once, so that a batch is the same whenever it is read), and a
batch sends its distinct n-grams, one list for each range of hashes, with their counts
there. A range's task adds them up, which is the count table's partition, and answers
each list with its totals; batches then sum per document. Nothing grows with a frequent
n-gram: it is one entry of each batch. Lists are sorted, so they travel as steps from one
hash to the next, which takes six bytes rather than eight. Empty lists are not sent:
however many batches and ranges there are, rows are never more than the exploded plan's,
which would move three to four times as much.

Defined results: null and empty texts have no words and score 0; a word that no other
document has counts as seen once; rows of equal id are scored apart; texts of any length
are taken whole, one longer than a batch as a batch of its own; other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.memory import released
from loomgraph.llm.shingles import mix, word_hashes
from loomgraph.storage import cut

BACKOFF, ORDER = 0.4, 2
#: words of the longest n-grams that the query counts
QUERY_ORDER = 3
#: bytes of text in a batch, documents of a batch at most, and documents of the corpus for each range of hashes
BATCH_BYTES, BATCH_DOCS, BUCKET_DOCS = 8 << 20, 8192, 2048

PACKED = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())), ("ends", pa.list_(pa.int64())), ("texts", pa.binary())])


def ngrams(words: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each word, for n from 1 to ``order``; those that begin before the text are left out."""
    out = [mix(words ^ np.uint64(0xA0761D6478BD642F))]
    for n in range(2, order + 1):
        out.append(mix(out[-1][:-1] * np.uint64(0xE7037ED1A0B428DB) + words[n - 1 :]))
    return out


def _pack(batch_bytes: int, batch_docs: int):
    """Batches of a partition's documents: numbers, ids, where each text ends, and all texts compressed."""

    def run(parts):
        first, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def batch():
            row = [first], [[i or 0 for i in ids]], [[i is not None for i in ids]], [np.cumsum([len(t) for t in texts])], [zstandard.compress(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, PACKED)], schema=PACKED)

        for part in parts:
            for i, text in zip(part["doc_id"].to_pylist(), part["text"]):
                t = text.as_py().encode()
                if ids and (size + len(t) > batch_bytes or len(ids) == batch_docs):
                    yield batch()
                    first, ids, texts, size = first + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield batch()

    return run


def _texts(ends, packed: bytes) -> list[str]:
    raw, at, out = zstandard.decompress(packed), 0, []
    for end in ends:
        out.append(raw[at:end].decode())
        at = end
    return out


def _bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges begins and ends in sorted hashes."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def encode(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 as their bytes by place, the lowest first; only the highest place in use is compressible, unless there is but one or two."""
    planes = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8)
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    low = np.ascontiguousarray(planes[:, : width - 1].T).tobytes()
    return bytes([width]) + len(numbers).to_bytes(8, "little") + (zstandard.compress(low, 1) if width < 4 else low) + zstandard.compress(planes[:, width - 1].tobytes(), 1)


def decode(code: bytes) -> np.ndarray:
    """What ``encode`` was given."""
    width, n = code[0], int.from_bytes(code[1:9], "little")
    planes, at = np.zeros((n, 8), np.uint8), 9
    if width < 4:
        reader = zstandard.ZstdDecompressor().decompressobj()
        low = reader.decompress(code[at:])
        at = len(code) - len(reader.unused_data)
    else:
        low = code[at : at + n * (width - 1)]
        at += len(low)
    planes[:, : width - 1] = np.frombuffer(low, np.uint8).reshape(width - 1, n).T
    planes[:, width - 1] = np.frombuffer(zstandard.decompress(code[at:]), np.uint8)
    return planes.view("<u8").ravel().astype(np.uint64)


def _distinct(texts, order: int) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    grams = [ngrams(word_hashes(t), order) for t in texts]
    flat = [g for doc in grams for g in doc]
    return *np.unique(np.concatenate(flat) if flat else np.zeros(0, np.uint64), return_counts=True), grams


def _ask(order: int, buckets: int):
    def run(parts):
        for pdf in parts:
            for batch, ends, texts in zip(pdf["batch"], pdf["ends"], pdf["texts"]):
                distinct, counts, grams = _distinct(_texts(ends, texts), order)
                at, tokens, rows = _bounds(distinct, buckets), sum(len(doc[0]) for doc in grams), []
                for b in np.flatnonzero(np.diff(at)):
                    part = slice(at[b], at[b + 1])
                    rows.append((b, batch, encode(np.diff(distinct[part], prepend=np.uint64(0))), encode(counts[part]), 0 if rows else tokens))
                yield pd.DataFrame(rows, columns=["bucket", "batch", "hashes", "counts", "tokens"])

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    hashes = [np.cumsum(decode(h), dtype=np.uint64) for h in pdf["hashes"]]
    ends = np.cumsum([len(h) for h in hashes])
    table, at = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.zeros(len(table), np.uint64)
    for place, counts in zip(np.split(at, ends[:-1]), pdf["counts"]):
        totals[place] += decode(counts)  # a list's hashes are distinct
    return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "totals": [encode(totals[x]) for x in np.split(at, ends[:-1])], "tokens": pdf["tokens"]})


def score_words(grams: list[np.ndarray], seen, n: int, backoff: float) -> float:
    """Sum of the log scores of a document's words; ``seen`` gives counts in the other documents, ``n`` their words."""
    words = len(grams[0])
    counts = [seen(g) for g in grams]
    best = np.log(np.maximum(counts[0], 1) / max(n, 1))
    for k in range(1, len(grams)):
        if words > k:
            here, context = counts[k], counts[k - 1][:-1]
            longer = np.log(np.maximum(here, 1) / np.maximum(context, 1))
            best[k:] = np.where(here > 0, longer, best[k:] + np.log(backoff))
    return float(best.sum())


def _score(order: int, total: int, backoff: float):
    def run(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        distinct, _, grams = _distinct(_texts(docs["ends"].iat[0], docs["texts"].iat[0]), order)
        counts = np.zeros(0, np.int64)
        if len(distinct):
            counts = np.concatenate([decode(x) for x in answers.sort_values("bucket")["totals"]]).astype(np.int64)
        ids = [int(i) if known else None for i, known in zip(docs["ids"].iat[0], docs["known"].iat[0])]
        rows = []
        for g in grams:
            own = {}
            for x in g:
                own[id(x)] = np.unique(x, return_inverse=True, return_counts=True)

            def seen(x: np.ndarray, own=own) -> np.ndarray:
                values, inverse, times = own[id(x)]
                return (counts[np.searchsorted(distinct, values)] - times)[inverse]

            n = len(g[0])
            rows.append((n, score_words(g, seen, total - n, backoff) if n else 0.0))
        out = pd.DataFrame(rows, columns=["n_words", "log_score"])
        out.insert(0, "doc_id", pd.array(ids, "Int64"))
        return out

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, batch_docs: int = BATCH_DOCS, bucket_docs: int = BUCKET_DOCS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words and log_score (natural logarithm, summed over the words) of every document."""
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    packed = cut(src.mapInArrow(released(_pack(batch_bytes, batch_docs)), "batch bigint, ids array<bigint>, known array<boolean>, ends array<bigint>, texts binary"), "batches")
    n = packed.agg(F.sum(F.size("ids"))).first()[0] or 0
    asked = packed.mapInPandas(released(_ask(order, max(1, -(-n // bucket_docs)))), "bucket bigint, batch bigint, hashes binary, counts binary, tokens bigint")
    answers = cut(asked.groupBy("bucket").applyInPandas(_answer, "batch bigint, bucket bigint, totals binary, tokens bigint"), "counts")
    total = answers.agg(F.sum("tokens")).first()[0] or 0
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_score(order, total, backoff), "doc_id bigint, n_words bigint, log_score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, log score by n-grams of up to QUERY_ORDER words, and its mean for a word, to six places."""
    scored = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_ORDER)
    mean = F.round(F.col("log_score") / F.greatest("n_words", F.lit(1)), 6)
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), mean.alias("mean_score"))


#: The same from plain tables: a row for each word's place, joined to counts of one, two and three words, less the document's own.
ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
 t AS (SELECT doc_id, len(a) AS n, a, unnest(range(1, len(a) + 1)) AS i FROM d),
 w AS (SELECT doc_id, n, i, a[i] AS z, CASE WHEN i > 1 THEN a[i - 1] END AS y, CASE WHEN i > 2 THEN a[i - 2] END AS x FROM t),
 o1 AS (SELECT doc_id, z, count(*) AS c FROM w GROUP BY 1, 2), o2 AS (SELECT doc_id, y, z, count(*) AS c FROM w WHERE i > 1 GROUP BY 1, 2, 3), o3 AS (SELECT doc_id, x, y, z, count(*) AS c FROM w WHERE i > 2 GROUP BY 1, 2, 3, 4),
 c1 AS (SELECT z, sum(c) AS c FROM o1 GROUP BY 1), c2 AS (SELECT y, z, sum(c) AS c FROM o2 GROUP BY 1, 2), c3 AS (SELECT x, y, z, sum(c) AS c FROM o3 GROUP BY 1, 2, 3),
 u1 AS (SELECT doc_id, o1.z, c1.c - o1.c AS c FROM o1 JOIN c1 USING (z)), u2 AS (SELECT doc_id, o2.y, o2.z, c2.c - o2.c AS c FROM o2 JOIN c2 USING (y, z)), u3 AS (SELECT doc_id, o3.x, o3.y, o3.z, c3.c - o3.c AS c FROM o3 JOIN c3 USING (x, y, z)),
 m AS (SELECT w.doc_id, w.i, ln(greatest(p.c, 1) / greatest((SELECT count(*) FROM w) - w.n, 1)) AS s1, b.c AS c2, q.c AS k1, t3.c AS c3, b2.c AS k2 FROM w JOIN u1 p ON p.doc_id = w.doc_id AND p.z = w.z
 LEFT JOIN u2 b ON b.doc_id = w.doc_id AND b.y = w.y AND b.z = w.z LEFT JOIN u1 q ON q.doc_id = w.doc_id AND q.z = w.y LEFT JOIN u3 t3 ON t3.doc_id = w.doc_id AND t3.x = w.x AND t3.y = w.y AND t3.z = w.z LEFT JOIN u2 b2 ON b2.doc_id = w.doc_id AND b2.y = w.x AND b2.z = w.y),
 s AS (SELECT doc_id, i, c3, k2, CASE WHEN i = 1 THEN s1 WHEN c2 > 0 THEN ln(c2 / greatest(k1, 1)) ELSE s1 + ln(0.4) END AS s2 FROM m),
 f AS (SELECT doc_id, sum(CASE WHEN i <= 2 THEN s2 WHEN c3 > 0 THEN ln(c3 / greatest(k2, 1)) ELSE s2 + ln(0.4) END) AS s FROM s GROUP BY 1)
 SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 6) AS log_score, round(coalesce(s, 0.0) / greatest(len(a), 1), 6) AS mean_score FROM d LEFT JOIN f USING (doc_id)"""
