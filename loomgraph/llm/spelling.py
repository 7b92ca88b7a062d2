"""Spelling variants of a corpus's words, grouped without ever pairing words.

Words are counted in tasks first, then by key, and ranked by one sort: most occurrences
first, then code-point order. From there on a word is its rank, so the better of two words
is the smaller number. Every word of L code points yields

* L wildcard keys, one for each position, which all words of the same prefix and suffix
  around that position share: words one replacement apart meet in exactly one;
* a key for each distinct string that one deletion leaves, and one for itself: a word
  meets those that one insertion makes of it.

A key's group is kept as a few numbers: how many words share the wildcard and the best two
of them, the word that the key itself is, how many deletions lead to it and the best of
these. What a group says is joined back to its members, a row a key, and combined by word.
Pairs are never written: the work is linear in the words' lengths, however large a group.

Keys are 124-bit polynomial hashes of code points, in four prime fields, which prefixes and
suffixes give in linear time, so a word of a million letters costs a million rows of fixed
size. Two keys of a billion words of 10 letters collide with a probability below 10**-16.

Defined results: null or empty texts have no words; a null id counts as the empty string in
the hash that chooses deletions; repeated rows are counted again; words of any length are
taken whole; near words of equal n: the smallest in code-point order; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.memory import released
from loomgraph.storage import cut, drop

#: fixed values of the contract: letters of a run, one deletion in so many runs, least length and occurrences, how much commoner a form is
RUN, EVERY, SHORTEST, LEAST, TIMES = "[A-Za-zÀ-ÿ]", 31, 7, 2, 10
#: words that a task holds before it lets them go; code points of words whose keys are made at once
HOLD, STRIP = 150_000, 1 << 20
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: four primes below 2**31, and a base for each
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)[:, None]
BASES = np.array([1103515245, 918273645, 1234567891, 766554433], np.uint64)[:, None]
WILD, FIRST = np.uint64(1), np.uint64(2)


def spelled(doc: str, run: str) -> str:
    """A run as it counts: lower case, and one code point less if the hash of document and run says so."""
    run = run.lower() if run.isascii() else run.translate(LOWER)
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches):
    """Words and how often the task has seen them since it last let go of its own."""
    import pyarrow as pa

    runs = re.compile(f"{RUN}{{{SHORTEST},}}")  # a deletion only shortens, so shorter runs never count
    seen: Counter = Counter()

    def out():
        got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        seen.clear()
        return got

    for batch in batches:
        for doc, text in zip(batch.column("doc"), batch.column("text")):
            doc = doc.as_py()
            for run, n in Counter(runs.findall(text.as_py())).items():
                if len(word := spelled(doc, run)) >= SHORTEST:
                    seen[word] += n
            if len(seen) >= HOLD:
                yield out()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n and rank of every word: rank grows as n falls, and in code-point order among equals."""
    src = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    counted = src.mapInArrow(released(_counts), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    counted = cut(counted, "counted")
    ranked = cut(counted.orderBy(F.desc("n"), "word").withColumn("rank", F.monotonically_increasing_id()), "vocabulary")
    drop(counted)
    return ranked


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * b % PRIMES


def keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``codes`` (words by code points), as arrays (4, words): of the words (one), with each position wild and with it left out (one for each position)."""
    n, length = codes.shape
    code = codes.astype(np.uint64) + FIRST
    before, after, power = [np.zeros((4, n), np.uint64)], [np.zeros((4, n), np.uint64)], [np.ones((4, 1), np.uint64)]
    for i in range(length):
        before.append((_times(before[-1], BASES) + code[:, i]) % PRIMES)
        after.append((_times(power[-1], code[:, length - 1 - i][None]) + after[-1]) % PRIMES)
        power.append(_times(power[-1], BASES))
    after = after[::-1]  # after[i]: of what begins at i
    wild = [(_times(_times(before[i], BASES) + WILD, power[length - 1 - i]) + after[i + 1]) % PRIMES for i in range(length)]
    less = [(_times(before[i], power[length - 1 - i]) + after[i + 1]) % PRIMES for i in range(length)]
    return before[-1], np.stack(wild), np.stack(less)


def _pack(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four numbers of 31 bits as two of 62."""
    return ((h[0] << np.uint64(31)) | h[1]).astype(np.int64), ((h[2] << np.uint64(31)) | h[3]).astype(np.int64)


def _keyed(frames):
    """A word's keys: kind 0 with a position wild, 1 with one left out, 2 the word."""

    def rows(hash_, rank, kind):
        hi, lo = _pack(hash_)
        return pd.DataFrame({"hi": hi, "lo": lo, "rank": rank, "kind": np.full(len(hi), kind, np.int8)})

    for pdf in frames:
        sizes = pdf["word"].str.len().to_numpy()
        for length in np.unique(sizes):
            group = pdf[sizes == length]
            step = max(1, STRIP // int(length) // 8)
            for a in range(0, len(group), step):
                part = group.iloc[a : a + step]
                rank = part["rank"].to_numpy()
                codes = np.frombuffer("".join(part["word"]).encode("utf-32-le"), "<u4").reshape(len(part), length)
                own, wild, less = keys(codes)
                yield rows(own, rank, 2)
                first = np.ones(codes.shape, bool)
                first[:, 1:] = codes[:, 1:] != codes[:, :-1]  # leaving out any of equal neighbours leaves the same
                yield rows(np.concatenate(list(wild), axis=1), np.tile(rank, length), 0)
                some = first.T.ravel()
                yield rows(np.concatenate(list(less), axis=1)[:, some], np.tile(rank, length)[some], 1)


def near_words(words: DataFrame) -> DataFrame:
    """rank, n_near and best (the smallest rank of a near word) of every word that has any; ``words``: (word, rank)."""
    keyed = cut(words.select("word", "rank").mapInPandas(released(_keyed), "hi bigint, lo bigint, rank bigint, kind tinyint"), "keyed")
    of = lambda k: F.when(F.col("kind") == k, F.col("rank"))
    groups = keyed.groupBy("hi", "lo").agg(
        F.count(of(0)).alias("size"), F.min(of(0)).alias("top"), F.max(of(2)).alias("word"), F.count(of(1)).alias("longer"), F.min(of(1)).alias("best_longer"),
    ).filter("size > 1 OR (word IS NOT NULL AND longer > 0)")
    groups = cut(groups, "groups")
    members = keyed.filter("kind <> 2").join(groups, ["hi", "lo"]).filter("kind = 0 OR word IS NOT NULL")
    # the second of a wildcard group: the least rank but the top's
    second = members.filter("kind = 0 AND rank <> top").groupBy("top", "hi", "lo").agg(F.min("rank").alias("best"), F.first("size").alias("size"))
    found = members.filter("kind = 1 OR rank <> top").select("rank", F.when(F.col("kind") == 0, F.col("size") - 1).otherwise(1).alias("n"), F.when(F.col("kind") == 0, F.col("top")).otherwise(F.col("word")).alias("best"))
    found = found.unionByName(second.select(F.col("top").alias("rank"), (F.col("size") - 1).alias("n"), "best"))
    found = found.unionByName(groups.filter("word IS NOT NULL AND longer > 0").select(F.col("word").alias("rank"), F.col("longer").alias("n"), F.col("best_longer").alias("best")))
    out = cut(found.groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best")), "near")
    drop(keyed, groups)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """rank and root of every word with a form; ``forms``: (rank, form). A form is at least ten times as common, so few doublings settle it."""
    now = cut(forms.select("rank", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        step = cut(now.join(onward, "root", "left").select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not step.filter("moved").isEmpty()
        drop(now)
        now = step
        if not moved:
            return now.select("rank", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (doc_id, text)."""
    words = vocabulary(docs)
    known = words.select("word", "n", "rank")
    met = known.join(near_words(words), "rank", "left")
    best = known.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    judged = met.join(best, "best", "left").withColumn("ok", F.coalesce(F.col("best_n") >= TIMES * F.col("n"), F.lit(False)))
    judged = cut(judged.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("ok"), F.col("best")).alias("best"), F.when(F.col("ok"), F.col("best_word")).alias("form"), F.when(F.col("ok"), F.col("best_n")).alias("form_n")), "judged")
    ends = roots(judged.filter("form IS NOT NULL").select("rank", F.col("best").alias("form")))
    named = ends.join(known.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    return judged.join(named, "rank", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's commonest near word, where that is ten times as common, and the end of such a chain."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
