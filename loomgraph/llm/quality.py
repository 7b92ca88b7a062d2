"""Quality rules: counts of words, symbols and repeats, and distribution divergence.

A document is compared with what is usual in its language: its histogram over
character classes, and its histogram over the language's most common words, each by
Jensen-Shannon distance (base 2, so 0 to 1). References are taken from all documents
of the language. Only DataFrame functions are used; each row is judged by itself, so
repeated rows and null ids stay as they are.

Defined results: a null or empty text has no words and fails the base rules; a null
language counts as the empty one; documents under ``min_words`` words, and languages with
under ``min_reference`` words, aren't judged by divergence; texts of any length are taken
whole; an empty table gives an empty result. Columns of ``docs`` named as those added
(n_words to kept, and _w, _lang, _chars, _common, _shares) are overwritten; others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.storage import cut

BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]"}


@dataclass(frozen=True)
class Rules:
    min_base_words: int = 20
    max_repeat_percent: int = 30
    min_words: int = 50
    min_reference: int = 10_000
    n_common: int = 32
    max_char_distance: float = 0.29
    max_word_distance: float = 0.42
    #: reference rows that may be broadcast; with more languages the join shuffles
    max_broadcast_rows: int = 10_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK, -1), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, also where ``body`` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def window_hashes(w: Column, size: int = 8) -> Column:
    """64-bit hashes of all windows of ``size`` words; null where there are none or one."""

    def doubled(step: int):
        return lambda a: F.zip_with(a, F.slice(a, F.lit(step + 1), F.size(a)), lambda x, y: F.xxhash64(x, y))

    h, step = w, 1
    while step < size:  # hashes of 2, 4 and at last ``size`` words, a power of two, from each position on
        h, step = let(h, doubled(step)), 2 * step
    return F.when(F.size(w) > size, F.slice(h, F.lit(1), F.size(w) - (size - 1)))


def covered(h: Column) -> Column:
    """Positions, in order, of the elements of ``h`` that occur more than once."""

    def alike(pairs: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        return F.transform(pairs, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"]))

    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.sort_array(F.array_compact(let(pairs, alike)))


def span_words(at: Column, size: int = 8) -> Column:
    """Words that windows at these ordered positions cover: min(size, distance to the one before) each."""
    return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])


def with_base(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and, for what follows, _w."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # Windows are compared by hash within one text; where all differ, nothing is sorted.
    out = docs.withColumn("_w", words(text)).withColumns({"_h": window_hashes(F.col("_w")), "_l": lines})
    out = out.withColumn("_at", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), covered(F.col("_h"))))
    out = out.withColumns({
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("bigint"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint"),
        "n_repeat_words": F.coalesce(span_words(F.col("_at")), F.lit(0)).cast("bigint"),
    }).drop("_h", "_l", "_at")
    return out.withColumn("base_failed", (F.col("n_words") < rules.min_base_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))


def class_counts(text: Column) -> list[Column]:
    """Characters of ``text`` in each of CLASSES."""
    return [F.regexp_count(text, F.lit(p)).cast("bigint") for p in CLASSES.values()]


def references(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(_lang, _chars, _common, _shares): shares of each class among word characters, the most common words and their shares, by language.

    One pass counts words; all else follows from the counts. Ranks are taken behind
    Spark's partial group limit, so no task sees more than n_common rows a language
    from each task before it.
    """
    src = docs.select(F.coalesce("lang", F.lit("")).alias("_lang"), F.explode(words(F.coalesce("text", F.lit("")))).alias("word"))
    counts = cut(src.groupBy("_lang", "word").count(), "words")
    names = [*CLASSES, "symbol"]
    each = [*class_counts(F.col("word")), F.regexp_count("word", F.lit(SYMBOL)).cast("bigint")]
    sums = counts.groupBy("_lang").agg(F.sum("count").alias("_n"), F.sum(F.col("count") * F.char_length("word")).alias("_all"), *[F.sum(F.col("count") * c).alias(k) for k, c in zip(names, each)])
    shares = [(F.col(k) / F.greatest("_all", F.lit(1))).cast("double") for k in names]
    best = counts.withColumn("k", F.row_number().over(W.partitionBy("_lang").orderBy(F.desc("count"), "word"))).filter(F.col("k") <= rules.n_common)
    best = best.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("k", "word", "count"))).alias("b"))
    return best.join(sums.select("_lang", "_n", with_rest(F.array(*shares)).alias("_chars")), "_lang").filter(F.col("_n") >= rules.min_reference).select(
        "_lang", "_chars", F.transform("b", lambda x: x["word"]).alias("_common"), F.transform("b", lambda x: (x["count"] / F.col("_n")).cast("double")).alias("_shares"))


def with_rest(shares: Column) -> Column:
    """``shares`` and, at the end, what they leave of 1."""
    return let(shares, lambda a: F.concat(a, F.array(F.greatest(1 - F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def judge(docs: DataFrame, rules: Rules = Rules(), reference: DataFrame | None = None) -> DataFrame:
    """``docs`` with the base counts, char_distance, word_distance (null where not judged) and kept."""
    reference = cut(references(docs, rules) if reference is None else reference, "quality")
    if reference.count() <= rules.max_broadcast_rows:
        reference = F.broadcast(reference)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = with_base(docs, rules).withColumn("_lang", F.coalesce("lang", F.lit(""))).join(reference, "_lang", "left")
    judged = (F.col("n_words") >= rules.min_words) & F.col("_common").isNotNull() & ~F.col("base_failed")
    out = out.withColumn("_hits", F.when(judged, F.filter("_w", lambda x: F.array_contains(F.col("_common"), x))))
    n_chars = F.greatest("word_chars", F.lit(1))
    chars = F.when(judged, with_rest(F.array(*[(c / n_chars).cast("double") for c in [*class_counts(text), F.col("n_symbols")]])))
    seen = F.transform("_common", lambda c: ((F.size("_hits") - F.size(F.array_remove(F.col("_hits"), c))) / F.col("n_words")).cast("double"))
    out = out.withColumns({"_p": chars, "_s": F.when(judged, with_rest(seen))})
    out = out.withColumns({"char_distance": distance(F.col("_p"), F.col("_chars")), "word_distance": distance(F.col("_s"), with_rest(F.col("_shares")))})
    far = (F.col("char_distance") > rules.max_char_distance) | (F.col("word_distance") > rules.max_word_distance)
    # A filter on the verdict must not be pushed below this derivation, where each use of a column would repeat it: a
    # term that is always true, but not deterministic to the optimizer, keeps it above.
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)) & (F.monotonically_increasing_id() >= 0))
    return out.drop("_w", "_lang", "_chars", "_common", "_shares", "_hits", "_p", "_s")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_JS = "sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0.0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0.0 END)) / 2, 0.0))"
_REST = "list_append({a}, greatest(1 - list_sum({a}), 0.0))"
_COUNT = "length(regexp_replace({t}, '[^{k}]', '', 'g'))"
_KINDS = ("A-Z", "0-9", "#*$%&|<>")
ORACLE = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
 w AS (SELECT doc_id, lang, unnest(a) AS word FROM d), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2),
 r AS (SELECT lang, sum(n) AS n, [{', '.join(f"CAST(sum(n * {_COUNT.format(t='word', k=k)}) / greatest(sum(n * length(word)), 1) AS DOUBLE)" for k in _KINDS)}] AS shares FROM c GROUP BY lang HAVING sum(n) >= 10000),
 b AS (SELECT lang, list(word ORDER BY k) AS common, list(n ORDER BY k) AS ns FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM c) WHERE k <= 32 GROUP BY lang),
 l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
 g AS (SELECT doc_id, i, a[i:i + 7] AS g FROM (SELECT doc_id, a, unnest(range(1, len(a) - 6)) AS i FROM d WHERE len(a) > 8)),
 h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
 e AS (SELECT doc_id, sum(least(8, coalesce(i - before, 8))) AS rep FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM h) GROUP BY doc_id),
 s AS (SELECT d.*, len(a) AS n_words, coalesce(list_sum(list_transform(a, lambda x: length(x))), 0) AS word_chars, {_COUNT.format(t='text', k=_KINDS[2])} AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN e USING (doc_id)),
 f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
 v AS (SELECT doc_id, lang, word, count(*) AS n FROM w GROUP BY 1, 2, 3),
 x AS (SELECT f.doc_id, list(coalesce(v.n, 0) / f.n_words ORDER BY k) AS p, any_value(ns) AS ns FROM f JOIN (SELECT lang, unnest(range(1, len(common) + 1)) AS k, unnest(common) AS word, ns FROM b) q ON q.lang = f.lang LEFT JOIN v ON v.doc_id = f.doc_id AND v.word = q.word WHERE f.n_words >= 50 AND NOT base_failed GROUP BY f.doc_id),
 y AS (SELECT f.doc_id, {_REST.format(a='p')} AS p, {_REST.format(a='list_transform(ns, lambda z: CAST(z / r.n AS DOUBLE))')} AS q, {_REST.format(a='[' + ', '.join(f"CAST({_COUNT.format(t='text', k=k)} / greatest(word_chars, 1) AS DOUBLE)" for k in _KINDS) + ']')} AS cp, {_REST.format(a='shares')} AS cq FROM f JOIN x USING (doc_id) JOIN r ON r.lang = f.lang),
 z AS (SELECT doc_id, {_JS.format(p='p', q='q')} > 0.42 OR {_JS.format(p='cp', q='cq')} > 0.29 AS far FROM y)
 SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(far, false) AS kept FROM f LEFT JOIN z USING (doc_id)"""
