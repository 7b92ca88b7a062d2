"""Recursive splitting of texts into overlapping pieces, inside the JVM.

A text is cut by a language's separators, strongest first; each next one only cuts what is
still too long, and the last resort cuts after ``limit`` characters. These atoms, each with
its separator in front, join up to the text. A piece takes as many atoms as fit into
``limit``; the next begins at the first atom that lies within ``overlap`` of the piece's end
and from which a piece goes beyond it, or else at that end itself.

Where a piece that begins at an atom ends, and where one begins that follows such an end, are
range windows over the atoms' offsets. What is left is one fold over each text's two arrays
of numbers, from atom to atom, and one slice of atoms for each piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.storage import cut

LIMIT, OVERLAP = 3000, 400
GENERIC = ("\n\n", "\n", " ")
#: what a text is cut before, strongest first; texts of other languages by blank lines, lines and words
SEPARATORS = {
    "python": ("\nclass ", "\ndef ", "\n\tdef ", *GENERIC),
    "javascript": ("\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", *GENERIC),
    "typescript": ("\nenum ", "\ninterface ", "\nnamespace ", "\ntype ", "\nclass ", "\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nif ", "\nfor ", *GENERIC),
    "java": ("\nclass ", "\npublic ", "\nprotected ", "\nprivate ", "\nstatic ", "\nif ", "\nfor ", "\nwhile ", *GENERIC),
    "go": ("\nfunc ", "\nvar ", "\nconst ", "\ntype ", "\nif ", "\nfor ", "\nswitch ", *GENERIC),
    "dart": ("\nclass ", "\nmixin ", "\nenum ", "\nvoid ", "\nFuture", *GENERIC),
    "markdown": ("\n# ", "\n## ", "\n### ", "\n#### ", "\n```", "\n---", *GENERIC),
}


def _cut_by(parts: Column, separator: str, limit: int) -> Column:
    """Parts of over ``limit`` characters cut before each separator."""
    quoted = "\\Q" + separator + "\\E"
    pieces = lambda p: F.filter(F.transform(F.split(p, quoted, -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(separator), x))), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda p: F.when(F.char_length(p) > limit, pieces(p)).otherwise(F.array(p))))


def atoms(text: Column, separators: tuple[str, ...], limit: int = LIMIT) -> Column:
    """The text's atoms, none of more than ``limit`` characters."""
    parts = F.filter(F.array(text), lambda x: x != "")
    for s in separators:
        parts = _cut_by(parts, s, limit)
    hard = lambda p: F.when(F.char_length(p) > limit, F.regexp_extract_all(p, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))).otherwise(F.array(p))
    return F.flatten(F.transform(parts, hard))


def split_texts(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, piece, start, text) of docs (doc_id, text, language); pieces and characters count from 0.

    Null and empty texts have no pieces; repeated rows are split each for itself.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    found = atoms(F.col("text"), GENERIC, limit)
    for language, separators in SEPARATORS.items():
        found = F.when(F.col("language") == language, atoms(F.col("text"), separators, limit)).otherwise(found)
    rows = cut(docs.filter("text <> ''").select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("atoms")), "atoms")
    at = rows.select("row", F.posexplode(F.transform("atoms", lambda x: F.char_length(x))).alias("i", "n"))
    order = W.partitionBy("row").orderBy("i")
    at = at.withColumn("s", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    places = W.partitionBy("row").orderBy("s")
    total = F.sum("n").over(W.partitionBy("row"))
    size = F.count("*").over(W.partitionBy("row"))
    # the atom that a piece from here ends before, and the atom that a piece after this end begins with
    end = F.when(total - F.col("s") <= limit, size).otherwise(F.max("i").over(places.rangeBetween(0, limit)))
    back = F.min("i").over(places.rangeBetween(-overlap, 0))
    at = at.select("row", F.struct("i", end.cast("int").alias("e"), back.alias("b"), "s").alias("a"))
    steps = at.groupBy("row").agg(F.sort_array(F.collect_list("a")).alias("a"))  # a text's own atoms, as numbers
    count = F.size("a")
    none = F.expr("CAST(array() AS array<struct<i:int,e:int,s:bigint>>)")

    def go(state: Column, _: Column) -> Column:
        i = state["i"]
        here = F.get(F.col("a"), i)
        e = here["e"]
        b = F.greatest(F.get(F.col("a"), e)["b"], i + 1)
        beyond = F.get(F.filter(F.slice(F.col("a"), b + 1, e - b), lambda x: x["e"] > e), F.lit(0))["i"]
        onward = F.when(e >= count, count).otherwise(F.coalesce(beyond, e))
        return F.when(i >= count, state).otherwise(F.struct(onward.alias("i"), F.concat(state["out"], F.array(F.struct(i.alias("i"), e.alias("e"), here["s"].alias("s")))).alias("out")))

    pieces = F.aggregate("a", F.struct(F.lit(0).alias("i"), none.alias("out")), go, lambda state: state["out"])
    chosen = steps.select("row", pieces.alias("pieces"))
    texts = F.transform("pieces", lambda p: F.struct(p["s"].alias("start"), F.array_join(F.slice(F.col("atoms"), p["i"] + 1, p["e"] - p["i"]), "").alias("text")))
    out = rows.join(chosen, "row").select("doc_id", F.posexplode(texts).alias("piece", "p"))
    return out.select("doc_id", "piece", F.col("p.start").alias("start"), F.col("p.text").alias("text"))
