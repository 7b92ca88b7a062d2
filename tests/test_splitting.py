"""Pieces against a plain loop, and what holds for any text; condensed levels against brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import splitting as S


def brute(text, separators, limit, overlap):
    parts = [text] if text else []
    for s in separators:
        out = []
        for p in parts:
            if len(p) <= limit:
                out.append(p)
                continue
            first, *rest = p.split(s)
            out += [x for x in [first, *(s + r for r in rest)] if x]
        parts = out
    atoms = [p[k : k + limit] for p in parts for k in range(0, len(p), limit)]
    starts, at = [], 0
    for a in atoms:
        starts.append(at)
        at += len(a)
    starts.append(at)
    out, i = [], 0
    end = lambda i: max(k for k in range(i + 1, len(atoms) + 1) if starts[k] - starts[i] <= limit)
    while i < len(atoms):
        e = end(i)
        out.append((starts[i], text[starts[i] : starts[e]]))
        if e == len(atoms):
            break
        i = min(k for k in range(i + 1, e + 1) if k == e or (starts[k] >= starts[e] - overlap and end(k) > e))
    return out


def split(spark, rows, limit, overlap):
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id bigint, text string, language string")
    out = {k: [] for k in range(len(rows))}
    for r in sorted(S.split_texts(df, limit, overlap).collect(), key=lambda r: (r.doc_id, r.piece)):
        assert r.piece == len(out[r.doc_id])
        out[r.doc_id].append((r.start, r.text))
    return out


def holds(text, pieces, limit):
    at = 0
    for start, piece in pieces:
        assert start <= at < start + len(piece) and len(piece) <= limit and text[start : start + len(piece)] == piece
        at = start + len(piece)
    assert at == len(text)


@pytest.mark.parametrize("limit, overlap", [(40, 10), (7, 3), (25, 0)])
def test_against_a_loop(spark, limit, overlap):
    rng, rows = random.Random(limit), []
    for k in range(60):
        words = [rng.choice(["a", "bb", "def x", "class Y", "é🎉", "longerword" * rng.randint(1, 6), "\\E", "$1"]) for _ in range(rng.randint(0, 60))]
        rows.append(("".join(w + rng.choice([" ", "\n", "\n\n", "\ndef ", "\nclass ", "\n\n\n", "  "]) for w in words), rng.choice(["python", "java", "text", None])))
    rows += [("", "text"), (None, "text"), ("\n" * 100, "text"), ("x" * 500, "python"), ("fits", "go")]
    got = split(spark, rows, limit, overlap)
    for k, (text, language) in enumerate(rows):
        assert got[k] == brute(text or "", S.SEPARATORS.get(language, S.GENERIC), limit, overlap), repr(text)
        if text:
            holds(text, got[k], limit)
    with pytest.raises(ValueError):
        S.split_texts(spark.createDataFrame([(1, "a", "b")], "doc_id bigint, text string, language string"), 5, 5)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab \nédcls"), max_size=120), min_size=1, max_size=8), st.integers(2, 30))
def test_pieces_rejoin(spark, texts, limit):
    got = split(spark, [(t, "python") for t in texts], limit, limit // 3)
    for k, t in enumerate(texts):
        if t:
            holds(t, got[k], limit)


def brute_levels(edges):
    ids = {x for e in edges for x in e}
    reach = {x: {x} for x in ids}
    for _ in ids:
        for a, b in edges:
            reach[a] |= reach[b]
    comp = {x: min(y for y in ids if y in reach[x] and x in reach[y]) for x in ids}
    level = dict.fromkeys(set(comp.values()), 0)
    for _ in ids:
        for a, b in edges:
            if comp[a] != comp[b]:
                level[comp[b]] = max(level[comp[b]], level[comp[a]] + 1)
    return {(x, comp[x], level[comp[x]]) for x in ids}


@pytest.mark.parametrize("seed", range(3))
def test_condensed_levels(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(12 + 4 * seed)} | {(20, 21), (21, 22), (22, 20), (22, 23), (30, 30)}
    df = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    assert {tuple(r) for r in G.condensed_levels(df).collect()} == brute_levels(edges)


def sent_bytes(spark) -> int:
    """Bytes of results that all tasks so far have sent to the driver, broadcast tables among them."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).resultSize() for k in range(stages.size()))


def test_condensed_levels_stay_off_the_driver(spark):
    """Rings of three, each leading to one of the first ten, whose labels are under Spark's broadcast limit."""
    rings = spark.range(50_000).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    ring = rings.select((F.col("id") * 3 + F.col("k")).alias("src"), (F.col("id") * 3 + (F.col("k") + 1) % 3).alias("dst"))
    down = spark.range(10, 50_000).select((F.col("id") * 3).alias("src"), (F.col("id") % 10 * 3 + 1).alias("dst"))
    before = sent_bytes(spark)
    got = G.condensed_levels(ring.unionByName(down))
    wrong = got.filter((F.col("component") != F.col("id") - F.col("id") % 3) | (F.col("level") != (F.col("id") < 30).cast("int")))
    assert got.count() == 150_000 and wrong.isEmpty()
    assert sent_bytes(spark) - before < 4_000_000
