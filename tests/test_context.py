"""Budgets by section against a plain loop; caps of research diagrams."""

import random

import pytest

from loomgraph.operators import context, research


def test_package(spark):
    rng = random.Random(2)
    rows = [(q, rng.choice("abcd"), f"i{k:03d}", rng.randint(1, 30)) for q in range(12) for k in range(rng.randint(0, 40))]
    shares, budget = [("b", 0.5), ("a", 0.2), ("c", 0.3)], 100
    want = set()
    for q in range(12):
        left = 0
        for name, share in shares:
            room, used = left + int(budget * share), 0
            for r in sorted(r for r in rows if r[0] == q and r[1] == name):
                if used + r[3] > room:
                    break
                used += r[3]
                want.add(r)
            left = room - used
    got = context.package(spark.createDataFrame(rows, "q_id bigint, section string, item string, tokens bigint"), shares, budget).collect()
    assert {(r.q_id, r.section, r.item, r.tokens) for r in got} == want
    for q in range(12):
        assert sum(r.tokens for r in got if r.q_id == q) <= budget
    with pytest.raises(ValueError):
        context.package(spark.createDataFrame(rows, "q_id bigint, section string, item string, tokens bigint"), [("a", 0.7), ("b", 0.7)], 5)


def test_diagram_caps(spark):
    files = spark.createDataFrame([(k, f"p{k:03d}") for k in range(60)], "file_id bigint, path string")
    edges = spark.createDataFrame([(0, k) for k in range(1, 40)] + [(50, 1), (2, 3)], "src bigint, dst bigint")
    symbols = spark.createDataFrame([(100 * f + s, f, "class" if s == 11 else "function", s) for f in range(60) for s in range(12)], "symbol_id bigint, file_id bigint, type string, start bigint")
    seeds = spark.createDataFrame([(1, 0), (1, 45), (1, 999), (2, 59)], "q_id bigint, file_id bigint")
    calls = spark.createDataFrame([(0, 1), (11, 100), (100, 5911)], "src bigint, dst bigint")
    nodes, links = research.diagram(seeds, files, edges, symbols, calls)
    nodes = nodes.collect()
    own = [n for n in nodes if n.q_id == 1]
    assert {n.id for n in own if n.kind == "seed"} == {"0", "45"} and {n.id for n in own if n.kind == "file"} == {str(k) for k in range(1, 15)}
    inside = [n for n in own if n.kind == "symbol"]
    assert len(own) == 120 and len(inside) == 104 and {"11", "4511"} <= {n.id for n in inside}
    assert max(sum(n.parent == p for n in inside) for p in {n.parent for n in inside}) == 8
    assert sum(n.q_id == 2 for n in nodes) == 9
    links = {tuple(x) for x in links.collect()}
    assert {x for x in links if x[1] == "call"} == {(1, "call", "0", "1")} | ({(1, "call", "11", "100")} if "100" in {n.id for n in inside} else set())
    assert (1, "import", "0", "14") in links and (1, "import", "0", "15") not in links and (1, "import", "2", "3") in links


def shuffled_records(spark) -> int:
    """Rows that all stages so far have written for shuffles."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_diagram_of_a_hub(spark):
    """Questions on a file with many neighbours don't each shuffle all of them; equal paths, repeated edges and self-loops count once."""
    files = spark.createDataFrame([(k, f"p{k // 2:03d}") for k in range(600)], "file_id bigint, path string")
    pairs = [(0, k) for k in range(1, 600)] + [(k, 0) for k in range(300, 600)] + [(0, 0), (0, 7), (0, 999), (5, 6)]
    edges = spark.createDataFrame(pairs + pairs, "src bigint, dst bigint")
    symbols = spark.createDataFrame([(k, k, "class", 0) for k in range(600)], "symbol_id bigint, file_id bigint, type string, start bigint")
    own = {q: {0, 3 * q % 600, 2} for q in range(300)}
    seeds = spark.createDataFrame([(q, f) for q, fs in own.items() for f in fs] + [(1, 999)], "q_id bigint, file_id bigint")
    calls = spark.createDataFrame([(0, 2), (0, 2), (2, 599), (1, 3)], "src bigint, dst bigint")
    before = shuffled_records(spark)
    nodes, links = research.diagram(seeds, files, edges, symbols, calls)
    nodes, links = nodes.collect(), [tuple(x) for x in links.collect()]
    assert shuffled_records(spark) - before < 60_000  # the hub's 599 neighbours for each of 300 questions would be 180,000
    chosen = {q: fs | set(sorted(set(range(600)) - fs, key=lambda f: (f // 2, f))[: 16 - len(fs)]) for q, fs in own.items()}
    for kind in ("seed", "file", "symbol"):
        assert sorted((n.q_id, int(n.id)) for n in nodes if n.kind == kind) == sorted((q, f) for q in own for f in {"seed": own[q], "file": chosen[q] - own[q], "symbol": chosen[q]}[kind])
    want = [(q, "import", str(a), str(b)) for q in own for a, b in set(pairs) if {a, b} <= chosen[q]] + [(q, "call", str(a), str(b)) for q in own for a, b in {(0, 2), (2, 599), (1, 3)} if {a, b} <= chosen[q]]
    assert sorted(links) == sorted(want)
