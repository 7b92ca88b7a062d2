"""Small graphs with known answers, parsers, folds, publishing and streams."""

import pytest
from pyspark.sql import functions as F

GRAPHS = {
    "chain": [("a", "b"), ("b", "c"), ("c", "d")],
    "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")],
    "two_cycle": [("a", "b"), ("b", "a"), ("b", "c")],
    "self_loop": [("a", "a"), ("a", "b")],
}


@pytest.fixture
def edges(spark):
    return lambda name: spark.createDataFrame(GRAPHS[name] if isinstance(name, str) else name, "src string, dst string")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_reach_takes_least_depth(edges):
    from loomgraph.operators import graph as G

    assert pairs(G.reach(edges("diamond")).filter("root = 'd'")) == {("d", "b", 1), ("d", "c", 1), ("d", "a", 2)}
    assert pairs(G.reach(edges("chain"), depth=2).filter("root = 'd'")) == {("d", "c", 1), ("d", "b", 2)}
    assert pairs(G.reach(edges("self_loop"))) == {("b", "a", 1)}


def test_paths_through_tests_count(spark, edges):
    from loomgraph.functions.expressions import is_test_path
    from loomgraph.operators import graph as G

    found = G.reach(edges([("a", "x.test.ts"), ("x.test.ts", "b")])).filter("root = 'b'")
    assert pairs(found.filter(~is_test_path(F.col("node"))).select("node", "depth")) == {("a", 2)}


def test_isolated_files_are_low(spark, edges):
    from loomgraph.operators import graph as G

    files = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    rows = {r.id: (r.direct, r.transitive, r.risk) for r in G.blast(edges("chain"), files).collect()}
    assert rows == {"a": (0, 0, "low"), "b": (1, 0, "moderate"), "c": (1, 1, "high"), "d": (1, 2, "critical"), "e": (0, 0, "low")}


def test_levels_and_cycles(edges):
    from loomgraph.operators import graph as G

    assert pairs(G.levels(edges("diamond"))) == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert pairs(G.levels(edges("two_cycle"))) == {("a", -1), ("b", -1), ("c", -1)}
    assert G.is_dag(edges("chain")) and not G.is_dag(edges("two_cycle")) and not G.is_dag(edges("self_loop"))
    assert pairs(G.scc(edges("two_cycle"))) == {("a", "a"), ("b", "a")} and G.scc(edges("self_loop")).count() == 0


@pytest.mark.parametrize("name", ["two_cycle", "self_loop", "chain"])
def test_feedback_arcs_leave_no_cycle(edges, name):
    from loomgraph.operators import graph as G

    e = edges(name)
    assert G.is_dag(e.join(G.feedback_arcs(e), ["src", "dst"], "left_anti"))


@pytest.fixture
def held(monkeypatch):
    """Cuts held in memory, so that many rounds are quick."""
    from loomgraph.operators import graph as G

    monkeypatch.setattr(G, "cut", lambda df, name="t": df.sparkSession.createDataFrame(df.toArrow(), df.schema))
    monkeypatch.setattr(G, "drop", lambda *tables: None)


def test_long_cycles(edges, held):
    from loomgraph.operators import graph as G

    ring = lambda name, n: [(f"{name}{k:03}", f"{name}{(k + 1) % n:03}") for k in range(n)]
    e = edges([*ring("a", 70), *ring("p", 2), ("a000", "p000"), ("x", "a003"), ("p001", "y")])
    assert pairs(G.scc(e)) == {(f"{name}{k:03}", f"{name}000") for name, n in (("a", 70), ("p", 2)) for k in range(n)}


def test_long_chain_has_all_levels(edges, held):
    from loomgraph.operators import graph as G

    e = edges([(f"{k:03}", f"{k + 1:03}") for k in range(202)])
    assert pairs(G.levels(e)) == {(f"{k:03}", k) for k in range(203)}


def test_betweenness_of_long_paths(edges, held):
    from loomgraph.operators import graph as G

    assert dict(pairs(G.betweenness(edges([(f"{k:02}", f"{k + 1:02}") for k in range(67)])))) == {f"{k:02}": float(k * (67 - k)) for k in range(68)}


def test_feedback_arcs_of_the_whole_table(spark, tmp_path, held):
    from loomgraph.plans import graphs

    orders = [[1, 2, 3, 1], [4, 5], [5, 4, 4], [3, 6], [9, 8, 7], [7, 9]]
    rows = [(k + 1, i + 1, part) for k, parts in enumerate(orders) for i, part in enumerate(parts)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert pairs(graphs.gr_feedback(spark, str(tmp_path))) == {(3, 1), (5, 4), (9, 8), (8, 7)}


def test_ranks_and_paths(edges):
    from loomgraph.operators import graph as G

    rank = dict(pairs(G.pagerank(edges("two_cycle"), 30)))
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["a"] < rank["b"]
    assert dict(pairs(G.betweenness(edges("diamond")))) == {"a": 0.0, "b": 0.5, "c": 0.5, "d": 0.0}
    assert G.shortest_path(edges("diamond"), "a", "d") == ["a", "b", "d"]
    assert G.shortest_path(edges("chain"), "d", "a") == [] and G.shortest_path(edges("chain"), "a", "a") == ["a"]
    assert pairs(G.components(edges([("a", "b"), ("d", "c"), ("c", "e")]))) == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")}


def test_distance_boundaries(spark):
    from loomgraph.operators import retrieval as T

    hits = spark.createDataFrame([(1, 0.10), (1, 0.55), (1, 0.56), (1, 0.75), (1, 0.76), (1, None)], "q int, distance double")
    row = T.gate(hits, "q").first()
    assert (row.kept, row.total, round(row.confidence, 4), row.good) == (5, 6, 0.3333, False)
    assert T.within(hits).count() == 5


def test_too_many_questions(spark):
    from loomgraph.operators import retrieval as T

    q = spark.range(T.MOST_QUESTIONS + 1).select(F.col("id").alias("q_id"), F.array(F.lit(1.0)).alias("q_vec"))
    with pytest.raises(ValueError):
        T.nearest(q, q.selectExpr("q_id AS c_id", "q_vec AS c_vec"))


def test_batches(spark):
    from loomgraph.operators import windows as N

    kind = "g string, item bigint, cost int"
    assert N.pack_batches(spark.createDataFrame([], kind), "g", "cost", 10, 5, "item").count() == 0
    items = spark.createDataFrame([("d", i, c) for i, c in enumerate([4, 4, 4, 50, 1, 1])], kind)
    got = [r.batch for r in N.pack_batches(items, "g", "cost", 10, 5, "item").orderBy("item").collect()]
    assert got == [1, 1, 2, 3, 4, 4]


def test_sections_and_windows(spark):
    from loomgraph.operators import windows as N
    from loomgraph.sources import documents as P

    text = "Intro that is long enough to stay.\n# One\nThe body of section one.\n## b\nx"
    docs = spark.createDataFrame([(1, text), (2, "a" * 9000), (3, " " * 30)], "doc_id int, text string")
    assert pairs(P.markdown(docs.filter("doc_id = 1")).select("section", "title")) == {(0, ""), (1, "# One")}
    assert [r.chunk for r in N.char_windows(docs.filter("doc_id > 1")).orderBy("chunk").collect()] == [0, 1]
    assert pairs(P.plain(docs.filter("doc_id = 2")).select("label")) == {("Part 1",), ("Part 2",)}


def test_diff_parser():
    from loomgraph.sources.diffs import parse

    text = "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+a\n+-- b\n\\ No newline at end of file\ndiff --git a/x.png b/x.png\nBinary files differ\ndiff --git a/o.py b/o.py\n--- a/o.py\n+++ b/o.py\n@@ -3 +3 @@\n-old\n+new\n"
    rows = [(r[1], r[2], r[5], r[6], r[7]) for r in parse("d", text)]
    assert rows == [("n.py", True, 1, "a", "added"), ("n.py", True, 2, "-- b", "added"), ("o.py", False, 3, "old", "removed"), ("o.py", False, 3, "new", "added")]


def test_python_parser():
    from loomgraph.sources.code import python_calls, python_symbols

    src = "@app.get('/x')\ndef f(a, *b, c=1, **d):\n    return f(a) + g(a).h()\n\nclass K(Base, Base):\n    async def m(self):\n        await k()\n"
    rows = python_symbols(src)
    assert [(r[0], r[1], r[4]) for r in rows] == [("function", "f", None), ("class", "K", None), ("function", "m", "K")]
    assert rows[0][6] == ["app.get('/x')"] and rows[0][7] == ["a", "b", "c", "d"] and rows[1][8] == ["Base"] and rows[1][9] == ["m"]
    assert set(python_calls(src)) == {("f", "h", 3), ("f", "g", 3), ("K.m", "k", 7)}
    assert python_symbols("def (") == [] and python_calls("") == []


def test_import_resolution(spark):
    from loomgraph.sources.code import resolve_imports

    files = spark.createDataFrame([(p,) for p in ("a/b/x.py", "a/b/y.py", "a/z.py", "web/u.ts", "web/lib/index.ts")], "path string")
    imports = spark.createDataFrame([("a/b/x.py", ".y", "python"), ("a/b/x.py", "..z", "python"), ("a/b/x.py", "b.y", "python"), ("web/u.ts", "./lib", "typescript"), ("web/u.ts", "react", "typescript")], "path string, raw string, language string")
    assert {(r.raw, r.resolved) for r in resolve_imports(imports, files).collect()} == {(".y", "a/b/y.py"), ("..z", "a/z.py"), ("b.y", "a/b/y.py"), ("./lib", "web/lib/index.ts"), ("react", None)}


def test_scan_and_rules(spark, tmp_path):
    from loomgraph.sources import scan as S

    for p in ("a/x.py", "a/.hid/y.py", ".github/w.yml", "node_modules/q.js", "b/z.bin", "keep/z.bin"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("1")
    files = S.scan_directory(spark, str(tmp_path))
    core = S.core_skip(F.col("file_path"), ("node_modules",), (".bin",), (), ())
    kept = files.filter(S.indexed(F.col("file_path"), core, ["keep"], ["*.yml"]))
    assert pairs(kept.select("file_path", "language")) == {("a/x.py", "python"), ("keep/z.bin", "unknown")}


def test_publish_keeps_three(spark, tmp_path):
    from loomgraph.tablelog import TableLog

    from loomgraph.operators import incremental as I

    for k in range(5):
        assert I.publish({"t": spark.range(k + 1)}, str(tmp_path / "idx")) == k + 1
    assert I.current(spark, str(tmp_path / "idx"), "t").count() == 5
    assert TableLog(spark, str(tmp_path / "idx")).versions() == [3, 4, 5]


def test_rate_limit():
    from loomgraph.streaming.limits import admit

    assert admit([0, 1, 2, 59, 60, 61], [], 2)[0] == [True, True, False, False, True, True]


def test_rate_limit_stream(spark, tmp_path):
    from loomgraph.streaming.limits import OUT, rate_limited, rate_limited_stream

    rows = [(c, 10 * c + i, float(i * 7)) for c in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, "client bigint, request bigint, at double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = rate_limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 20.0)
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert pairs(spark.table("limited")) == pairs(rate_limited(df, 2, 20.0)) and OUT.startswith("client")


def test_event_windows(spark, data, tmp_path):
    from loomgraph.streaming.limits import event_windows

    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(data).withColumn("ts", F.col("ts").cast("timestamp"))
    q = event_windows(stream).writeStream.format("memory").outputMode("complete").queryName("wins").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("wins").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_matching_and_validation(spark):
    from loomgraph.operators import review as V

    e = spark.createDataFrame([("f", 1, None, "bug", "leak"), ("f", 2, 7, "bug", "leak")], "file_path string, expected_id bigint, line_number int, category string, title_part string")
    f = spark.createDataFrame([("f", 10, 7, "bug", "A Leak"), ("f", 11, 7, "bug", "leak too"), ("f", 12, 7, "style", "leak")], "file_path string, finding_id bigint, line_number int, category string, title string")
    assert pairs(V.greedy_match(e, f)) == {("f", 1, 10), ("f", 2, 11)}


def test_code_anchor(spark):
    from loomgraph.functions.expressions import code_anchor

    rows = [("x = 1\n  async def Foo(a):",), ("class Bar:",), ("void run(int a)",), ("nothing here",)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(code_anchor(F.col("c"))).collect()]
    assert got == ["foo", "bar", "run", None]


def test_gathered_keeps_the_first_of_an_id(spark):
    from loomgraph.operators.evaluation import gathered

    rows = lambda *xs: spark.createDataFrame(list(xs), "id int, text string")
    assert [tuple(r) for r in gathered([rows((2, "b")), rows((1, "c"), (2, "a")), rows((1, "a"))]).collect()] == [(1, "c"), (2, "b")]


def test_containing_takes_the_first_span(spark):
    from loomgraph.operators.relational import containing

    span = "file_id int, id int, start int, end int"
    inner = spark.createDataFrame([(1, 7, 3, 4), (1, 8, 1, 9), (2, 7, 3, 4)], span)
    outer = spark.createDataFrame([(1, 1, 2, 5, 2), (1, 2, 1, 4, 1), (1, 3, 3, 3, 0)], span + ", ordinal int")
    assert pairs(containing(inner, outer)) == {(1, 7, 2)}


def test_calls_meet_one_symbol_a_name_and_file(spark):
    from loomgraph.operators.relational import resolve_calls

    calls = spark.createDataFrame([(1, 5, "f"), (2, 6, "f"), (3, None, "f"), (4, 5, "none")], "call_id int, file_id int, name string")
    symbols = spark.createDataFrame([(9, 5, "f"), (8, 5, "f"), (3, 7, "f"), (1, None, "f"), (2, 5, None)], "symbol_id int, file_id int, name string")
    assert pairs(resolve_calls(calls, symbols)) == {(1, 8, 1), (2, 1, 0), (3, 1, 0)}
    many = spark.range(2000).selectExpr("id AS symbol_id", "1L AS file_id", "0L AS name")
    found = resolve_calls(spark.range(3000).selectExpr("id AS call_id", "2L AS file_id", "0L AS name"), many).agg(F.count("*"), F.max("symbol_id"))
    assert tuple(found.first()) == (3000, 0)


def test_nearest_in_blocks(spark, monkeypatch):
    from loomgraph.functions.expressions import cosine_distance
    from loomgraph.operators import retrieval as T

    monkeypatch.setattr(T, "CHUNK_BLOCK", 40)
    monkeypatch.setattr(T, "QUESTION_BLOCK", 7)
    vec = F.expr("CASE WHEN id = 3 THEN NULL WHEN id = 9 THEN array(1.0D) ELSE array(sin(id % 90), cos(id % 31), (id % 7) / 7.0D) END")
    c = spark.range(200).select(F.col("id").alias("c_id"), vec.alias("c_vec"))
    q = c.filter("c_id % 10 < 2 OR c_id IN (3, 9)").select(F.col("c_id").alias("q_id"), F.col("c_vec").alias("q_vec"))
    every = q.crossJoin(c).select("q_id", "c_id", F.round(cosine_distance(F.col("q_vec"), F.col("c_vec")), 6).alias("distance"))
    want = every.selectExpr("*", "row_number() OVER (PARTITION BY q_id ORDER BY distance, c_id) AS rank").filter("rank <= 5")
    assert pairs(T.nearest(q, c, 5).select("q_id", "c_id", "distance", "rank")) == pairs(want)


def test_nearest_takes_many_questions(spark):
    from loomgraph.operators import retrieval as T

    q = spark.range(10_001).selectExpr("id AS q_id", "array(cos(id), sin(id)) AS q_vec")
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "c_id bigint, c_vec array<double>")
    found = T.nearest(q, c, 1).agg(F.count("*"), F.sum(((F.col("c_id") == 1) != (F.cos("q_id") > 0)).cast("int")))
    assert tuple(found.first()) == (10_001, 0)


def test_lookup_pairs_are_not_shuffled(spark, monkeypatch):
    from loomgraph.operators import retrieval as T

    monkeypatch.setattr(T, "NAME_BLOCK", 3)
    q = spark.createDataFrame([(1, "run alpha and beta"), (1, "run alpha"), (2, "Alpha gamma"), (3, None)], "q_id int, question string")
    s = spark.createDataFrame([(i, "alpha") for i in range(10)] + [(3, "beta"), (3, "beta"), (4, "gamma"), (5, None)], "symbol_id int, name string")
    found = [tuple(r) for r in T.symbol_lookup(q, s).collect()]
    assert sorted(found) == sorted([(1, i) for i in range(10)] + [(2, 4)])
    plan = T.symbol_lookup(q, s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")  # nothing stands over all pairs


def test_parsing_is_dealt_over_tasks(spark, monkeypatch):
    from loomgraph.sources import code as C

    monkeypatch.setattr(C, "TASK_CHARS", 400)
    files = spark.createDataFrame([(f"m{i}.py", f"def f{i}():\n    g()\n") for i in range(200)], "path string, content string").coalesce(1)
    symbols, calls = C.parse_python(files), C.extract_calls(files)
    assert symbols.rdd.getNumPartitions() > 5 and calls.rdd.getNumPartitions() > 5
    assert pairs(symbols.select("path", "name")) == {(f"m{i}.py", f"f{i}") for i in range(200)}
    assert pairs(calls.select("path", "caller", "callee")) == {(f"m{i}.py", f"f{i}", "g") for i in range(200)}


def test_chunks_parse_files_once(spark):
    from loomgraph.sources import code as C
    from loomgraph.sources import documents as P

    files = spark.createDataFrame([("a.py", "import os\n\ndef f():\n    return 1\n"), ("b.py", None), ("c.py", "x = 1\n")], "path string, content string")
    chunks = P.code_chunks(files, C.parse_python(files))
    assert pairs(chunks.select("path", "chunk_type", "name")) == {("a.py", "parent", "f"), ("a.py", "child", "f"), ("a.py", "leftover", None), ("c.py", "leftover", None)}
    assert "MapInPandas" not in chunks._jdf.queryExecution().executedPlan().toString()


def test_imports_are_resolved_once_each(spark):
    from loomgraph.sources.code import resolve_imports

    files = spark.createDataFrame([(f"a/m{i}.py",) for i in range(20)] + [("lib/os.py",)], "path string")
    imports = spark.createDataFrame([(f"a/m{i}.py", r, "python") for i in range(20) for r in ("os", "none", ".m1", ".m1")] + [("a/x.py", None, "python")], "path string, raw string, language string")
    found = resolve_imports(imports, files)
    assert found.count() == 81 and pairs(found) == {(f"a/m{i}.py", r, t) for i in range(20) for r, t in (("os", "lib/os.py"), ("none", None), (".m1", "a/m1.py"))} | {("a/x.py", None, None)}
    assert "Aggregate [target" in found._jdf.queryExecution().optimizedPlan().toString()


def _packed(items, budget, most):
    out, b, used, n = [], 1, 0, 0
    for i, c in items:
        if n and (used + c > budget or n >= most):
            b, used, n = b + 1, 0, 0
        used, n = used + c, n + 1
        out.append((i, b))
    return out


@pytest.mark.parametrize("block", [1, 7, 512])
def test_packing_over_blocks(spark, monkeypatch, block):
    import random

    from loomgraph.operators import windows as N

    monkeypatch.setattr(N, "BLOCK", block)
    r = random.Random(3)
    groups = {g: [(i, r.choice((0, 1, 10, 40, 101, 300))) for i in range(n)] for g, n in (("a", 200), ("b", 1), (None, 63), ("c", 14))}
    items = spark.createDataFrame([(g, i, c) for g, rows in groups.items() for i, c in rows], "g string, item bigint, cost bigint")
    want = {(g, *x) for g, rows in groups.items() for x in _packed(rows, 100, 5)}
    assert pairs(N.pack_batches(items, "g", "cost", 100, 5, "item").select("g", "item", "batch")) == want


def test_no_group_is_packed_as_one_list(spark, monkeypatch):
    from loomgraph.operators import batching as B
    from loomgraph.operators import windows as N

    monkeypatch.setattr(N, "BLOCK", 8)
    lists, whole = [], N.cut
    monkeypatch.setattr(N, "cut", lambda df, name: lists.append(whole(df, name)) or lists[-1])
    items = spark.range(300).selectExpr("'a' AS g", "id AS item", "id % 7 AS cost")
    assert N.pack_batches(items, "g", "cost", 100, 5, "item").count() == 300
    files = spark.range(300).selectExpr("id AS ordinal", "concat('src/m', id, '.py') AS path")
    assert B.review_batches(files).groupBy("batch").count().filter("count <> 5").isEmpty()
    assert len(lists) == 2 and all(t.agg(F.max(F.size("rows"))).first()[0] == 8 for t in lists)


def _distances(edges):
    out = {}
    for root in {x for e in edges for x in e}:
        front, d = {root}, 0
        while front:
            d += 1
            front = {b for a, b in edges if a in front} - {n for r, n in out if r == root} - {root}
            out |= {(root, n): d for n in front}
    return {(r, n, d) for (r, n), d in out.items()}


def test_walks_and_groups_on_random_graphs(spark, edges):
    import random

    from loomgraph.operators import graph as G

    r = random.Random(5)
    some = sorted({(f"v{r.randrange(9):02}", f"v{r.randrange(9):02}") for _ in range(14)} | {("c00", "c01"), ("c01", "c02"), ("c02", "c03"), ("c03", "c00"), ("c03", "v01")})
    want = _distances(some)
    assert pairs(G.reach(edges(some), reverse=False)) == want
    assert pairs(G.reach(edges(some), depth=3, reverse=False)) == {x for x in want if x[2] <= 3}
    starts = {("g0", "c03"), ("g0", "v07"), ("g1", "v01"), ("g1", "c00")}
    least = {}
    for g, s in starts:
        for root, n, d in want:
            if root == s and (g, n) not in starts:
                least[g, n] = min(d, least.get((g, n), d))
    found = G.reach_of_groups(edges(some), spark.createDataFrame(sorted(starts), "root string, node string"), reverse=False)
    assert pairs(found) == {(g, n, d) for (g, n), d in least.items()}
    dist = {(a, b): d for a, b, d in want}
    sigma = {}
    for (a, b), d in sorted(dist.items(), key=lambda x: x[1]):
        sigma[a, b] = 1 if d == 1 else sum(sigma[a, p] for p, q in some if q == b and p != b and dist.get((a, p)) == d - 1)
    b = {}
    for (s, v), d1 in dist.items():
        for (w, t), d2 in dist.items():
            if w == v and t != s and dist.get((s, t)) == d1 + d2:
                b[v] = b.get(v, 0) + sigma[s, v] * sigma[v, t] / sigma[s, t]
    got = {x.id: round(x.betweenness, 6) for x in G.betweenness(edges(some)).collect()}
    assert got == {v: round(b.get(v, 0), 6) for v in {x for e in some for x in e}}


def test_seen_pairs_are_not_met_every_round(edges, monkeypatch):
    from loomgraph.operators import graph as G

    made, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df, name: made.append(name) or cut(df, name))
    assert G.reach(edges([(f"{i:02}", f"{i + 1:02}") for i in range(13)])).count() == 91
    assert made.count("seen") <= 5 < made.count("front")


def test_position_does_not_shuffle_again(spark):
    """Places come from the range partitions as they stand, several of them, ties and all."""
    from loomgraph.operators.windows import position

    df = spark.range(5000).selectExpr("id * 7919 % 1000 AS a", "id AS b").repartition(5)
    out = position(df, F.desc("a"), F.asc("b"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(_p") <= 1 and "SortMergeJoin" not in plan  # that one counts the partitions' rows
    got = [(r.a, r.b) for r in sorted(out.collect(), key=lambda r: r.position)]
    assert got == sorted(((r.a, r.b) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert position(df.filter("a < 0"), F.asc("a")).count() == 0


def test_symbol_lookup_repeats_short_lists_of_symbols(spark):
    """Pairs of a question came with up to 10,000 symbols at a time, and blocks in turn, so that written pairs grew with their number."""
    from itertools import groupby

    from loomgraph.operators.retrieval import symbol_lookup

    questions = spark.createDataFrame([(q, "the parser") for q in range(20)], "q_id bigint, question string")
    symbols = spark.range(20_000).selectExpr("id AS symbol_id", "'parser' AS name")
    rows = [(r[0], r[1], r[2]) for r in symbol_lookup(questions, symbols).selectExpr("spark_partition_id()", "q_id", "symbol_id").collect()]
    lists = [tuple(x[2] for x in g) for _, g in groupby(rows, key=lambda r: r[:2])]
    assert len(set(rows)) == 400_000 and len({(q, s) for _, q, s in rows}) == 400_000
    assert max(map(len, lists)) < 2_048 and len(set(lists)) == len(lists) / 20 and sum(a == b for a, b in zip(lists, lists[1:])) >= len(lists) * 0.9


def test_betweenness_holds_no_row_for_each_pair(spark, monkeypatch):
    """Every reachable pair was a row, shuffled and written several times."""
    import random

    from loomgraph.operators import graph as G
    from loomgraph.storage import cut

    rows = []
    monkeypatch.setattr(G, "cut", lambda df, name="t": (made := cut(df, name), rows.append(made.count()))[0])
    tree = spark.range(2, 2_000).selectExpr("id AS src", "id div 2 AS dst")  # 15,964 pairs
    got = {r[0]: r[1] for r in G.betweenness(tree).collect()}
    below = {k: sum(k << d <= i < (k + 1) << d for d in range(1, 12) for i in range(k << d, min((k + 1) << d, 2_000))) for k in (1, 2, 7, 999)}
    assert {k: got[k] for k in below} == {k: below[k] * (k.bit_length() - 1) for k in below} and max(rows) < 5_000

    random.seed(3)
    pairs = {(random.randrange(30), random.randrange(30)) for _ in range(70)}
    want = dict.fromkeys({x for p in pairs for x in p}, 0.0)
    for root in want:
        depth, sigma, order = {root: 0}, {root: 1}, [root]
        for v in order:
            for a, b in pairs:
                if a == v and b not in depth:
                    depth[b], sigma[b] = depth[v] + 1, 0
                    order.append(b)
                if a == v and depth[b] == depth[v] + 1:
                    sigma[b] += sigma[v]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for a, b in pairs:
                if b == w and depth.get(a) == depth[w] - 1:
                    delta[a] += sigma[a] / sigma[w] * (1 + delta[w])
            want[w] += delta[w] if w != root else 0
    edges = spark.createDataFrame(sorted(pairs), "src bigint, dst bigint")
    for most in (500_000, 20, 0):  # all blocks whole, some, none
        monkeypatch.setattr(G, "BLOCK_ROOTS", 7)
        monkeypatch.setattr(G, "MOST_EDGES", most)
        got = {r[0]: r[1] for r in G.betweenness(edges).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
