"""Graph operators over edges (src, dst): bounded reach, levels, components, ranks, paths.

Loops are driver loops over DataFrames; each round is cut through the shared folder, so
neither lineage nor a lost executor makes a later round repeat an earlier one.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.functions.expressions import risk_level
from loomgraph.storage import cut, drop


def _large(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffles: a table that grows with the graph would, while it is under Spark's limit, be broadcast in every round, through the driver."""
    return df.hint("merge")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def reach(edges: DataFrame, roots: DataFrame | None = None, depth: int | None = None, reverse: bool = True) -> DataFrame:
    """(root, node, depth) for all nodes that each root reaches, itself left out; with ``depth``, within as many steps.

    Reversed edges lead from a file to those that depend on it. Rounds go on until one has
    no new pairs. Without ``roots`` every vertex is one.
    """
    front = (vertices(edges) if roots is None else roots.select("id")).select(F.col("id").alias("root"), F.col("id").alias("node"))
    return _walk(_step(edges, reverse), front, depth).select("root", "node", "depth")


def reach_of_groups(edges: DataFrame, starts: DataFrame, depth: int | None = None, reverse: bool = True) -> DataFrame:
    """(root, node, depth) as ``reach``, for groups (root) of starts (root, node): the least depth from any start of a group, its starts left out."""
    return _walk(_step(edges, reverse), cut(starts.select("root", "node").distinct(), "front"), depth, groups=True).select("root", "node", "depth")


def _step(edges: DataFrame, reverse: bool) -> DataFrame:
    step = edges.select(F.col("dst" if reverse else "src").alias("at"), F.col("src" if reverse else "dst").alias("to")).distinct()
    return cut(step.filter("at <> to"), "step")


def _walk(step: DataFrame, front: DataFrame, depth: int | None = None, groups: bool = False, paths: bool = False) -> DataFrame:
    """(root, node, depth): least depths of all that the pairs in ``front`` lead to; with ``paths``, sigma too, how many shortest paths lead there.

    What earlier rounds have is taken out at rounds 1, 2, 4, 8 and so on, not at each, since
    every time all of it is shuffled. In between, a round walks on from pairs of its own
    depth, also those that a shorter path has met; what they lead to has a shorter path too,
    and goes at the next of these rounds with them.
    """
    seen, pending, out = front if groups else None, [], None
    more = ["sigma"] if paths else []
    front = front.withColumn("sigma", F.lit(1.0)) if paths else front
    for d in itertools.count(1):
        met = front.join(step, front["node"] == step["at"]).select("root", F.col("to").alias("node"), *more)
        met = met.groupBy("root", "node").agg(F.sum("sigma").alias("sigma")) if paths else met.distinct()
        met = met if groups else met.filter("root <> node")
        front = cut(met.select("root", "node", *more, F.lit(d).alias("depth")), "front")
        pending.append(front)
        last = d == depth or front.isEmpty()
        if not last and d & (d - 1):
            continue
        new = functools.reduce(DataFrame.unionByName, pending)
        if len(pending) > 1:
            new = new.groupBy("root", "node").agg(F.min(F.struct("depth", *more)).alias("m")).select("root", "node", "m.*")
        if seen is not None:
            new = new.join(seen, ["root", "node"], "left_anti")
        fresh = cut(new.select("root", "node", *more, "depth"), "seen")
        drop(*pending)
        pending, front = [], fresh.filter(F.col("depth") == d)
        out = fresh if out is None else out.unionByName(fresh)
        seen = fresh.select("root", "node") if seen is None else seen.unionByName(fresh.select("root", "node"))
        if last or front.isEmpty():
            return out


def blast(edges: DataFrame, files: DataFrame, depth: int | None = None, total: int | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """(id, direct, transitive, affected, risk) of every file in ``files`` (id); files without dependents are low.

    ``hidden`` (id), tests and stories, are walked through but not counted.
    """
    total = files.count() if total is None else total
    met = reach(edges, depth=depth)
    if hidden is not None:
        met = met.join(hidden.select(F.col("id").alias("node")), "node", "left_anti")
    each = met.groupBy(F.col("root").alias("id")).agg(F.sum((F.col("depth") == 1).cast("int")).alias("direct"), F.sum((F.col("depth") > 1).cast("int")).alias("transitive"))
    out = files.select("id").join(each, "id", "left").na.fill(0, ["direct", "transitive"])
    out = out.withColumn("affected", F.col("direct") + F.col("transitive"))
    return out.withColumn("risk", risk_level(F.col("affected"), total))


def centrality(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, fan_in, fan_out, pagerank, betweenness) of every vertex, ranks rounded to six and four places."""
    from loomgraph.operators.relational import degrees

    out = degrees(edges).withColumnRenamed("node", "id").join(pagerank(edges, rounds), "id").join(betweenness(edges), "id")
    return out.select("id", "fan_in", "fan_out", F.round("rank", 6).alias("pagerank"), F.round("betweenness", 4).alias("betweenness"))


def top_central(scores: DataFrame, n: int = 10) -> DataFrame:
    """(measure, rank, id, value): the ``n`` highest by betweenness and by page rank, ids breaking ties."""
    out = None
    for m in ("betweenness", "pagerank"):
        top = scores.select("id", F.col(m).alias("value")).orderBy(F.desc("value"), "id").limit(n)  # n rows
        top = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("value"), "id"))).select(F.lit(m).alias("measure"), "rank", "id", "value")
        out = top if out is None else out.unionByName(top)
    return out


def focused(edges: DataFrame, n: int = 50) -> DataFrame:
    """Edges among the ``n`` vertices that most others point at and what these point at."""
    top = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "id").limit(n).select("id")
    near = edges.join(top.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    nodes = cut(top.unionByName(near).distinct(), "focus")
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def levels(edges: DataFrame) -> DataFrame:
    """(id, level) of a directed graph: the longest path that leads to a vertex; what cycles hold back has level -1.

    Each round peels the vertices without incoming edges; a long chain takes as many rounds as it is long.
    """
    left = cut(edges.filter("src <> dst").select("src", "dst").distinct(), "left")
    loops = edges.filter("src = dst").select(F.col("src").alias("id")).distinct()
    rest = cut(vertices(edges), "rest")
    out = None
    for level in itertools.count():
        free = rest.join(_large(left.select(F.col("dst").alias("id"))), "id", "left_anti").join(_large(loops), "id", "left_anti")
        free = cut(free.select("id", F.lit(level).alias("level")), "level")
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        done = free.select(F.col("id").alias("src"))
        new_left = cut(left.join(_large(done), "src", "left_anti").select("src", "dst"), "left")
        new_rest = cut(rest.join(_large(free.select("id")), "id", "left_anti"), "rest")
        drop(left, rest)
        left, rest = new_left, new_rest
    rest = rest.select("id", F.lit(-1).alias("level"))
    return rest if out is None else out.unionByName(rest)


def condensed_levels(edges: DataFrame) -> DataFrame:
    """(id, component, level) of every vertex of any graph: the longest path of strongly connected components that leads to its own.

    A component counts as one vertex, named by its smallest, so cycles hold nothing back;
    the members of a component share a level. Order by level, component and id reads every
    component after all that lead to it.
    """
    own = cut(vertices(edges).join(_large(scc(edges)), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "own")
    ends = [_large(own.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}"))) for x in ("src", "dst")]
    between = cut(edges.join(ends[0], "src").join(ends[1], "dst").filter("c_src <> c_dst").select(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct(), "between")
    met = levels(between).select(F.col("id").alias("component"), "level")
    return own.join(_large(met), "component", "left").select("id", "component", F.coalesce("level", F.lit(0)).alias("level"))


def is_dag(edges: DataFrame) -> bool:
    return levels(edges).filter("level < 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the undirected graph: smallest vertex; labels jump to their label's label each round."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = cut(both, "both")
    label = cut(vertices(edges).select("id", F.col("id").alias("c")), "label")
    while True:
        near = both.join(_large(label.select(F.col("id").alias("dst"), "c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("m"))
        low = label.join(_large(near), "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"))
        low = cut(low, "low")
        new = cut(low.join(_large(low.select(F.col("id").alias("c"), F.col("c").alias("cc"))), "c").select("id", F.least("c", "cc").alias("c")), "label")
        same = new.agg(F.sum(F.xxhash64("id", "c").cast("decimal(38,0)"))).first()[0] == label.agg(F.sum(F.xxhash64("id", "c").cast("decimal(38,0)"))).first()[0]
        drop(label, low)
        label = new
        if same:
            return label.select("id", F.col("c").alias("component"))


def _colours(edges: DataFrame) -> DataFrame:
    """(id, c) of every vertex: the smallest one that leads to it, or itself; labels jump to their label's label each round."""
    label = cut(vertices(edges).select("id", F.col("id").alias("c")), "label")
    while True:
        near = edges.join(_large(label.select(F.col("id").alias("src"), "c")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
        low = cut(label.join(_large(near), "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), F.coalesce(F.col("m") < F.col("c"), F.lit(False)).alias("moved")), "low")
        if low.filter("moved").isEmpty():
            drop(low)
            return label
        new = cut(low.join(_large(low.select(F.col("id").alias("c"), F.col("c").alias("cc"))), "c").select("id", F.least("c", "cc").alias("c")), "label")
        drop(label, low)
        label = new


def scc(edges: DataFrame) -> DataFrame:
    """(id, component) of strongly connected components of two or more vertices, named by their smallest.

    Vertices that no cycle can hold are peeled off from both sides. Each other one is
    coloured by the smallest that leads to it; those that lead back to it within the
    colour are its component. Edges between what is left of a colour go on, until none are.
    """
    core = cut(edges.filter("src <> dst").select("src", "dst").distinct(), "core")
    out = None
    while not core.isEmpty():
        n = core.count()
        kept = cut(core.join(_large(core.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(_large(core.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst"), "core")
        drop(core)
        core = kept
        if core.count() < n:
            continue
        colour = _colours(core)
        ends = [_large(colour.select(F.col("id").alias(x), F.col("c").alias(f"c_{x}"))) for x in ("src", "dst")]
        inside = cut(core.join(ends[0], "src").join(ends[1], "dst").filter("c_src = c_dst").select("src", "dst", F.col("c_src").alias("c")), "inside")
        back = _colours(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = cut(back.withColumnRenamed("c", "component").join(_large(colour), "id").filter("component = c").select("id", "component"), "found")
        out = found if out is None else out.unionByName(found)
        rest = inside.join(_large(found.select(F.col("id").alias("src"))), "src", "left_anti").join(_large(found.select(F.col("id").alias("dst"))), "dst", "left_anti")
        rest = cut(rest.select("src", "dst"), "core")
        drop(core, colour, inside, back)
        core = rest
    if out is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    return out.join(_large(out.filter("id <> component").select("component").distinct()), "component", "left_semi").select("id", "component")


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank) after ``rounds`` of power iteration; ranks sum to 1, dangling mass is dealt evenly."""
    e = cut(edges.select("src", "dst").distinct(), "edges")
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    base = cut(vertices(e).join(out, "id", "left"), "vertices")
    n = base.count()
    rank = base.select("id", "deg", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        dangling = rank.filter("deg IS NULL").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d"))
        given = e.join(rank.filter("deg IS NOT NULL").select(F.col("id").alias("src"), (F.col("rank") / F.col("deg")).alias("share")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        rank = base.join(given, "id", "left").crossJoin(F.broadcast(dangling)).select("id", "deg", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("d") / n)).alias("rank"))
        rank = cut(rank, "rank")
    return rank.select("id", "rank")


#: roots, consecutive by id, whose walks one task follows; edges of a task's part of the graph at most; cells of its tables of roots by vertices
BLOCK_ROOTS, MOST_EDGES, CELLS = 2_000, 500_000, 2_000_000


def betweenness(edges: DataFrame) -> DataFrame:
    """(id, betweenness), directed and not normalized: Brandes' sums over all sources.

    Blocks of roots are walked as groups, so rows are of blocks and vertices, not of reachable
    pairs; a task gets the edges that its block reaches, and sums up its roots' pairs. Blocks
    that reach too many edges for a task go on pair by pair, as rows. Both go on until no path is new.
    """
    from loomgraph.operators.windows import numbered

    step = cut(edges.filter("src <> dst").select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct(), "step")
    ids = numbered(vertices(edges).repartitionByRange("id").sortWithinPartitions("id"))
    ids = cut(ids.select(F.floor((F.col("position") - 1) / BLOCK_ROOTS).alias("root"), F.col("id").alias("node")), "roots")
    met = _walk(step, ids, groups=True).select("root", "node", F.lit(False).alias("start")).unionByName(ids.withColumn("start", F.lit(True)))
    parts = cut(met.join(step, F.col("node") == F.col("at")).select(F.col("root").alias("block"), "at", "to", "start"), "parts")
    wide = cut(parts.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_EDGES).select("block"), "wide")
    total = parts.join(wide, "block", "left_anti").groupBy("block").applyInPandas(_block_sums, f"id {edges.schema['src'].dataType.simpleString()}, delta double")
    if not wide.isEmpty():
        total = total.unionByName(_pair_sums(step, ids.join(wide.withColumnRenamed("block", "root"), "root", "left_semi").select("node")))
    return vertices(edges).join(total.groupBy("id").agg(F.sum("delta").alias("b")), "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def _block_sums(part: pd.DataFrame) -> pd.DataFrame:
    """(id, delta): Brandes' sums of a block's roots over the edges that they reach, a few roots by all vertices at a time."""
    ids, ends = np.unique(part[["at", "to"]].to_numpy().ravel(), return_inverse=True)
    ends, n = ends.reshape(-1, 2), len(ids)
    order = np.argsort(ends[:, 0], kind="stable")
    first, to = np.searchsorted(ends[order, 0], np.arange(n + 1)), ends[order, 1]
    roots, sums, most = np.unique(ends[part["start"].to_numpy(), 0]), np.zeros(n), max(1, CELLS // n)
    for k in range(0, len(roots), most):
        own = roots[k : k + most]
        own = own + np.arange(len(own)) * n  # a cell for each root and vertex
        sigma, delta, seen = np.zeros(len(own) * n), np.zeros(len(own) * n), np.zeros(len(own) * n, bool)
        sigma[own], seen[own], front, rounds = 1, True, own, []
        while len(front):
            node = front % n
            steps = first[node + 1] - first[node]
            place = np.arange(steps.sum()) + np.repeat(first[node] - np.cumsum(steps) + steps, steps)
            source, target = np.repeat(front, steps), np.repeat(front - node, steps) + to[place]
            new = ~seen[target]
            source, target = source[new], target[new]
            np.add.at(sigma, target, sigma[source])
            rounds.append((source, target))
            front = np.unique(target)
            seen[front] = True
        for source, target in reversed(rounds):
            np.add.at(delta, source, sigma[source] / sigma[target] * (1 + delta[target]))
        delta[own] = 0
        sums += delta.reshape(len(own), n).sum(axis=0)
    return pd.DataFrame({"id": ids[sums > 0], "delta": sums[sums > 0]})


def _pair_sums(step: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, delta) of some roots (node), with a row for each reachable pair, by depth."""
    pairs = _walk(step, roots.select(F.col("node").alias("root"), "node"), paths=True)
    deepest = pairs.agg(F.max("depth")).first()[0] or 0
    below, total = None, roots.select(F.col("node").alias("id"), F.lit(0.0).alias("delta"))
    for d in range(deepest, 0, -1):
        own = pairs.filter(F.col("depth") == d).select("root", "node", "sigma")
        if below is None:
            own = own.withColumn("delta", F.lit(0.0))
        else:
            up = below.select("root", F.col("node").alias("to"), ((1 + F.col("delta")) / F.col("sigma")).alias("w")).join(step, "to")
            up = up.groupBy("root", F.col("at").alias("node")).agg(F.sum("w").alias("w"))
            own = own.join(up, ["root", "node"], "left").select("root", "node", "sigma", F.coalesce(F.col("sigma") * F.col("w"), F.lit(0.0)).alias("delta"))
        below = cut(own, "delta")
        total = total.unionByName(below.select(F.col("node").alias("id"), "delta"))
    return total


def shortest_path(edges: DataFrame, start, goal) -> list:
    """One shortest path from ``start`` to ``goal``, its parents the smallest possible; empty if there is none.

    Rounds go on until the goal is met or nothing is new; the path comes back in one
    query a round from the goal's side, over the parents of that round alone.
    """
    step = cut(edges.filter("src <> dst").select("src", "dst").distinct(), "step")
    kind = edges.schema["src"].dataType.simpleString()
    front = cut(edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(None).cast(kind).alias("parent")), "front")
    fronts, seen = [front], front.select("node")
    while start != goal:
        new = front.join(step, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min("src").alias("parent"))
        front = cut(new.select(F.col("to").alias("node"), "parent").join(seen, "node", "left_anti"), "front")
        if front.isEmpty():
            return []
        fronts.append(front)
        seen = seen.unionByName(front.select("node"))
        if not front.filter(F.col("node") == goal).isEmpty():
            break
    path = [goal]
    for rows in reversed(fronts[1:]):
        path.append(rows.filter(F.col("node") == path[-1]).first()["parent"])
    return path[::-1]


def feedback_arcs(edges: DataFrame) -> DataFrame:
    """Edges whose removal leaves no cycle: within strongly connected components, those that don't go up in the order of names.

    A heuristic: the smallest such set is NP-hard to find. Self-loops belong to it.
    """
    inside = scc(edges)
    both = edges.select("src", "dst").distinct().join(_large(inside.select(F.col("id").alias("src"), F.col("component").alias("c1"))), "src").join(_large(inside.select(F.col("id").alias("dst"), F.col("component").alias("c2"))), "dst")
    back = both.filter("c1 = c2 AND src > dst").select("src", "dst")
    return back.unionByName(edges.filter("src = dst").select("src", "dst").distinct())


def neighbours(edges: DataFrame, node) -> DataFrame:
    """(direction, id) of a node's incoming and outgoing neighbours."""
    inc = edges.filter(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("id"))
    return inc.unionByName(edges.filter(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("id"))).distinct()
