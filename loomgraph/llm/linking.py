"""Sets that overlap enough, linked into classes without ever listing all pairs.

Shared by the n-gram join and by substring dedup. Given rows (key, salt, item, size, pos)
that say which items a key brings together, and a sketch of each item's set:

1. keys are dealt and sorted; a task streams each key's items in order of size, drops
   those without a partner that length and position allow, and emits what is left as a
   list; equal lists, which near copies make by the dozen, stay one. The items of a hot
   key (more than two blocks of them, or one dealt over several tasks by its salt) become
   a star instead: one row each;
2. lists meet the items' sketches; within a list, pairs whose sketches differ in more
   bits than the threshold lets the sets differ in fall (the suffix filter's lower
   bound); of the rest a spanning forest is emitted. Stars go into it as they are. No
   linked pair is lost: its two sets are in one component of what remains;
3. components too large for a block go through these steps again by themselves, in the
   order of their own counts: a key that all of a component's sets have is its commonest,
   so no set of more than a few shingles has it among its first any more, and sets that
   nothing but a hot key held together fall apart without being compared;
4. components are verified. Each one's sets are dealt into blocks, all pairs of a block
   and all pairs with a few hubs of the component are compared exactly, and a forest of
   true links is emitted. Components of several blocks are then dealt again by the classes
   found so far and by size: blocks meet blocks, but neither those of one class nor those
   too different in size, so near copies by the thousand cost no pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.components import components, stars
from loomgraph.llm.counts import count_table, rare_first, set_counts
from loomgraph.llm.memory import released
from loomgraph.llm.shingles import fold
from loomgraph.storage import cut, drop

#: sets of a block; shingles that a block should have; hubs of a component of several blocks; rows of a key that one task takes
BLOCK, BLOCK_SHINGLES, HUBS, HEAVY = 512, 2_000_000, 4, 200_000


def overlap_needed(a, b, num: int, den: int):
    """Smallest intersection of sets of a and b members with den * intersection >= num * union (ceil of num*(a+b)/(num+den))."""
    return -(-num * (a + b) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    """Members of a set of n, in a fixed order of all, of which two linked sets must share one."""
    return n - -(-num * n // den) + 1 if n else 0


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [n]])


def _partners(size: np.ndarray, pos: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows of a key, in order of size, have another that length and position allow."""
    n = len(size)
    keep = np.zeros(n, bool)
    hi = np.searchsorted(size, size * den // num, side="right")
    for i in range(n - 1):
        j = np.arange(i + 1, hi[i])
        if len(j):
            ok = 1 + np.minimum(size[i] - pos[i] - 1, size[j] - pos[j] - 1) >= overlap_needed(size[i], size[j], num, den)
            if ok.any():
                keep[i] = True
                keep[j[ok]] = True
    return keep


def _stream(frames, columns: list[str], handle, most: int | None = None, keys: int = 1):
    """Calls ``handle`` for each run of equal first ``keys`` columns in sorted frames; a run may span frames, but is cut at ``most`` rows or more."""
    held: list[pd.DataFrame] = []

    def call(parts: list[pd.DataFrame]) -> None:
        whole = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        handle(*(whole[c].to_numpy() for c in columns))

    for pdf in frames:
        if not len(pdf):
            continue
        if held and any(held[-1][c].iat[-1] != pdf[c].iat[0] for c in columns[:keys]):
            call(held)
            held = []
        bounds = _runs(*(pdf[c].to_numpy() for c in columns[:keys]))
        if len(bounds) == 2:
            held.append(pdf)
        else:
            first, *_ = bounds[1:]
            call([*held, pdf.iloc[:first]])
            arrays = [pdf[c].to_numpy() for c in columns]
            for a, b in zip(bounds[1:-2], bounds[2:-1]):
                if b - a > 1:
                    handle(*(x[a:b] for x in arrays))
            held = [pdf.iloc[bounds[-2] :]]
        if most and sum(map(len, held)) >= most:
            call(held)
            held = []
        yield
    if held:
        call(held)
    yield


def _none(n: int) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.zeros(n, np.int64), np.ones(n, bool))


LISTS = "list bigint, item bigint, hub bigint, key bigint"


def _lists(num: int, den: int, block: int, most: int = HEAVY):
    """Lists (list, item), and the stars of hot keys (key, item, hub). A key of over ``most`` rows is taken in parts, which are stars."""

    def run(frames):
        lists, hot, seen, parts = [], [], set(), [None]

        def put(items: np.ndarray) -> None:
            items = np.unique(items)
            name = hash(items.tobytes()) & 0x7FFFFFFFFFFFFFFF
            if name not in seen:
                seen.add(name)
                lists.append((np.full(len(items), name, np.int64), items))

        def star(key: int, items: np.ndarray) -> None:
            hot.append((np.full(len(items), key, np.int64), items, np.full(len(items), items[0], np.int64)))

        def handle(key, salt, item, size, pos):
            part = len(key) >= most or parts[0] == (key[0], salt[0])
            parts[0] = (key[0], salt[0]) if len(key) >= most else None
            if len(item) == 2 and not salt[0] and not part:
                if item[0] != item[1] and 1 + min(size[0] - pos[0], size[1] - pos[1]) - 1 >= overlap_needed(int(size[0]), int(size[1]), num, den) and size[0] * den >= size[1] * num:
                    put(item)
                return
            if len(item) < 2 and not salt[0] and not part:
                return
            first = np.sort(np.unique(item, return_index=True)[1])
            item, size, pos = item[first], size[first], pos[first]
            if salt[0] or part or len(item) > 2 * block:
                star(key[0], item)
                return
            keep = _partners(size, pos, num, den)
            if keep.sum() > 1:
                put(item[keep])

        def drain():
            if len(seen) > 200_000:
                seen.clear()
            if lists:
                name, item = (np.concatenate(x) for x in zip(*lists))
                lists.clear()
                yield pd.DataFrame({"list": name, "item": item, "hub": _none(len(item)), "key": _none(len(item))})
            if hot:
                key, item, hub = (np.concatenate(x) for x in zip(*hot))
                hot.clear()
                yield pd.DataFrame({"list": _none(len(item)), "item": item, "hub": hub, "key": key})

        for _ in _stream(frames, ["key", "salt", "item", "size", "pos"], handle, most, 2):
            yield from drain()

    return run


def _hamming(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows ^ one).sum(axis=-1, dtype=np.int64)


def _words(sketches) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in sketches]


class _Near:
    """For items in order of size: those behind the i-th that length and sketch don't rule out."""

    def __init__(self, size: np.ndarray, sketches, num: int, den: int):
        self.size, self.num, self.den = size, num, den
        words = _words(sketches)
        self.width = np.array([len(w) for w in words])
        self.folded = {}
        for w in np.unique(self.width):
            at = np.flatnonzero(self.width >= w)
            self.folded[w] = (at, np.stack([fold(words[i], w) for i in at]))
        self.hi = np.searchsorted(size, size * den // num, side="right")

    def behind(self, i: int) -> np.ndarray:
        at, rows = self.folded[self.width[i]]
        a, b = np.searchsorted(at, [i + 1, self.hi[i]])
        if a == b:
            return at[:0]
        total = self.size[i] + self.size[at[a:b]]
        most = total - 2 * overlap_needed(self.size[i], self.size[at[a:b]], self.num, self.den)
        own = rows[np.searchsorted(at, i)]
        return at[a:b][_hamming(rows[a:b], own) <= most]


def _filter(num: int, den: int):
    def run(frames):
        out = []

        def handle(_, node, size, sketch):
            first = np.sort(np.unique(node, return_index=True)[1])
            if len(first) < 2:
                return
            node, size, sketch = node[first], size[first].astype(np.int64), sketch[first]
            near = _Near(size, sketch, num, den)
            a, b = [], []
            for i in range(len(node) - 1):
                j = near.behind(i)
                if len(j):
                    a.append(np.full(len(j), i))
                    b.append(j)
            if a:
                out.append(stars(node[np.concatenate(a)], node[np.concatenate(b)]))

        for _ in _stream(frames, ["list", "node", "size", "sketch"], handle):
            if out:
                a, b = zip(*out)
                out.clear()
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


def _verify(num: int, den: int):
    """Forest of the true links of a group (node, class, side, shingles): of nodes of side 0 with all, else of nodes of different sides; never within a class."""
    from loomgraph.llm.shingles import parity

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        size = np.array([len(s) for s in sets], np.int64)
        order = np.lexsort((pdf["node"].to_numpy(), size))
        sets, size = [sets[k] for k in order], size[order]
        node, side = pdf["node"].to_numpy()[order], pdf["side"].to_numpy()[order]
        near = _Near(size, [parity(s) for s in sets], num, den)
        group, edges = np.unique(pdf["class"].to_numpy()[order], return_inverse=True)[1], []
        for i in range(len(node) - 1):
            j = near.behind(i)
            j = j[(group[j] != group[i]) & ((side[j] != side[i]) | (side[j] == 0))]
            for k in range(0, len(j), 64):
                part = j[k : k + 64]
                part = part[group[part] != group[i]]
                if not len(part):
                    continue
                ends = np.cumsum([len(sets[x]) for x in part])
                flat = np.concatenate([sets[x] for x in part])
                at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
                common = np.diff(np.concatenate([[0], np.cumsum(sets[i][at] == flat)[ends - 1]]))
                for x in part[common >= overlap_needed(size[i], size[part], num, den)]:
                    if group[x] != group[i]:
                        edges.append((node[i], node[x]))
                        group[group == group[x]] = group[i]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


EDGE = "a bigint, b bigint"


def salted(keys: DataFrame, most: int = HEAVY) -> DataFrame:
    """``keys`` (key, item, ...) with a salt: 0, or for keys of over ``most`` rows one of as many as give each about that many."""
    heavy = cut(keys.groupBy("key").count().filter(F.col("count") > most).select("key", F.ceil(F.col("count") / most).alias("n")), "heavy")
    if heavy.isEmpty():
        return keys.withColumn("salt", F.lit(0))
    return keys.join(heavy, "key", "left").withColumn("salt", F.coalesce(1 + F.pmod(F.xxhash64("item"), "n"), F.lit(0)).cast("int")).drop("n")


def _candidates(keys: DataFrame, sketches: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(vertex, component) of what keys bring together and the cheap filters leave."""
    dealt = keys.select("key", "salt", "item", "size", "pos").repartition("key", "salt").sortWithinPartitions("key", "salt", "size", "item")
    lists = cut(dealt.mapInPandas(released(_lists(num, den, block)), LISTS), "lists")
    met = lists.filter("list IS NOT NULL").select("list", "item").distinct().join(sketches, "item").select("list", "node", "size", "sketch")
    edges = met.repartition("list").sortWithinPartitions("list", "size", "node").mapInPandas(released(_filter(num, den)), EDGE)
    hot = lists.filter("key IS NOT NULL")
    if not hot.isEmpty():
        # the parts of a key have a hub each; hubs hang together by the least of the key's
        hubs = hot.select("key", "hub").distinct()
        top = hubs.groupBy("key").agg(F.min("hub").alias("top"))
        pairs = hot.select(F.col("item").alias("x"), F.col("hub").alias("y")).unionByName(hubs.join(top, "key").select(F.col("hub").alias("x"), F.col("top").alias("y"))).filter("x <> y").distinct()
        ids = sketches.select("item", "node")
        pairs = pairs.join(ids.select(F.col("item").alias("x"), F.col("node").alias("a")), "x").join(ids.select(F.col("item").alias("y"), F.col("node").alias("b")), "y")
        edges = edges.unionByName(pairs.select("a", "b"))
    out = components(edges)
    drop(lists)
    return out


def _own_keys(num: int, den: int, shared):
    """Prefixes of sets (node, shingles) in the order of their own count table."""

    def run(frames):
        for pdf in frames:
            keys, items, sizes, at = [], [], [], []
            for node, shingles in zip(pdf["node"], pdf["shingles"]):
                s = np.frombuffer(shingles, np.uint64)
                p = prefix_length(len(s), num, den)
                keys.append(rare_first(s, shared.value)[:p].view(np.int64))
                items.append(np.full(p, node, np.int64))
                sizes.append(np.full(p, len(s), np.int32))
                at.append(np.arange(p, dtype=np.int32))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "item": np.concatenate(items), "size": np.concatenate(sizes), "pos": np.concatenate(at)})

    return run


def _apart(maybe: DataFrame, room: DataFrame, full: DataFrame, sketches: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """``maybe`` (node, component, size) with the components of several blocks found anew by their own counts; nodes without a candidate left go."""
    many = room.filter("blocks > 1").select("component")
    wide = cut(full.join(maybe.join(many, "component", "left_semi").select("node"), "node"), "wide")
    shared = wide.sparkSession.sparkContext.broadcast(count_table(wide.select("shingles").mapInPandas(released(set_counts), "part int, salt int, counts binary")))
    keys = wide.mapInPandas(released(_own_keys(num, den, shared)), "key bigint, item bigint, size int, pos int")
    own = sketches.join(wide.select("node"), "node", "left_semi").select(F.col("node").alias("item"), "node", "size", "sketch")
    found = _candidates(salted(keys), own, num, den, block)
    small = maybe.join(many, "component", "left_anti").select("node", "component", "size")
    anew = found.withColumnRenamed("vertex", "node").join(maybe.select("node", "size"), "node").select("node", "component", "size")
    # components are named by their smallest node, so those found anew and those that stay can't share a name
    out = cut(small.unionByName(anew), "maybe")
    drop(wide)
    return out


def _room(maybe: DataFrame, block: int) -> DataFrame:
    """(component, blocks) of candidates."""
    return cut(maybe.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "room")


def link(keys: DataFrame, sketches: DataFrame, sets, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """(vertex, component) of every node that is linked with another.

    ``keys``: (key, salt, item, size, pos), bigint, int, bigint, int, int; ``sketches``:
    (item, node, size, sketch), one row a node; ``sets``: takes rows (node) and returns
    (node, shingles), the sorted 64-bit hashes of the node's set. Two nodes link when
    den * intersection >= num * union.
    """
    found = _candidates(keys, sketches, num, den, block)
    maybe = cut(found.join(sketches.select(F.col("node").alias("vertex"), "size"), "vertex").withColumnRenamed("vertex", "node"), "maybe")
    room = _room(maybe, block)
    full = cut(sets(maybe.select("node")).select("node", "shingles"), "sets")
    if not room.filter("blocks > 1").isEmpty():
        before = maybe, room
        maybe = _apart(maybe, room, full, sketches, num, den, block)
        room = _room(maybe, block)
        drop(*before)

    placed = maybe.join(room, "component").select("component", "node", "blocks")
    own = placed.select("node", "component", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("b"))
    first = placed.filter("blocks > 1").groupBy("component", "blocks").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("node", F.lit(1)), F.greatest((F.col("blocks") * block / 64).cast("bigint"), F.lit(1))) == 0, F.col("node")))), 1, HUBS).alias("h"))
    hubs = first.select("component", "blocks", F.explode("h").alias("node")).select("node", "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    dealt = own.unionByName(hubs).distinct().join(full, "node").select("component", "b", "node", F.col("node").alias("class"), F.lit(0).alias("side"), "shingles")
    true = cut(dealt.groupBy("component", "b").applyInPandas(_verify(num, den), EDGE), "true")
    many = room.filter("blocks > 1")
    if many.isEmpty():
        out = components(true)
        drop(maybe, room, full, true)
        return out

    # components of several blocks, by the classes so far: bands of size, and parts of a block's size in them
    wide = maybe.join(many.select("component"), "component", "left_semi")
    so_far = components(true.join(wide.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b"))
    band = F.floor(F.log(F.col("size").cast("double")) / (math.log(den / num) * 1.000001)).cast("int")  # linked sets are of one band or two next to each other
    units = wide.join(so_far.select(F.col("vertex").alias("node"), F.col("component").alias("class")), "node", "left").select("node", "component", "size", F.coalesce("class", "node").alias("class"), band.alias("band"))
    big = units.groupBy("component", "band", "class").count().filter(F.col("count") >= max(2, block // 2)).select("component", "band", "class", F.lit(True).alias("big"))
    units = cut(units.join(big, ["component", "band", "class"], "left").withColumn("g", F.when(F.col("big"), F.col("class"))).drop("big"), "units")
    parts = units.groupBy("component", "band", "g").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("parts"))
    uid = F.xxhash64("component", "band", F.col("g").isNull(), "g", F.pmod(F.xxhash64("node", F.lit(2)), "parts"))
    units = cut(units.alias("u").join(parts.alias("p"), (F.col("u.component") == F.col("p.component")) & (F.col("u.band") == F.col("p.band")) & F.col("u.g").eqNullSafe(F.col("p.g"))).select("u.component", "u.band", "u.g", "node", "class", "parts").select("component", "band", "g", "node", "class", uid.alias("uid")), "blocks")
    each = units.select("component", "band", "g", "uid").distinct()
    x = each.select("component", "band", F.col("g").alias("gx"), F.col("uid").alias("ux"), F.explode(F.array("band", F.col("band") + 1)).alias("met"))
    y = each.select("component", F.col("band").alias("met"), F.col("g").alias("gy"), F.col("uid").alias("uy"))
    apart = ~F.coalesce(F.col("gx") == F.col("gy"), F.lit(False))
    meets = cut(x.join(y, ["component", "met"]).filter(((F.col("band") < F.col("met")) | (F.col("ux") <= F.col("uy"))) & apart).select("ux", "uy"), "meets")
    left = meets.join(units, F.col("ux") == F.col("uid")).select("ux", "uy", "node", "class", F.when(F.col("ux") == F.col("uy"), 0).otherwise(1).alias("side"))
    right = meets.filter("ux <> uy").join(units, F.col("uy") == F.col("uid")).select("ux", "uy", "node", "class", F.lit(2).alias("side"))
    again = left.unionByName(right).join(full, "node").groupBy("ux", "uy").applyInPandas(_verify(num, den), EDGE)
    out = components(true.unionByName(cut(again, "true")))
    drop(maybe, room, full, units, meets)
    return out
