"""The training-data operators on small fixtures, against brute force, and on odd tables."""

import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names that operators use for their own columns
        from pyspark.sql import functions as F

        for name in ("kept", "spans", "component", "batch", "_w", "key", "item"):
            df = df.withColumn(name, F.lit(1))
    return df


def prose(rng, n, words=400):
    return " ".join("".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = prose(rng, 60)
    long = prose(rng, 3000)
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "two words"), (9, f"{prose(rng, 40)} {passage} {prose(rng, 40)}"),
        (10, f"{prose(rng, 30)} {passage} {prose(rng, 55)}"), (11, long), (12, long + " tail"), (13, 'token = "abcdef0123456789abcdef0123456789" end'),
        (14, "é ü ñ 🎉 x" * 30), (15, prose(rng, 30) + "\nReleased under the MIT License."), (None, base), (16, "the " * 200),
    ]


EMPTY: list = []


def words_of(t):
    return (t or "").encode().lower().split()


# --- quality ---------------------------------------------------------------


def test_quality_counts(spark, odd):
    from loomgraph.llm import quality

    rows = quality.judge(docs_of(spark, odd, extra=True).drop("kept", "_w")).collect()
    assert len(rows) == len(odd)
    want = collections.Counter()
    for _, t in odd:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want[(len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w))] += 1
    got = collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == want
    assert all(not r.kept for r in rows if r.base_failed)


def test_quality_rejects_junk_and_keeps_clean(spark, data):
    from loomgraph.llm import quality

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judge(docs.select("doc_id", "text", "lang")).filter("NOT base_failed").join(labels, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) == len(clean)
    assert sum(junk) <= 0.2 * len(junk)


# --- joins -----------------------------------------------------------------


def brute_classes(texts, k, num, den):
    sets = {}
    for i, t in texts:
        w = words_of(t)
        if i is not None and w:
            sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_jaccard_against_brute_force(spark, odd):
    from loomgraph.llm import jaccard

    rng = random.Random(8)
    texts = list(odd)
    for g in range(6):  # chains of copies, each edited again
        w = prose(rng, 90).split()
        for k in range(8):
            w = list(w)
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
            texts.append((100 + 10 * g + k, " ".join(w)))
    for k, num, den in ((3, 9, 10), (5, 4, 5)):
        roots, sizes = brute_classes(texts, k, num, den)
        rows = jaccard.jaccard_classes(docs_of(spark, texts, extra=True), k, num, den).collect()
        assert len(rows) == len(texts)
        for r in rows:
            if r.doc_id is not None:
                assert r.component_id == roots.get(r.doc_id, r.doc_id)
                assert r.n_shingles == sizes.get(r.doc_id, 0)


def test_jaccard_hot_groups_in_blocks(spark):
    from loomgraph.llm import jaccard, linking

    rng = random.Random(3)
    base = prose(rng, 150).split()
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    small = linking.link.__defaults__
    linking.link.__defaults__ = (8,)  # blocks of 8: the group spans many
    try:
        rows = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs_of(spark, texts), 3, 9, 10).collect()}
    finally:
        linking.link.__defaults__ = small
    assert rows == brute_classes(texts, 3, 9, 10)[0]


def test_jaccard_nested_sizes_in_small_blocks(spark):
    """Near copies in three sizes of one text, and texts that make the additions common: links within each size survive blocks of any size."""
    from loomgraph.llm import jaccard, linking

    rng = random.Random(5)
    base, common = prose(rng, 150).split(), prose(rng, 750).split()
    texts = []
    for more in (0, 100, 750):
        for _ in range(6):
            w = list(base)
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(w + common[:more])))
    texts += [(100 + i, " ".join(common + prose(rng, 300).split())) for i in range(20)]
    texts.append((3, prose(rng, 60)))  # another text under an id
    want = brute_classes([t for t in texts if t[1] != texts[-1][1]], 3, 9, 10)[0]
    small = linking.link.__defaults__
    for block in (2, 4, 512):
        linking.link.__defaults__ = (block,)
        try:
            rows = jaccard.jaccard_classes(docs_of(spark, texts), 3, 9, 10).collect()
        finally:
            linking.link.__defaults__ = small
        assert sorted((r.doc_id, r.component_id) for r in rows) == sorted([*want.items(), (3, 3)])


def test_hot_key_gives_rows_in_proportion():
    from loomgraph.llm import linking

    sizes = [20] * 10_000 + [200] * 10_000
    rows = pd.DataFrame({"key": 1, "salt": 0, "item": range(len(sizes)), "size": sizes, "pos": 0})
    for most in (1000, 200_000):
        made = pd.concat(linking._lists(9, 10, 512, most)(iter(rows.iloc[i : i + 777] for i in range(0, len(rows), 777))))
        assert len(made) <= 1.1 * len(rows) and set(made["item"]) == set(rows["item"]) and made["list"].isna().all()
    rows["salt"] = 1  # part of a key: even a single row is kept
    assert len(pd.concat(linking._lists(9, 10, 512)(iter([rows.iloc[:1]])))) == 1


def test_substring(spark, odd):
    from loomgraph.llm import substring

    docs = docs_of(spark, odd, extra=True)
    spans = substring.repeats(docs)
    out = {r.doc_id: r.text for r in substring.removed(docs, spans).collect() if r.doc_id is not None}
    texts = dict(odd)
    passage = texts[9].split()[40:100]
    assert out[9] == texts[9]  # the first keeps it
    left = out[10].split()
    assert left[:20] == texts[10].split()[:20] and len(left) < len(texts[10].split()) - 24
    assert " ".join(passage) not in out[10]
    assert 2 not in out and out[1] == texts[1]  # an exact copy has nothing left
    assert out[7] == "one" and out[14] == texts[14] and out[16] == texts[16]


def test_substring_pieces():
    from loomgraph.llm.substring import anchors, tune_bands, without

    assert tune_bands(0.8, 0.99) == 5
    assert without("a b c d", [(1, 2)]) == "a d"
    assert without("a  b\nc d", [(0, 1), (3, 5)]) == "  b\nc"
    h = np.random.default_rng(1).integers(0, 1 << 62, 400, dtype=np.uint64)
    at = anchors(h)
    moved = anchors(np.concatenate([h[:13][::-1], h]))
    assert set(at[at >= 10] + 13) <= set(moved)  # where a text begins doesn't matter


def test_copied_passages_share_an_anchor():
    from loomgraph.llm.substring import anchors

    rng = np.random.default_rng(4)
    words = lambda n: rng.integers(0, 1 << 62, n, dtype=np.uint64)
    for _ in range(3000):
        passage = words(51)
        a, b = (anchors(np.concatenate([words(40), passage, words(40)])), anchors(np.concatenate([words(23), passage, words(31)])))
        assert {x - 40 for x in a if 40 <= x <= 67} & {x - 23 for x in b if 23 <= x <= 50}


# --- embeddings ------------------------------------------------------------


def test_embeddings_against_brute_force(spark):
    from loomgraph.llm import embedding

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(300):
        v = centres[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 0.5)
        rows.append([float(x) for x in v])
    rows += [rows[0], rows[0], [0.0] * 16, None, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1e-200] + [0.0] * 15, [1.0] * 5]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in embedding.near_duplicates(df, block=16, sigmas=4).collect()}
    assert len(got) == len(rows)
    good = [i for i, v in enumerate(rows) if v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([rows[i] for i in good])
    x /= np.abs(x).max(1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.9
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(good)):
        for b in range(a):
            if hit[a, b]:
                p, q = find(good[a]), find(good[b])
                root[max(p, q)] = min(p, q)
    links = {g: int(hit[k].sum()) - 1 for k, g in enumerate(good)}
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links.get(i, 0), find(i), find(i) == i), i


def test_embedding_recall_in_many_dimensions():
    from loomgraph.llm import embedding as E

    assert [E.cells_for(n) for n in (1, 15, 16, 2000, 51_282, 10**9)] == [1, 1, 2, 16, 64, 2048]
    rng = np.random.default_rng(1)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    turn = rng.normal(size=base.shape)
    turn -= (turn * base).sum(1)[:, None] * base
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    x = np.concatenate([base, 0.905 * base + np.sqrt(1 - 0.905**2) * turn])  # pairs just above the threshold
    centres = E.spherical_kmeans(x, E.cells_for(len(x)))
    home, near = E._cells(x, centres, E.gaps(centres), E.reach(np.sqrt(0.2), 64))
    near[np.arange(len(x)), home] = True
    i, j = np.arange(1500), np.arange(1500) + 1500
    assert (near[i, home[j]] | near[j, home[i]]).mean() > 0.99 and len(set(home)) > 8


def test_embedding_widths_and_extra_columns(spark):
    from pyspark.sql import functions as F

    from loomgraph.llm import embedding

    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.05])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("v", F.lit("x")).withColumn("rep", F.lit(0))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3)}


def test_empty_tables(spark):
    from loomgraph.llm import chat, embedding, jaccard, licenses, packing, pieces, quality, scoring, secrets, substring

    none = docs_of(spark, EMPTY)
    assert quality.judge(none).count() == 0
    assert jaccard.jaccard_classes(none).count() == 0
    assert substring.merged(substring.repeats(none)).count() == 0
    assert secrets.scan(none).count() == 0
    assert licenses.scan(none).count() == 0
    assert scoring.backoff_scores(none).count() == 0
    assert packing.pack(none).count() == 0
    assert pieces.decode(pieces.encode(none)).count() == 0
    assert embedding.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    assert chat.format_turns(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_components(spark):
    from loomgraph.llm.components import components

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(500, 500), (600, 601), (601, 600)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in root}


# --- packing and tokens ----------------------------------------------------


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    from loomgraph.llm import packing

    rows = packing.pack(docs_of(spark, odd, extra=True), with_ids=True).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    by, seqs, total = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(by) == {i for i, _ in odd}
    for i, text in odd:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        raw = b"".join(r.ids for r in sorted(by[i], key=lambda r: r.piece))
        assert raw == struct.pack(f"<{len(ids)}I", *ids)
        for r in by[i]:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)) and (r.length == 1024 or r.piece == 0)
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    assert len(seqs) <= math.ceil(total / 1024) + 2


def test_best_fit_rounds(spark):
    from pyspark.sql import functions as F

    from loomgraph.llm import packing

    found = spark.range(5000).select(F.col("id").alias("item"), (F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("length")).repartition(40)
    placed = packing.place(found).collect()
    fill = collections.Counter()
    for r in placed:
        fill[r.sequence_id] += r.length
    assert len(placed) == 5000 and max(fill.values()) <= 1024
    assert len(fill) <= 1.02 * sum(fill.values()) / 1024 + 1


@pytest.mark.parametrize("text", ["", " ", "a  b", "a \nb", " a b", "x <|endoftext|> y", "don't 's 1 2", "a\tb c\n d", "a　b c", "🎉 é"])
def test_cached_encoder(text):
    from tokenizers import Tokenizer

    from loomgraph.llm import packing

    ids = Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert packing.encoder(packing.tokenizer_path())(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_sentencepiece(spark, odd):
    import sentencepiece

    from loomgraph.llm import pieces

    rng = random.Random(9)
    giant = "".join(rng.choice("abcdefghilmnoprstu") for _ in range(900))
    texts = [*odd, (20, giant), (21, giant[:300] + " " + giant[300:] + "\n" + "x " * 300)]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for chunk in (1 << 16, 64):
        rows = pieces.decode(pieces.encode(docs_of(spark, texts, extra=True), chunk=chunk)).collect()
        got = collections.Counter((r.doc_id, tuple(r.ids), r.text) for r in rows)
        assert got == collections.Counter((i, tuple(sp.encode(t or "")), t or "") for i, t in texts)


def test_max_plus_is_associative():
    from loomgraph.llm.pieces import max_plus, prefixes

    rng = np.random.default_rng(0)
    ms = [np.where(rng.random((4, 4)) < 0.4, -np.inf, rng.normal(size=(4, 4))) for _ in range(9)]
    one, out = ms[0], [ms[0]]
    for m in ms[1:]:
        one = max_plus(one, m)
        out.append(one)
    assert all(np.allclose(a, b) for a, b in zip(prefixes(ms), out))


# --- scans -----------------------------------------------------------------


def test_secrets(spark, odd):
    import re

    from loomgraph.llm import secrets

    net = secrets.trained()
    assert net.held_out["recall"] >= 0.95 and net.held_out["false"] <= 0.01
    texts = [*odd, (30, "secret=token: abcdefgh"), (31, "PASSWORD='hunter2x' apikey:abcdef API_KEY = zzzzzz"), (32, "AKIA" + "A" * 16 + " AKIAxx AKIA1"), (33, "key ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hJ6")]
    rows = secrets.scan(docs_of(spark, texts, extra=True).drop("spans")).collect()
    for (i, t), r in zip(sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)), sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))):
        t = t or ""
        want = [(m.start(), m.end(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(s.start, s.end, s.kind) for s in r.spans if s.kind != "net"] == sorted(want, key=lambda x: (x[0], secrets.KINDS.index(x[2])))
    assert any(s.kind == "net" for r in rows if r.doc_id == 33 for s in r.spans)
    clean = secrets.redact(docs_of(spark, texts)).filter("doc_id = 13").first()
    assert clean.text == "[secret]\" end" and clean.n_chars == len(clean.text)


def test_secrets_read_whole_tokens():
    from loomgraph.llm import secrets

    net, key = secrets.trained(), "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hJ6"
    assert net.held_out["recall"] >= 0.98
    path = "content/chapter/section/"
    text = f"see {path * 3}{key}/{path * 3}"
    lone = secrets.windows(text, 4 + 3 * len(path), 4 + 3 * len(path) + len(key))[0]
    whole = secrets.windows(text, 4, len(text))
    assert any(bytes(key[:24], "ascii") in w[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE] for w in whole) and len(lone) == secrets.WIDTH
    assert secrets.all_spans([text], net)[0] == [(4, len(text), "net")]
    hexed = "key " + key + "-" + "0123456789abcdef01234567" + "-" + key
    assert [hexed[a:b] for a, b, k in secrets.all_spans([hexed], net)[0] if k == "net"] == [key + "-", "-" + key]


def test_licenses(spark, odd):
    from loomgraph.llm import licenses

    texts = [(1, "x y\nReleased under the MIT License."), (2, "Licensed under the Apache Licence, version 2.0"), (3, "a license to chill"), (4, None), (5, ""), (6, licenses.TEMPLATES["BSD-3-Clause"])]
    rows = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert (rows[1].license, rows[1].confirmed, rows[1].differences) == ("MIT-notice", True, 0)
    assert rows[2].license.startswith("Apache") and rows[6].license == "BSD-3-Clause" and rows[6].confirmed
    assert not rows[3].confirmed and set(rows) == {1, 2, 3, 6}
    assert licenses.wording_differences(["a", "b", "c"], ["x", "a", "c", "y"]) == 1


def test_licenses_without_usual_words():
    """Templates of made-up words, changed as much as may be, are found; against trying every stretch."""
    from loomgraph.llm import licenses

    rng = random.Random(12)
    made = {f"T{k}": prose(rng, 40 + 7 * k) for k in range(4)}
    scanner = licenses.Scanner(made)
    for k, (name, t) in enumerate(made.items()):
        own = t.split()
        for _ in range(10):
            w = list(own)
            for _ in range(int(0.1 * len(own))):
                w[rng.randrange(len(w))] = "qq"
            text = prose(rng, 300) + "\n" + "\n# ".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6)) + "\n" + prose(rng, 300)
            assert licenses.wording_differences(licenses.words(t), licenses.words(text)) <= scanner.most[k]
            assert [x[2] for x in scanner.text(text) if x[5]] == [name]
    assert not scanner.text(prose(rng, 5000))


def test_licenses_wrapped_and_side_by_side(spark):
    import textwrap

    from loomgraph.llm import licenses

    T = licenses.TEMPLATES
    full = [n for n in T if len(T[n]) > 100]
    texts = [(200 + i, "some prose\n\n" + "\n".join(textwrap.wrap(T[n], 50, break_on_hyphens=False)) + "\n\nmore prose") for i, n in enumerate(full)]
    texts += [(100 + i, "\n\n".join(" * " + x for x in textwrap.wrap(T[n], 60, break_on_hyphens=False))) for i, n in enumerate(full)]
    texts += [
        (20, f"{T['MIT-notice']}\n{T['Apache-2.0-notice']}"), (21, f"{T['All-rights-reserved']} {T['CC-BY-4.0']}"), (22, "\nx\n".join([T["All-rights-reserved"]] * 3)),
        (23, "All rights\n# reserved."), (24, "\n".join(T.values())), (25, f"a license to chill\n\n{'word ' * 300}\n{T['MIT']}"),
    ]
    text, got = dict(texts), collections.defaultdict(list)
    for r in licenses.scan(docs_of(spark, texts)).collect():
        got[r.doc_id].append((r.start, r.license, r.confirmed))
        if r.confirmed:
            assert r.differences == 0 and licenses.words(text[r.doc_id][r.start : r.end]) == licenses.words(T[r.license])
    names = {i: [(n, c) for _, n, c in sorted(x)] for i, x in got.items()}
    for i, n in enumerate(full):
        assert names[200 + i] == names[100 + i] == [(n, True)]
    assert names[20] == [("MIT-notice", True), ("Apache-2.0-notice", True)] and names[21] == [("All-rights-reserved", True), ("CC-BY-4.0", True)]
    assert names[22] == [("All-rights-reserved", True)] * 3 and names[23] == [("All-rights-reserved", True)]
    assert names[24] == [(n, True) for n in T]
    assert [c for _, c in names[25]] == [False, True] and names[25][1][0] == "MIT"


def test_lm_scores(spark, odd):
    from loomgraph.llm import scoring

    rows = scoring.backoff_scores(docs_of(spark, odd, extra=True), batch_docs=4, bucket_docs=5).collect()
    uni, bi = collections.Counter(), collections.Counter()
    for _, t in odd:
        w = words_of(t)
        uni.update(w)
        bi.update(zip(w, w[1:]))
    total, want = sum(uni.values()), collections.Counter()
    for i, t in odd:
        w = words_of(t)
        own, own2, n, s = collections.Counter(w), collections.Counter(zip(w, w[1:])), total - len(w), 0.0
        for k, x in enumerate(w):
            one = math.log(max(uni[x] - own[x], 1) / n)
            if k:
                c = bi[w[k - 1], x] - own2[w[k - 1], x]
                one = math.log(c / (uni[w[k - 1]] - own[w[k - 1]])) if c > 0 else one + math.log(0.4)
            s += one
        want[(i, len(w), round(s, 4) + 0.0)] += 1
    assert collections.Counter((r.doc_id, r.n_words, round(r.log_score, 4) + 0.0) for r in rows) == want


def test_lm_batches_and_their_codes(spark):
    from loomgraph.llm import scoring

    rng = np.random.default_rng(5)
    for top in (1, 255, 256, 70000, 1 << 24, 1 << 46, (1 << 64) - 1):
        for size in (0, 1, 500):
            x = rng.integers(0, top, size, np.uint64, endpoint=True)
            assert (scoring.decode(scoring.encode(x)) == x).all()
    ids = [None, 2**62 + 1, 2**62 + 3, None, -(2**62) - 1]
    docs = docs_of(spark, [(i, "a b c " * 9) for i in ids])
    small = scoring.backoff_scores(docs, 3, batch_bytes=60, bucket_docs=1).collect()
    whole = scoring.backoff_scores(docs, 3).collect()
    assert collections.Counter(r.doc_id for r in small) == collections.Counter(ids)
    assert sorted((str(r.doc_id), r.n_words, round(r.log_score, 9)) for r in small) == sorted((str(r.doc_id), r.n_words, round(r.log_score, 9)) for r in whole)


def test_lm_query_counts_trigrams(spark, tmp_path):
    from loomgraph.llm import scoring

    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(40)))) for i in range(12)]
    docs_of(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    counts = lambda ts, n: collections.Counter(tuple(w[k : k + n]) for w in map(words_of, ts) for k in range(len(w) - n + 1))
    want = {}
    for i, t in docs:
        others = [x for j, x in docs if j != i]
        c, w, s = {n: counts(others, n) for n in (1, 2, 3)}, words_of(t), 0.0
        for k in range(len(w)):
            for n in (3, 2, 1):
                gram = tuple(w[k - n + 1 : k + 1])
                if n <= k + 1 and c[n][gram]:
                    s += math.log(0.4 ** (min(3, k + 1) - n) * c[n][gram] / (c[n - 1][gram[:-1]] if n > 1 else sum(c[1].values())))
                    break
        want[i] = (len(w), round(s, 6) + 0.0)
    assert {r.doc_id: (r.n_words, round(r.log_score, 6) + 0.0) for r in scoring.op9_lm_scoring(spark, str(tmp_path)).collect()} == want


# --- chat ------------------------------------------------------------------


def test_chat_round_trip(spark):
    from loomgraph.llm import chat

    said = ["a\\<|b", "<|end|>", "\\", "[INST", "[/INST]\\", "<<SYS>>x<</SYS>>", "<<|", "</s>\\|", "\n\\\n", "", None, "<|message|>"]
    rows = [(c, t, a, b) for c, a in enumerate(said) for t, b in enumerate(said)] + [(50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (50, None, "user", "y"), (None, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for c, a in enumerate(said):
        assert [(t.role, t.text) for t in got[c].turns] == [(a or "", b or "") for b in said]
    assert [(t.role, t.text) for t in got[50].turns] == [("user", "y"), ("assistant", "x"), ("assistant", "x")]
    assert got[50].loss_text == "xx" and len(got) == len(said) + 2


def test_chat_layouts(spark):
    from loomgraph.llm import chat

    records = [
        (1, '{"messages":[{"role":"human","content":"a"},{"content":null,"role":"assistant"}]}'), (2, '{"completion":"y","prompt":"x"}'),
        (3, '{"turn":1,"role":"user","text":null}'), (4, "zz"), (5, '{"instruction":"q","input":"","output":"o"}'), (6, '{"conversations":[{"from":"gpt","value":"v"}]}'), (7, None), (8, '{"odd":{"deep":1}}'),
    ]
    df = spark.createDataFrame(records, "conv_id bigint, record string")
    turns = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat.to_turns(df).fillna("", ["text"]).collect())
    assert turns == [(1, 0, "user", "a"), (1, 1, "assistant", ""), (2, 0, "user", "x"), (2, 1, "assistant", "y"), (3, 1, "user", ""), (5, 0, "user", "q"), (5, 2, "assistant", "o"), (6, 0, "assistant", "v")]
    assert {r.conv_id for r in chat.unmapped(df).collect()} == {4, 7, 8}


def test_chat_query_against_sql(spark, data):
    from loomgraph.llm import chat
    from tests.oracle import connect, differences

    assert differences(chat.op10_chat_formatting(spark, data), chat.ORACLE, connect(data)) == ""


def test_pipeline(spark, data):
    """Each stage's rows against brute force over what the stage before kept."""
    import corpus_pipeline

    from loomgraph.llm import packing, quality, secrets
    from loomgraph.storage import cut

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names, seen = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = cut(stage(spark, docs, data), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names and 0 < docs.count() <= seen[-1].count()
        seen.append(docs)
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:5]]
    verdict = {r.doc_id: r.kept for r in quality.judge(seen[0]).select("doc_id", "kept").collect()}
    assert texts[1] == {i: t for i, t in texts[0].items() if verdict[i]}
    roots, _ = brute_classes(list(texts[1].items()), 5, 4, 5)
    assert texts[2] == {i: t for i, t in texts[1].items() if roots.get(i, i) == i}
    owner: dict = {}
    for i, t in sorted(texts[3].items()):  # no passage of 51 words is left in two documents, and none has words of its own making
        w = words_of(t)
        assert not collections.Counter(w) - collections.Counter(words_of(texts[2][i]))
        for a in range(len(w) - 50):
            assert owner.setdefault(b" ".join(w[a : a + 51]), i) == i
    assert set(texts[4]) == set(texts[3])
    assert secrets.scan(seen[4]).filter("exists(spans, s -> s.kind IN ('access', 'hex'))").count() == 0
    packed = seen[5].groupBy("doc_id").sum("length").collect()
    own = {r.doc_id: r["sum(length)"] for r in packing.pieces(seen[4]).groupBy("doc_id").sum("length").collect()}
    assert {r.doc_id: r["sum(length)"] for r in packed} == own
    fill = seen[5].groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0]
    assert fill <= 1024


def test_pipeline_on_odd_tables(spark, odd):
    import corpus_pipeline

    for rows in (EMPTY, [*odd, odd[0], odd[8]]):
        docs = docs_of(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, "")
            if name == "ngram_jaccard_join":
                want = collections.Counter((r.doc_id, r.text) for r in before.collect())
                roots, _ = brute_classes([(i, t) for i, t in set(want) if i is not None], 5, 4, 5)
                kept = collections.Counter({x: n if x[0] is None else 1 for x, n in want.items() if x[0] is None or roots.get(x[0], x[0]) == x[0]})
                assert collections.Counter((r.doc_id, r.text) for r in docs.collect()) == kept
        if not rows:
            assert docs.count() == 0


def test_hot_key_of_disjoint_sets_costs_no_blocks(spark, monkeypatch):
    """Sets that share one common key and nothing else aren't compared, however many; near copies among them are still found."""
    from loomgraph.llm import linking
    from loomgraph.llm.shingles import parity

    made, plain = [], linking.cut

    def counted(df, name="t"):
        out = plain(df, name)
        if name in ("meets", "blocks"):
            made.append(out.count())
        return out

    monkeypatch.setattr(linking, "cut", counted)
    for n in (400, 1600):
        rng = np.random.default_rng(1)
        sets = [np.unique(np.concatenate([[np.uint64(7)], rng.integers(1000, 1 << 62, 20).astype(np.uint64)])) for _ in range(n)]
        sets[n - 1] = np.unique(np.concatenate([sets[3][:-1], [np.uint64(999)]]))
        items = spark.createDataFrame([(i, i, len(x), bytearray(parity(x))) for i, x in enumerate(sets)], "item bigint, node bigint, size int, sketch binary")
        keys = spark.createDataFrame([(7, 0, i, len(x), 0) for i, x in enumerate(sets)], "key bigint, salt int, item bigint, size int, pos int")
        full = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node bigint, shingles binary")
        got = linking.link(keys, items, lambda needed: full.join(needed, "node"), 4, 5, block=8)  # noqa: B023
        assert {tuple(r) for r in got.collect()} == {(3, 3), (n - 1, 3)} and sum(made) == 0


@pytest.mark.parametrize("width, free", [(64, 4), (768, 8), (64, 16), (64, 64)])
def test_embedding_recall_by_free_dimensions(width, free):
    """Pairs of vectors that fill few dimensions around their centres meet too."""
    from loomgraph.llm import embedding

    rng, rows = np.random.default_rng(free), []
    for _ in range(20):
        basis = np.linalg.qr(rng.normal(size=(width, free)))[0]
        centre = rng.normal(size=width)
        rows.append(centre / np.linalg.norm(centre) + 0.6 * rng.normal(size=(300, free)) / np.sqrt(free) @ basis.T)
    x = np.concatenate(rows)
    x = rng.permutation(x / np.linalg.norm(x, axis=1)[:, None])
    centres = embedding.spherical_kmeans(x[:4000], 32)
    step = embedding.step_of(x[:4000], centres, float(np.sqrt(0.2)), 0.9)
    assert embedding.missed(x[2000:], centres, step, 0.9) < 0.01


def test_embedding_links_of_few_dimensions(spark):
    """The whole operator in several cells against brute force, on vectors that fill 4 of 32 dimensions."""
    from loomgraph.llm import embedding

    rng = np.random.default_rng(4)
    rows = [c + 0.5 * rng.normal(size=(60, 4)) @ rng.normal(size=(4, 32)) / 8 for c in rng.normal(size=(8, 32))]
    x = np.concatenate(rows)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    want = {i: int(n) - 1 for i, n in enumerate(near.sum(1))}
    got = {r.vec_id: r.n_links for r in embedding.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 0 and all(got[i] <= want[i] for i in want)


def test_pipeline_keeps_texts_of_one_id(spark):
    """An id on several texts loses none of them, and rows that repeat id and text become one."""
    import corpus_pipeline

    from loomgraph.llm import jaccard

    rng = random.Random(8)
    a, b, c, own = (prose(rng, 90) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, b), (2, c), (2, own), (3, c), (None, a), (6, ""), (6, None), (7, "..."), (9, a + " more")]
    got = collections.Counter((r.doc_id, r.text) for r in jaccard.one_of_each(docs_of(spark, rows)).collect())
    assert got == collections.Counter([(1, a), (5, b), (2, c), (2, own), (None, a), (6, ""), (6, None), (7, "...")])
    # a passage of text A under id 5 is cut out of A alone
    docs = docs_of(spark, [(1, a), (5, f"{own} {a}"), (5, b), (None, a)])
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.substring_dedup(spark, docs, "").collect())
    assert got[(5, b)] == 1 and got[(1, a)] == 1 and got[(None, a)] == 1 and sum(got.values()) == 4
    (rest,) = [t for i, t in got if i == 5 and t != b]
    assert rest.startswith(own[:200]) and len(rest) < len(own) + len(a) // 2


@pytest.mark.parametrize("n", range(1, 14))
def test_registered_query(spark, data, n):
    """The registered query as it stands, against its SQL where there is one, else a row for what its contract counts."""
    from loomgraph.llm import queries
    from tests.oracle import connect, differences

    name = next(k for k in queries.QUERIES if k.startswith(f"op{n}_"))
    df = queries.QUERIES[name](spark, data)
    if name in queries.ORACLES:
        assert differences(df, queries.ORACLES[name], connect(data)) == ""
        return
    n_docs = spark.read.parquet(f"{data}/documents.parquet").count()
    if n in (5, 7):
        assert df.count() == n_docs
    elif n in (12,):
        assert df.count() == n_docs
    elif n == 6:
        assert df.count() == spark.read.parquet(f"{data}/embeddings.parquet").count()
    elif n == 3:
        assert df.select("doc_id").distinct().count() == n_docs
    else:
        assert df.count() > 0


def test_quality_plan_derives_once(spark, data):
    from loomgraph.llm import quality

    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = quality.judge(docs).filter("kept").select(*docs.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_remove(split(") == 1


def test_hash_words():
    from loomgraph.llm.shingles import parity, shingle_set, word_hashes

    assert np.array_equal(word_hashes("Ab  cD\n\x0bé"), word_hashes(" aB cd é "))
    assert not np.array_equal(word_hashes("É"), word_hashes("é"))  # only A-Z are folded
    a, b = shingle_set("a b c d e f g", 3), shingle_set("a b c d e f h", 3)
    assert len(np.intersect1d(a, b)) == 4 and len(shingle_set("a b", 3)) == 1 and len(shingle_set(None, 3)) == 0
    differ = int(np.bitwise_count(np.frombuffer(parity(a), np.uint8) ^ np.frombuffer(parity(b), np.uint8)).sum())
    assert differ <= len(np.setxor1d(a, b))
    assert hashlib.sha256(parity(a)).hexdigest() == hashlib.sha256(parity(a)).hexdigest()
