"""Centroid clustering, byte-level BPE and spelling variants: against brute force, SQL and the ranks' own library, and on odd tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import EMPTY, docs_of, odd, prose  # noqa: F401  odd is a fixture

VECTORS = "vec_id bigint, embedding array<double>, label int"


# --- centroid clustering ---------------------------------------------------


def brute_lloyd(rows, k, rounds, width, scale, most=1 << 26):
    """All in Python's whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-most, min(most, math.floor(scale * x) if abs(scale * x) < 1e300 else int(math.copysign(most, x)))) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            apart = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((apart.index(min(apart)), min(apart)))
        return out

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (c, _) in zip(kept, at) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    at = assign()
    inertia = collections.Counter()
    for c, d in at:
        inertia[c] += d
    return collections.Counter((i, c, d, inertia[c], sum(inertia.values()), tuple(centroids[c])) for (i, _), (c, d) in zip(kept, at))


def found(df):
    return collections.Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_lloyd_against_brute_force(spark, seed):
    from loomgraph.llm import lloyd

    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.5, -0.26, 0.0, 0.13, 0.5, 2.0]) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan"), 0.0, 0.0, 0.0]), (305, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, [0.1] * 4), (None, [9.0] * 4), *[(400 + i, [0.5] * 4) for i in range(200)]]  # repeats, ties, a hot group
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(7).selectExpr("*", "1 AS cluster", "2 AS distance", "3 AS centroid")
    for k, rounds in ((5, 3), (40, 2), (1, 1)):
        assert found(lloyd.lloyd(df, k, rounds, 4, 8)) == brute_lloyd(rows, k, rounds, 4, 8)


def test_lloyd_on_odd_tables(spark):
    from loomgraph.llm import lloyd

    assert lloyd.lloyd(spark.createDataFrame(EMPTY, VECTORS), 4, 3, 2, 8).collect() == []
    few = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1e300, -1e300])]  # fewer than k; components beyond the integers
    got = found(lloyd.lloyd(spark.createDataFrame([(*r, 0) for r in few], VECTORS), 4, 3, 2, 8))
    assert got == brute_lloyd(few, 4, 3, 2, 8)
    with pytest.raises(ValueError):
        lloyd.lloyd(spark.createDataFrame(EMPTY, VECTORS), width=300)


def test_lloyd_query(spark, data):
    from loomgraph.llm import lloyd
    from tests.oracle import connect, differences

    assert differences(lloyd.op11_centroid_clustering(spark, data), lloyd.ORACLE, connect(data)) == ""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    want = brute_lloyd(rows, 16, 3, 64, 64)
    got = lloyd.op11_centroid_clustering(spark, data).collect()
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    assert collections.Counter(map(tuple, got)) == collections.Counter({(*r[:5], digest(r[5])): n for r, n in want.items()})


# --- byte-level BPE --------------------------------------------------------


def library():
    import tiktoken

    from loomgraph.llm import byte_bpe

    ranks = byte_bpe.read_ranks(byte_bpe.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=byte_bpe.pattern(), mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_against_the_library():
    from loomgraph.llm import byte_bpe

    own, lib, rng = byte_bpe.Codec(byte_bpe.vocabulary_path(), byte_bpe.pattern()), library(), random.Random(3)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["", "a" * 5000, "ab" * 3000 + " " * 500 + "\n", "\x00\x00 \x00", "<unk>", "▁ ▁", "it's 'S I'LL  x\t\ny  "]
    texts += ["".join(chr(rng.choice(points)) if rng.random() < 0.5 else rng.choice("ab 1!\n\t  'sé　") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" ".join(map(chr, points[k : k + 500])) + "".join(map(chr, points[k : k + 500])) for k in range(0, len(points), 20_000)]
    for t in texts:
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == lib.encode_ordinary(t), t[:80]
        assert own.decode(ids) == t.encode()


def test_byte_bpe_model_needs_all_bytes(tmp_path):
    from loomgraph.llm import byte_bpe

    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0})


def test_byte_bpe_tables(spark, odd):  # noqa: F811
    from loomgraph.llm import byte_bpe

    lib, rows = library(), [*odd, odd[0], (90, prose(random.Random(1), 60_000))]  # repeats and a very long text
    got = byte_bpe.decode(byte_bpe.encode(docs_of(spark, rows, extra=True).withColumnRenamed("spans", "ids"))).collect()
    want = collections.Counter((i, tuple(lib.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.raw)) for r in got) == want
    assert byte_bpe.decode(byte_bpe.encode(docs_of(spark, EMPTY))).collect() == []


def test_byte_bpe_query(spark, data):
    from loomgraph.llm import byte_bpe

    lib, want = library(), collections.Counter()
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = np.array(lib.encode_ordinary(r.text or ""), "<u4")
        want[(r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, byte_bpe.op12_byte_bpe(spark, data).collect())) == want


# --- spelling variants -----------------------------------------------------


def brute_variants(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    by_length = collections.defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k:] == b[k + 1 :]

    met = collections.defaultdict(list)
    for size, own in by_length.items():
        for a, b in itertools.chain(itertools.combinations(own, 2), itertools.product(own, by_length.get(size + 1, []))):
            if near(a, b):
                met[a].append(b)
                met[b].append(a)
    best = {w: min(met[w], key=lambda x: (-words[x], x)) if met[w] else None for w in words}
    form = {w: b if b and words[b] >= 10 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), c, len(met[w]), words.get(form[w])) for w, c in words.items()}


def spelled(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_variants_against_brute_force(spark, seed):
    from loomgraph.llm import spelling

    rng, texts = random.Random(seed), []
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 9))) for _ in range(40)]
    for i in range(60):
        words = [rng.choice(base[: 1 + int(40 * rng.random() ** 3)]) for _ in range(120)]
        for k in range(0, len(words), 9):  # slips of all three kinds
            w, at = words[k], rng.randrange(7)
            words[k] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abc") + w[at:], w[:at] + rng.choice("abcd") + w[at + 1 :]])
        texts.append((i, "  ".join(w.upper() if rng.random() < 0.2 else w for w in words) + " 1x,y"))
    giant = "".join(rng.choice("xyz") for _ in range(20_000))
    chain = " ".join(["abcdefgh"] * 3 + ["abcdefgi"] * 40 + ["abcdefji"] * 500)  # a form of a form
    rows = [*texts, texts[0], (None, texts[1][1]), (70, None), (71, ""), (72, f"{giant} {giant} {giant[:-1]} {giant[:-1]}"), (73, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa"), *[(80 + i, chain) for i in range(12)]]
    got, want = spelled(spelling.variants(docs_of(spark, rows, extra=True).repartition(5))), brute_variants(rows)
    assert got == want
    assert any(f and r != f for f, r, *_ in want.values()) and any(v[3] > 3 for v in want.values()) and giant in want


def test_variants_on_odd_tables(spark, odd):  # noqa: F811
    from loomgraph.llm import spelling

    assert spelling.variants(docs_of(spark, EMPTY)).collect() == []
    assert spelled(spelling.variants(docs_of(spark, [(1, None), (2, "short words only")]))) == {}
    rows = [*odd, odd[0]]
    assert spelled(spelling.variants(docs_of(spark, rows, extra=True))) == brute_variants(rows)


def test_variants_query(spark, data):
    from loomgraph.llm import spelling

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert spelled(spelling.op13_spelling_variants(spark, data)) == brute_variants(rows)


def test_keys_of_words():
    from loomgraph.llm import spelling

    codes = np.array([[ord(c) for c in w] for w in ("abcdefg", "abcxefg", "aabbccd")], np.uint32)
    own, wild, less = spelling.keys(codes)
    assert (wild[3][:, 0] == wild[3][:, 1]).all() and (wild[2][:, 0] != wild[2][:, 1]).any()
    assert (less[0][:, 2] == less[1][:, 2]).all() and (less[1][:, 2] != less[2][:, 2]).any()
    short, _, _ = spelling.keys(np.array([[ord(c) for c in "abcefg"]], np.uint32))
    assert (less[3][:, 0] == short[:, 0]).all() and (less[3][:, 1] == short[:, 0]).all()
