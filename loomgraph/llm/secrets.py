"""Secret scans: fixed patterns, and a character network over other candidates.

Every text is scanned whole. The patterns' findings always stay. What the
patterns leave of tokens are candidates; a small convolutional network in numpy reads all
of each one, in windows with its surroundings, and adds those whose calibrated probability passes a threshold chosen for
recall on held-out labelled findings. The network is trained on the driver, in seconds,
on ``n_train`` labelled findings that ``labelled`` makes, and goes to tasks as weights of
fixed size.

Defined results: a null text is the empty text and has no spans; repeated rows give
repeated results; other columns are left alone.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.memory import released

KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates: such runs with letters that hold a digit or mix cases behind their first character.
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
WIDTH, BEFORE, INSIDE = 96, 32, 48  # characters that the network reads, and where the candidate starts


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' findings, by start, then kind in the order of KINDS."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) of what ``taken`` leaves of candidate tokens, and the stretch of the token to judge it by.

    A part shorter than a candidate is judged with the token's characters around it.
    """
    out, k, spans = [], 0, []
    for a, b in sorted((a, b) for a, b, _ in taken):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    for m in CANDIDATE.finditer(text):
        a, b = at, end = m.span()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        parts, j = [], k
        while j < len(spans) and spans[j][0] < b:
            parts.append((at, spans[j][0]))
            at, j = max(at, spans[j][1]), j + 1
        for x, y in [*parts, (at, b)]:
            if x >= y:
                continue
            lo = max(a, x - max(0, LEAST - (y - x)))
            hi = min(end, max(y, lo + LEAST))
            token = text[lo:hi]
            if any(c.isalpha() for c in token) and (any(c.isdigit() for c in token) or not (token.isupper() or token[1:].islower())):
                out.append((x, y, lo, hi))
    return out


def windows(text: str, start: int, end: int) -> list[bytes]:
    """The candidate and its surroundings as WIDTH character codes; of a long one, a window each half of INSIDE, so that all of it is read."""
    last = max(start, end - INSIDE)
    out = []
    for a in [*range(start, last, INSIDE // 2), last]:
        b = min(end, a + INSIDE)
        before = text[max(0, a - BEFORE) : a].rjust(BEFORE, "\0")
        line = (before + text[a:b].ljust(INSIDE, "\1") + text[b : b + WIDTH])[:WIDTH].ljust(WIDTH, "\0")
        out.append(bytes(min(ord(c), 127) for c in line))
    return out


class Net:
    """Embedding, one convolution with ReLU, maximum over positions inside and around the candidate, one linear layer."""

    def __init__(self, rng: np.random.Generator, width: int = 8, filters: int = 24, span: int = 5):
        self.span = span
        self.e = rng.normal(0, 0.3, (128, width)).astype(np.float32)
        self.c = rng.normal(0, 0.2, (span * width, filters)).astype(np.float32)
        self.cb = np.zeros(filters, np.float32)
        self.w = rng.normal(0, 0.2, 4 * filters).astype(np.float32)
        self.b = np.zeros(1, np.float32)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        v = self.e[x]
        cols = np.concatenate([v[:, k : x.shape[1] - self.span + 1 + k] for k in range(self.span)], axis=2)
        z = cols @ self.c + self.cb
        h = np.maximum(z, 0)
        a, b = h[:, BEFORE : BEFORE + INSIDE], np.concatenate([h[:, :BEFORE], h[:, BEFORE + INSIDE :]], axis=1)
        ma, mb = a.argmax(1), b.argmax(1)
        fa, fb = np.take_along_axis(a, ma[:, None], 1)[:, 0], np.take_along_axis(b, mb[:, None], 1)[:, 0]
        f = np.concatenate([fa, fb, a.mean(1), b.mean(1)], axis=1)
        return f @ self.w + self.b, (v, cols, z, h, f, ma, mb)

    def probability(self, x: np.ndarray) -> np.ndarray:
        logits = np.concatenate([self.forward(x[i : i + 2048])[0] for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))

    def step(self, x: np.ndarray, y: np.ndarray, state: dict, rate: float) -> None:
        """One Adam step on the logistic loss."""
        logits, (v, cols, z, h, f, ma, mb) = self.forward(x)
        n, filters = len(x), self.c.shape[1]
        d = ((1 / (1 + np.exp(-np.clip(logits, -30, 30)))) - y)[:, None].astype(np.float32) / n
        df = d * self.w
        dh = np.zeros_like(h)
        inside = slice(BEFORE, BEFORE + INSIDE)
        outside = np.r_[0:BEFORE, BEFORE + INSIDE : h.shape[1]]
        dh[:, inside] += (df[:, 2 * filters : 3 * filters] / INSIDE)[:, None]
        dh[:, outside] += (df[:, 3 * filters :] / len(outside))[:, None]
        rows, cs = np.arange(n)[:, None], np.arange(filters)[None]
        dh[rows, BEFORE + ma, cs] += df[:, :filters]
        dh[rows, outside[mb], cs] += df[:, filters : 2 * filters]
        dz = dh * (z > 0)
        flat = dz.reshape(-1, filters)
        g = {"w": (d * f).sum(0), "b": d.sum(0), "c": cols.reshape(-1, self.c.shape[0]).T @ flat, "cb": flat.sum(0)}
        dcols = (flat @ self.c.T).reshape(cols.shape)
        dv, width, m = np.zeros_like(v), self.e.shape[1], cols.shape[1]
        for k in range(self.span):
            dv[:, k : k + m] += dcols[:, :, k * width : (k + 1) * width]
        g["e"] = np.zeros_like(self.e)
        np.add.at(g["e"], x.ravel(), dv.reshape(-1, width))
        state["t"] = t = state.get("t", 0) + 1
        for k, grad in g.items():
            m1, m2 = state.get(k, (0.0, 0.0))
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
            state[k] = (m1, m2)
            setattr(self, k, (getattr(self, k) - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)).astype(np.float32))


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
SYLLABLES = ("an the re ing ti on er en st ou le ment de la que ver ein lich und heit keit cion ado los con per tra men tion able ness auf schaft es or at al ic").split()


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n`` labelled findings as windows, 0/1 of each window, and the first window of each finding: keys, tokens and passwords of several forms, and words, paths, numbers, links and rules that look alike."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(s[i] for i in rng.integers(0, len(s), k))
    word = lambda k=4: "".join(SYLLABLES[i] for i in rng.integers(0, len(SYLLABLES), rng.integers(1, k + 1)))
    prose = lambda: " ".join(word() for _ in range(rng.integers(3, 9)))
    leads = ["key: ", "auth=", "Authorization: Bearer ", "credential ", "client ", "private ", "", "", "", "export KEY=", "pwd ", "access "]
    dull = ["see ", "file ", "in ", "https://example.org/", "order ", "", "", "", "part ", "from ", "| ", "chapter "]
    xs, ys, first = [], [], []
    for _ in range(n):
        if y := int(rng.random() < 0.5):
            form = rng.integers(0, 6)
            body = [lambda: pick(ALNUM, rng.integers(20, 44)), lambda: pick(ALNUM + "+/", rng.integers(24, 64)) + "=" * rng.integers(0, 3), lambda: "ghp_" + pick(ALNUM, 36), lambda: "sk-" + pick(ALNUM, rng.integers(24, 48)), lambda: "eyJ" + pick(ALNUM + "-_", rng.integers(40, 90)), lambda: pick(ALNUM[:26] + ALNUM[52:], rng.integers(18, 40))][form]()
            lead = leads[rng.integers(0, len(leads))]
        else:
            form = rng.integers(0, 9)
            body = [
                lambda: word(8).ljust(16, "e"), lambda: word(8).ljust(16, "e").upper(), lambda: "-".join(word() for _ in range(5)), lambda: "_".join(word() for _ in range(5)), lambda: "/".join(word() for _ in range(5)), lambda: pick("0123456789", rng.integers(16, 20)), lambda: "=" * rng.integers(16, 60), lambda: "-" * rng.integers(16, 60), lambda: word(7).ljust(16, "n").capitalize() + pick("0123456789", rng.integers(0, 3)),
            ][form]()
            lead = dull[rng.integers(0, len(dull))]
        text = f"{prose()} {lead}"
        first.append(len(xs))
        xs += windows(f"{text}{body} {prose()}", len(text), len(text) + len(body))
        ys += [y] * (len(xs) - len(ys))
    return np.array([list(x) for x in xs], np.uint8), np.array(ys, np.float32), np.array(first)


@functools.cache
def trained(n_train: int = 4000, epochs: int = 4, recall: float = 0.98, seed: int = 7) -> Net:
    """A network trained on ``n_train`` findings, calibrated (Platt) and thresholded on others.

    The threshold is the highest of those that keep ``recall`` on held-out findings, each
    judged by its likeliest window; the share of held-out others that pass it is in ``held_out``.
    """
    net, state, rng = Net(np.random.default_rng(seed)), {}, np.random.default_rng(seed + 1)
    x, y, _ = labelled(n_train, seed)
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            part = order[i : i + 128]
            net.step(x[part], y[part], state, 0.006 / (1 + epoch))
    hx, hy, first = labelled(n_train // 2, seed + 2)
    logits = np.concatenate([net.forward(hx[i : i + 2048])[0] for i in range(0, len(hx), 2048)])
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        a -= 0.05 * ((p - hy) * logits).mean()
        b -= 0.05 * (p - hy).mean()
    net.scale, net.shift = float(a), float(b)
    p, hy = np.maximum.reduceat(net.probability(hx), first), hy[first]
    net.threshold = float(max(t for t in p[hy == 1] if (p[hy == 1] >= t).mean() >= recall))
    net.held_out = {"recall": float((p[hy == 1] >= net.threshold).mean()), "false": float((p[hy == 0] >= net.threshold).mean())}
    return net


def all_spans(texts: list[str], net: Net) -> list[list[tuple[int, int, str]]]:
    """Patterns' and network's spans of each text, by start, then kind."""
    base = [base_spans(t) for t in texts]
    found, seen, first = [], [], []
    for k, (text, taken) in enumerate(zip(texts, base)):
        for a, b, lo, hi in candidates(text, taken):
            found.append((k, a, b))
            first.append(len(seen))
            seen += windows(text, lo, hi)
    if seen:
        p = np.concatenate([net.probability(np.frombuffer(b"".join(seen[i : i + 4096]), np.uint8).reshape(-1, WIDTH)) for i in range(0, len(seen), 4096)])
        for (k, a, b), q in zip(found, np.maximum.reduceat(p, first)):
            if q >= net.threshold:
                base[k].append((a, b, "net"))
    return [sorted(s, key=lambda x: (x[0], KINDS.index(x[2]))) for s in base]


def scan(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """doc_id and spans, an array of (start, end, kind), of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net or trained())

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            spans = all_spans([t or "" for t in batch.column("text").to_pylist()], shared.value)
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id bigint, spans array<struct<start: bigint, end: bigint, kind: string>>")


def redact(docs: DataFrame, net: Net | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span of its text, overlapping ones joined, replaced by ``mark``; n_chars follows if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(net or trained())
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for text, spans in zip(texts, all_spans([t or "" for t in texts], shared.value)):
                parts, at = [], 0
                for a, b, _ in spans:
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                out.append("".join(parts) + text[at:] if spans else text)
            new = {"text": pa.array(out, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([len(t) if t is not None else n for t, n in zip(out, batch.column("n_chars").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names)

    return docs.mapInArrow(released(run), docs.schema)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's findings, with digests."""
    from pyspark.sql import functions as F

    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(shown(F.filter("spans", lambda s: s["kind"] != "net")), 256).alias("base_sha256"), shown("spans").alias("spans"))
