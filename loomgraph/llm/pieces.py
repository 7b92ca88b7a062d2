"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The model is a BPE model with byte fallback. A sequence of its pieces is the encoding of
a text exactly if each two neighbours are the encoding of their own string, so encoding
is a best path whose steps weigh 0 (such neighbours) or minus infinity. Between two
characters that no piece holds side by side (a word's end, a rare character) any path
breaks, and what stands between such places is encoded alone, common words once.

A document over ``chunk`` characters is cut into chunks that are worked on apart. Its
boundary states are the pieces that may span a cut. Each chunk yields the matrix of best
weights from the states at its start to those at its end; matrices are multiplied in the
(max, +) semiring, by a tree, which gives every chunk its two states; then each chunk is
traced back for itself.

Defined results: a null text is the empty text and has no ids; U+2581 decodes as the
blank that the model takes it for; repeated rows are encoded as often as they stand
there; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.memory import released

CHUNK, MARK = 1 << 16, "▁"
NONE = -np.inf
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Pieces and scores of a SentencePiece BPE file, its encoder, and the steps of the scan."""

    def __init__(self, path: str, most: int = 250_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.rank = {p: -x for p, x in self.score.items()}
        self.first_byte = next(i for i in range(n) if sp.is_byte(i))
        self.longest = max(map(len, self.id))
        self.beside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.bytes = [bytes([i - self.first_byte]) if sp.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.most, self.known, self.parts, self.fits = most, {}, {}, {}

    def merge(self, s: str) -> list[str]:
        """BPE of a string: the neighbours whose joint piece scores best are joined, the leftmost of equals first."""
        if len(s) <= 64:
            return self.merge_short(s)
        parts: list = list(s)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < len(parts) and (both := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def merge_short(self, s: str) -> list[str]:
        parts, rank = list(s), self.rank.get
        left = [rank(a + b, math.inf) for a, b in zip(parts, parts[1:])]
        while left and (best := min(left)) < math.inf:
            i = left.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del left[i]
            if i < len(left):
                left[i] = rank(parts[i] + parts[i + 1], math.inf)
            if i:
                left[i - 1] = rank(parts[i - 1] + parts[i], math.inf)
        return parts

    def part(self, s: str) -> bytes:
        """Ids of a string without places that no piece spans, kept for the next time."""
        if len(self.parts) >= self.most:
            self.parts.clear()
        got = self.parts[s] = self.ids(self.merge(s))
        return got

    def ids(self, pieces: list[str]) -> bytes:
        out = []
        for p in pieces:
            out += [self.id[p]] if p in self.id else [self.first_byte + b for b in p.encode()]
        return struct.pack(f"<{len(out)}I", *out)

    def hard(self, s: str) -> list[int]:
        """Places inside ``s`` that no piece spans."""
        return [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in self.beside]

    def segment(self, s: str) -> bytes:
        """Ids of a string, kept for the next time."""
        got = self.known.get(s)
        if got is None:
            at, parts = [0, *self.hard(s), len(s)], self.parts.get
            got = b"".join([parts(x) or self.part(x) for x in [s[a:b] for a, b in zip(at, at[1:])]])
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[s] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        known, segment = self.known.get, self.segment
        words = text.split(" ")
        if MARK in text or "" in words:
            return b"".join([known(s) or segment(s) for s in SEGMENT.findall(MARK + text.replace(" ", MARK))])
        return b"".join([known(s) or segment(s) for s in [MARK + w for w in words]])

    def decode(self, ids) -> str:
        """The text of ids; the blank before the first word isn't part of it."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode(errors="replace")[1:]

    # The scan. ``s`` is a marked text with ``longest`` characters around the chunk; a state is (start, end) of a piece.

    def fit(self, a: str, b: str) -> bool:
        """Whether two pieces side by side are their own encoding."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) >= self.most:
                self.fits.clear()
            got = self.fits[a, b] = (a + b)[len(a) - 1 : len(a) + 1] not in self.beside or self.merge(a + b) == [a, b]
        return got

    def piece(self, p: str) -> bool:
        return len(p) == 1 or (p in self.id and self.merge(p) == [p])

    def states(self, s: str, at: int) -> list[tuple[int, int]]:
        """Pieces that start before ``at`` and end there or behind it."""
        return [(a, b) for a in range(max(0, at - self.longest), at) for b in range(at, min(len(s), a + self.longest) + 1) if self.piece(s[a:b])]

    def walk(self, s: str, state: tuple[int, int], to: int) -> dict[int, int]:
        """From a state on: where the last piece of the best path to each place up to ``to`` starts.

        There is at most one path to each place, as its pieces are the encoding of the
        string from the state's piece on.
        """
        last = {state[1]: state[0]}
        for b in range(state[1] + 1, to + 1):
            for a in range(max(state[1], b - self.longest), b):
                if a in last and self.piece(s[a:b]) and self.fit(s[last[a] : a], s[a:b]):
                    last[b] = a
                    break
        return last

    def path(self, s: str, state: tuple[int, int], to: int, last: dict[int, int]) -> list[str]:
        out, b = [], to
        while b > state[1]:
            out.append(s[last[b] : b])
            b = last[b]
        return out[::-1]

    def transfer(self, s: str, start: int, end: int, ins: list, outs: list) -> np.ndarray:
        """Best weights from the states at ``start`` to those at ``end``."""
        hard = [i for i in range(start, end + 1) if i in (0, len(s)) or s[i - 1 : i + 1] not in self.beside]
        reach = min(len(s), end + self.longest)
        if not hard:
            rows = [self.walk(s, x, reach) for x in ins]
        else:
            rows = [self.walk(s, x, max(hard[0], x[1])) for x in ins]
            good = [x[1] <= hard[0] and hard[0] in r for x, r in zip(ins, rows)]
            tail = self.walk(s, (hard[-1], hard[-1]), reach)
        m = np.full((len(ins), len(outs)), NONE)
        for i in range(len(ins)):
            last = rows[i] if not hard else tail
            for j, (a, b) in enumerate(outs):
                here = (not hard and (a, b) == tuple(ins[i])) or (last.get(b) == a and b > (ins[i][1] if not hard else hard[-1])) or (bool(hard) and hard[-1] == end == b)
                m[i, j] = 0.0 if here and (not hard or good[i]) else NONE
        return m

    def trace(self, s: str, start: int, end: int, come: tuple[int, int] | None, go: tuple[int, int] | None) -> bytes:
        """Ids of the pieces that start in the chunk, between its two states (none at the text's ends)."""
        come = come or (start, start)
        to = go[1] if go else end
        hard = [i for i in range(come[1], end + 1) if i in (0, len(s)) or s[i - 1 : i + 1] not in self.beside]
        if not hard:
            return self.ids(self.path(s, come, to, self.walk(s, come, to)))
        head = self.path(s, come, hard[0], self.walk(s, come, hard[0]))
        middle = b"".join(self.segment(x) for x in SEGMENT.findall(s[hard[0] : hard[-1]]))
        tail = self.path(s, (hard[-1], hard[-1]), to, self.walk(s, (hard[-1], hard[-1]), to)) if to > hard[-1] else []
        return self.ids(head) + middle + self.ids(tail)


@functools.cache
def model(path: str) -> Model:
    return Model(path)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices of weights in the (max, +) semiring."""
    return (a[:, :, None] + b[None]).max(1)


def prefixes(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by a tree of associative products."""
    if len(matrices) == 1:
        return matrices
    pairs = [max_plus(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
    done = prefixes(pairs)
    out = [matrices[0]]
    for i in range(1, len(matrices)):
        out.append(done[i // 2] if i % 2 else max_plus(done[i // 2 - 1], matrices[i]))
    return out


def choose(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut on the best path through all matrices."""
    ahead, out, state = prefixes(matrices), [], 0
    for k in range(len(matrices) - 1, 0, -1):
        state = int((ahead[k - 1][0] + matrices[k][:, state]).argmax())
        out.append(state)
    return out[::-1]


def _chunks(chunk: int, margin: int):
    def run(frames):
        for pdf in frames:
            out = []
            for doc, text in zip(pdf["doc"], pdf["text"]):
                s = MARK + text.replace(" ", MARK)
                n = -(-len(s) // chunk)
                for k in range(n):
                    a, b = k * chunk, min(len(s), (k + 1) * chunk)
                    lo = max(0, a - 2 * margin)
                    out.append((doc, k, n, s[lo : b + 2 * margin], a - lo, b - lo))
            yield pd.DataFrame(out, columns=["doc", "k", "n", "s", "start", "end"])

    return run


def _at_ends(m: Model, row) -> tuple[list, list]:
    ins = m.states(row.s, row.start) if row.k else [(row.start, row.start)]
    outs = m.states(row.s, row.end) if row.k + 1 < row.n else [(None, len(row.s))]
    return ins, outs


def _transfers(path: str):
    def run(frames):
        m = model(path)
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                ins, outs = _at_ends(m, row)
                if row.k + 1 < row.n:
                    matrix = m.transfer(row.s, row.start, row.end, ins, outs)
                else:  # one state at the text's end: the whole path is there
                    matrix = np.array([[0.0 if len(row.s) in m.walk(row.s, x, len(row.s)) else NONE] for x in ins]) if not m.hard(row.s[row.start :]) else m.transfer(row.s, row.start, row.end, ins, [(None, len(row.s))])
                out.append((row.doc, row.k, len(ins), matrix.astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["doc", "k", "ins", "matrix"])

    return run


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("k")
    states = choose([np.frombuffer(x, "<f4").reshape(n, -1) for x, n in zip(pdf["matrix"], pdf["ins"])])
    return pd.DataFrame({"doc": pdf["doc"], "k": pdf["k"], "come": [0, *states], "go": [*states, 0]})


def _traces(path: str):
    def run(frames):
        m = model(path)
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                ins, outs = _at_ends(m, row)
                go = outs[row.go] if row.k + 1 < row.n else None
                ids = m.trace(row.s, row.start, row.end, ins[row.come] if row.k else None, go)
                out.append((row.doc, row.k, np.frombuffer(ids, "<u4").astype(np.int32)))
            yield pd.DataFrame(out, columns=["doc", "k", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id and ids, an array of int, of every document."""
    path = path or model_path()
    margin = model(path).longest
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    small = F.char_length("text") < chunk

    def whole(batches):
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            ids = [np.frombuffer(m.encode(t), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

    done = src.filter(small).mapInArrow(released(whole), "doc_id bigint, ids array<int>")
    from loomgraph.storage import cut

    giant = cut(src.filter(~small).select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "giant")
    parts = giant.select("doc", "text").mapInPandas(released(_chunks(chunk, margin)), "doc bigint, k int, n int, s string, start int, end int")
    parts = cut(parts.repartition("doc", "k"), "chunks")
    matrices = parts.mapInPandas(released(_transfers(path)), "doc bigint, k int, ins int, matrix binary")
    states = matrices.groupBy("doc").applyInPandas(_choose, "doc bigint, k int, come int, go int")
    traced = parts.join(states, ["doc", "k"]).select("doc", "k", "n", "s", "start", "end", "come", "go").mapInPandas(released(_traces(path)), "doc bigint, k int, ids array<int>")
    joined = traced.groupBy("doc").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return done.unionByName(giant.select("doc", "doc_id").join(joined, "doc").select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and text of rows with ids."""
    path = path or model_path()

    def run(batches):
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            texts = [m.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run), "doc_id bigint, ids array<int>, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, as their number and hash, and the digest of the text that they decode to."""
    back = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))
