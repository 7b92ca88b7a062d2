"""Byte-level BPE by a sentencepiece model that is written from the vocabulary itself.

A vocabulary of byte strings and ranks becomes a sentencepiece BPE model: every byte is
mapped to one character, every token to the piece of its bytes' characters with minus its
rank as score, and normalisation is the identity. Both then join the neighbours of least
rank first, the leftmost of equals. A pre-token that is itself in the vocabulary is its own
encoding, as the ranks' own library has it. Ids are decoded by the inverse mapping, from id
to bytes.

Pre-tokens are the matches of a pattern. Characters that this interpreter's Unicode tables
don't know stand in the split as a character of the class that the ranks' own library
gives them, so newer tables of the pattern's engine change nothing.

Defined results: a null text is the empty text and has no ids; ids that the vocabulary
lacks are an error; repeated rows are encoded as often as they stand there; texts and
pre-tokens of any length are taken whole (sentencepiece takes n log n steps); an empty table
gives an empty result; there are no ties (ranks differ); other columns are left alone.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.memory import released

#: pre-tokens kept for the next time, and the longest that are; the first of the characters that stand for bytes
KEEP, LONGEST, FIRST = 400_000, 64, 0x100
BYTES = {b: FIRST + b for b in range(256)}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of lines ``<base64> <rank>``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def mapped(raw: bytes) -> str:
    """One character for each byte."""
    return raw.decode("latin-1").translate(BYTES)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & 0xFFFFFFFFFFFFFFFF)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model of the vocabulary: the unknown piece, then the tokens by rank.

    Fields are those of the public model format: pieces (1: text, 2: score, 3: kind), the
    trainer's settings (3: model type, 2 is BPE; 40 to 43: ids of special pieces) and the
    normalizer's (3 to 5: no blank in front, none removed, none escaped).
    """
    lacking = [b for b in range(256) if bytes([b]) not in ranks]
    if lacking:
        raise ValueError(f"bytes {lacking[:5]} are no tokens of the vocabulary")
    piece = lambda text, score, kind: _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, kind))
    parts = [piece("<unk>", 0.0, 2)]
    parts += [piece(mapped(token), -float(rank), 1) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _number(3, 2) + _number(4, len(ranks) + 1) + _number(40, 0) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normalizer = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(parts) + _block(2, trainer) + _block(3, normalizer)


class Codec:
    """Encodes texts and decodes ids of one vocabulary."""

    def __init__(self, path: str, pat: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.sp = sentencepiece.SentencePieceProcessor()
        self.sp.LoadFromSerializedProto(serialise(ranks))
        order = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of = np.array([0, *(r for _, r in order)], np.uint32)  # by sentencepiece's id
        self.pat = pat
        self.split = regex.compile(pat).findall
        self.bytes = {rank: token for token, rank in order}
        self.whole: dict[str, bytes] = {}  # tokens that are valid texts, by that text
        for token, rank in order:
            try:
                self.whole[token.decode()] = struct.pack("<I", rank)
            except UnicodeDecodeError:
                pass
        self.known, self.seen, self.odd, self.stand = dict(self.whole), set(), set(), {}

    def stand_ins(self, chars: list[str]) -> dict[str, str]:
        """A known character of the class that the ranks' own library gives each of ``chars``."""
        import tiktoken

        out = dict.fromkeys(chars, "!")
        for like in "a1\t":
            tokens = {bytes([b]): b for b in range(256)}
            tokens.update(((like + c).encode(), 256 + k) for k, c in enumerate(chars))
            probe = tiktoken.Encoding("class", pat_str=self.pat, mergeable_ranks=tokens, special_tokens={})
            out.update((c, like) for c in chars if len(probe.encode_ordinary(like + c)) == 1)  # one pre-token
        return out

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii():
            here = set(text)
            if new := here - self.seen:
                self.seen |= new
                if unknown := [c for c in new if unicodedata.category(c) == "Cn"]:
                    self.stand.update({ord(c): s for c, s in self.stand_ins(unknown).items()})
                    self.odd.update(unknown)
            if not here.isdisjoint(self.odd):
                ends = np.cumsum([0, *map(len, self.split(text.translate(self.stand)))]).tolist()
                return [text[a:b] for a, b in zip(ends, ends[1:])]
        return self.split(text)

    def piece(self, s: str) -> bytes:
        ids = self.rank_of[self.sp.encode(mapped(s.encode()))].astype("<u4").tobytes() if s not in self.whole else self.whole[s]
        if len(s) <= LONGEST:
            if len(self.known) >= KEEP + len(self.whole):
                self.known = dict(self.whole)
            self.known[s] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.known.get
        return b"".join([get(s) or self.piece(s) for s in self.pre_tokens(text)])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(2)
def codec(path: str, pat: str) -> Codec:
    return Codec(path, pat)


def encode(docs: DataFrame, path: str | None = None, pat: str | None = None) -> DataFrame:
    """doc_id and ids, an array of int, of every document."""
    path, pat = path or vocabulary_path(), pat or pattern()

    def run(batches):
        import pyarrow as pa

        c = codec(path, pat)
        for batch in batches:
            ids = [c.encode(t.as_py()) for t in batch.column("text")]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(released(run), "doc_id bigint, ids array<int>")


def _rows(ids):
    """The ids of each row of a list column."""
    ends, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def decode(encoded: DataFrame, path: str | None = None, pat: str | None = None) -> DataFrame:
    """doc_id, ids and the bytes that they stand for."""
    path, pat = path or vocabulary_path(), pat or pattern()

    def run(batches):
        import pyarrow as pa

        c = codec(path, pat)
        for batch in batches:
            raw = [c.decode(ids.tolist()) for ids in _rows(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(raw, pa.binary())], names=["doc_id", "ids", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run), "doc_id bigint, ids array<int>, raw binary")


def _digests(batches):
    import pyarrow as pa

    for batch in batches:
        rows = _rows(batch.column("ids"))
        digest = [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in rows]
        n = pa.array([len(ids) for ids in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(digest), batch.column("decoded_sha256")], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, as their number and digest, and the digest of the bytes that they decode to."""
    back = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "ids", F.sha2("raw", 256).alias("decoded_sha256"))
    return back.mapInArrow(_digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
