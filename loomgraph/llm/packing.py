"""Best-fit packing of token sequences, hierarchically.

Documents are encoded and cut into pieces of at most ``size`` tokens. Full pieces are
sequences of their own. The others are packed best-fit decreasing within partitions;
nearly full bins are done, underfull ones become items of the next round, in fewer
partitions, until one partition is left or a round no longer helps. Between rounds
only (bin, fill) rows move; the pieces meet their bins once, at the end.

Defined results: a null text is the empty text, whose only token is the end token;
repeated rows are packed as often as they stand there; an empty table gives no pieces.
Equal lengths are taken in the order in which their partition holds them.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.memory import released
from loomgraph.storage import cut

SIZE, END_ID = 1024, 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: open bins that one task of a later round takes
NODE_ROWS = 200_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class UnsafeChunk(Exception):
    """A chunk between single spaces that touches other white space."""


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if visible, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class ChunkCache(dict):
    """Ids, as little-endian bytes, of the chunks between single spaces, each with the space before it.

    The vocabulary's pattern never joins what stands on both sides of a single space
    between visible characters, apart from giving the space to the right side. So
    chunks are encoded by themselves, and common ones once. A chunk's words (as the
    pattern cuts them) are kept too, as many chunks differ in a mark alone. At most
    ``most`` of either are kept at a time.
    """

    def __init__(self, tokenizer, pattern: str, most: int = 600_000):
        super().__init__()
        import regex

        self.tokenizer, self.model, self.most = tokenizer, tokenizer.model, most
        self.cut, self.letters, self.words = regex.compile(pattern).findall, byte_letters(), {}

    def ids(self, text: str) -> bytes:
        got = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(got)}I", *got)

    def word(self, word: str) -> bytes:
        got = [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))]
        if len(self.words) >= self.most:
            self.words.clear()
        made = self.words[word] = struct.pack(f"<{len(got)}I", *got)
        return made

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise UnsafeChunk
        if len(self) >= self.most:
            self.clear()
        known = self.words.get
        made = self[chunk] = b"".join([known(w) or self.word(w) for w in self.cut(" " + chunk)])
        return made


def encoder(path: str):
    """text -> its ids as little-endian unsigned 32-bit bytes."""
    import public_tokenizers
    from tokenizers import Tokenizer

    cache = ChunkCache(Tokenizer.from_file(path), public_tokenizers.PATTERN)
    special = [t.content for t in cache.tokenizer.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace() and not any(s in text for s in special):
            try:
                return cache.ids(first) + b"".join(map(cache.__getitem__, rest))
            except UnsafeChunk:
                pass
        return cache.ids(text)

    return encode


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: a shorter first one, if any, then full ones."""
    return [n % size] * (n % size > 0) + [size] * (n // size)


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, with their ids as a binary column if asked for."""
    path = path or tokenizer_path()

    def run(batches):
        import pyarrow as pa

        encode, end = encoder(path), struct.pack("<I", END_ID)
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids, at = memoryview(encode(text or "") + end), 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, size)):
                    part = ids[4 * at : 4 * (at + n)]
                    for column, value in zip(out, (doc, k, at, n, zlib.crc32(part), bytes(part) if with_ids else None)):
                        column.append(value)
                    at += n
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[: len(names)], kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(released(run), PIECES + ", ids binary" * with_ids)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: items' indexes by bin. Each item goes to the fullest bin that takes it."""
    order = sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True)
    bins: list[list[int]] = []
    by_space: dict[int, list[int]] = {}
    spaces: list[int] = []  # those in by_space, in order
    for i in order:
        k = bisect_left(spaces, lengths[i])
        if k < len(spaces):
            space = spaces[k]
            found = by_space[space].pop()
            if not by_space[space]:
                del by_space[space], spaces[k]
            bins[found].append(i)
        else:
            space, found = size, len(bins)
            bins.append([i])
        left = space - lengths[i]
        if left:
            if left not in by_space:
                by_space[left] = []
                insort(spaces, left)
            by_space[left].append(found)
    return bins


def _round(items: DataFrame, size: int, level: int, done: int) -> DataFrame:
    """Best fit within each partition: (item, bin, shift, fill, open) rows. Bins get numbers of their round and partition."""

    def run(batches):
        import pyarrow as pa

        ids, lengths = [], []
        for batch in batches:
            ids += batch.column("item").to_pylist()
            lengths += batch.column("fill").to_pylist()
        base = ((level + 1) << 56) | (TaskContext.get().partitionId() << 32)
        rows = []
        for b, members in enumerate(best_fit(lengths, size)):
            fill = sum(lengths[i] for i in members)
            at = 0
            for i in members:
                rows.append((ids[i], base | b, at, fill, fill < done))
                at += lengths[i]
            if len(rows) >= 50_000:
                yield _table(rows, pa)
                rows = []
        yield _table(rows, pa)

    return items.select("item", "fill").mapInArrow(released(run), "item bigint, bin bigint, shift bigint, fill bigint, open boolean")


def _table(rows, pa):
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.bool_()])], names=["item", "bin", "shift", "fill", "open"])


def place(found: DataFrame, size: int = SIZE, nearly_full: float = 0.995, fan_in: int = 8) -> DataFrame:
    """``found`` (item bigint unique, length) with sequence_id and offset.

    Rounds end when all open bins fit into one task, after which nothing can be won,
    or when a round merged under one in fifty of them.
    """
    done = int(size * nearly_full)
    full = found.filter(F.col("length") >= size)
    level = 0
    step = cut(_round(found.filter(F.col("length") < size).select("item", F.col("length").alias("fill")), size, 0, done), "bins0")
    placed = step.select("item", F.col("bin").alias("sequence_id"), F.col("shift").alias("offset"))
    while True:
        bins = step.filter("open").select(F.col("bin").alias("item"), "fill").distinct()
        before = bins.count()
        parts = max(1, step.rdd.getNumPartitions() // fan_in, -(-before // NODE_ROWS))
        if not before:
            break
        level += 1
        # a new level's bins take whole bins of the one below; sequences move by the shift
        step = cut(_round(bins.repartition(parts, "item"), size, level, done), f"bins{level}")
        moved = step.select(F.col("item").alias("sequence_id"), F.col("bin").alias("to"), "shift")
        placed = placed.join(moved, "sequence_id", "left").select("item", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
        after = step.filter("open").select("bin").distinct().count()
        if parts == 1 or 50 * (before - after) < before:
            break
    own = full.select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return found.join(placed.unionByName(own), "item")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their sequence_id and offset; with ``with_ids`` the packed ids too."""
    named = cut(pieces(docs, path, size, with_ids).withColumn("item", F.monotonically_increasing_id()), "items")
    return place(named, size).drop("item")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
