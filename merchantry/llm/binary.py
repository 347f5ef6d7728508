"""Token-id files: concatenated ids with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchantry.llm.memory import lean
from merchantry.llm.order import id_buckets, shuffle_partitions, totals_before
from merchantry.llm.tokens import encoder
from merchantry.operators.joins import small_side

MAGIC = b"EFID"
SAMPLE = 256
BLOCK_IDS = 1 << 20
HEAD = "<BQQq"  # bytes of an id, documents, null ids among them, smallest id
COLUMNS = "bucket int, block int, n_docs bigint, n_ids bigint, first_id bigint, last_id bigint, data binary"


class EliasFano:
    """A rising sequence of whole numbers in about 2 + log2(largest / count) bits each.

    The low bits of every value are packed side by side. The high bits are written in unary
    into a bit vector, in which the i-th one is found from the sampled position of every
    256th one, so `select` touches a few bytes and no table of 64-bit offsets exists.
    """

    def __init__(self, count: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.count, self.width, self.low, self.high, self.samples = count, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        low = np.packbits(bits[:, :width].reshape(-1), bitorder="little")
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        vector[ones] = 1
        return cls(n, width, low, np.packbits(vector, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.count, self.width, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        """The sequence that starts at a byte, and the byte after it."""
        count, width, lows, highs, samples = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, np.uint8, highs, at + lows)
        sampled = np.frombuffer(data, "<u4", samples, at + lows + highs)
        return cls(count, width, low, high, sampled), at + lows + highs + 4 * samples

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        skip, first = i % SAMPLE, start // 8
        end = int(self.samples[i // SAMPLE + 1]) // 8 + 1 if i // SAMPLE + 1 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:end], bitorder="little")[start % 8 :])
        high = start + int(ones[skip]) - i
        begin = i * self.width
        low = int.from_bytes(self.low[begin // 8 : (begin + self.width + 7) // 8].tobytes(), "little") >> begin % 8
        return (high << self.width) | (low & ((1 << self.width) - 1))

    def values(self) -> np.ndarray:
        """All values."""
        n = self.count
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:n].astype(np.uint64)
        high = ones - np.arange(n, dtype=np.uint64)
        bits = np.zeros((n, 64), np.uint8)
        bits[:, : self.width] = np.unpackbits(self.low, bitorder="little")[: n * self.width].reshape(n, self.width)
        low = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(n)
        return (high << np.uint64(self.width)) | low


def encode_block(doc_ids: list[int | None], ids: list[bytes], width: int = 2) -> bytes:
    """Documents in ascending id order, null ids first, as one block of a file with ids of `width` bytes."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) // width for x in ids])
    offsets = (known.astype(np.uint64) - np.int64(least).astype(np.uint64)) if len(known) else np.empty(0, np.uint64)
    head = MAGIC + struct.pack(HEAD, width, len(doc_ids), len(doc_ids) - len(known), least)
    return head + EliasFano.of(offsets).to_bytes() + EliasFano.of(ends).to_bytes() + b"".join(ids)


class Block:
    """A block read back: document ids, boundaries and the ids of any document."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        width, self.count, self.nulls, self._least = struct.unpack_from(HEAD, data, 4)
        self._docs, at = EliasFano.read(data, 4 + struct.calcsize(HEAD))
        self._ends, at = EliasFano.read(data, at)
        self._ids = np.frombuffer(data, f"<u{width}", -1, at)

    def doc_ids(self) -> list[int | None]:
        known = (self._docs.values() + np.int64(self._least).astype(np.uint64)).astype(np.int64)
        return [None] * self.nulls + known.tolist()

    def end(self, i: int) -> int:
        """Where document `i` ends among the ids of the block."""
        return self._ends.select(i)

    def ids(self, start: int, end: int) -> np.ndarray:
        return self._ids[start:end]

    def document(self, i: int) -> np.ndarray:
        """The ids of one document, found by two selects."""
        return self._ids[self._ends.select(i - 1) if i else 0 : self._ends.select(i)]

    def places(self, doc_id: int) -> range:
        """The documents with an id, by a binary search that selects a few of them."""
        wanted, known = doc_id - self._least, range(self._docs.count)
        first = bisect_left(known, wanted, key=self._docs.select)
        return range(self.nulls + first, self.nulls + bisect_right(known, wanted, lo=first, key=self._docs.select))


def _writer(tokenizer: str, spaced: bool, end_id: int, block_ids: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoder(tokenizer, spaced)
        encode, width = tokens.ids, tokens.width
        end = np.array([end_id], f"<u{width}").tobytes()
        bucket, block, size = None, 0, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []

        def flushed() -> pd.DataFrame:
            known = [d for d in doc_ids if d is not None]
            ends = (known[0], known[-1]) if known else (None, None)
            row = (bucket, block, len(doc_ids), size, *ends, encode_block(doc_ids, ids, width))
            names = ["bucket", "block", "n_docs", "n_ids", "first_id", "last_id", "data"]
            return pd.DataFrame([row], columns=names, dtype=object)

        for batch in batches:
            for at, null, doc_id, text in zip(
                batch["bucket"], batch["doc_id"].isna(), batch["doc_id"], batch["text"], strict=True
            ):
                if doc_ids and (at != bucket or size >= block_ids):
                    yield flushed()
                    block = block + 1 if at == bucket else 0
                    doc_ids, ids, size = [], [], 0
                bucket = at
                found = encode(text or "") + end
                doc_ids.append(None if null else int(doc_id))
                ids.append(found)
                size += len(found) // width
        if doc_ids:
            yield flushed()
        tokens.forget()

    return lean(write)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, spaced: bool = False, end_id: int = 1, block_ids: int = BLOCK_IDS
) -> None:
    """Encode every whole text, append `end_id`, and write the ids in ascending doc_id order.

    The folder holds Parquet files whose rows are blocks of the format above, so Spark's
    committer makes a retried task harmless and any file system serves. A block ends at the
    first document that reaches `block_ids`, which bounds what a task holds besides one
    document; `bucket` and `block` order the blocks, and each carries its smallest and largest
    id. An id takes two bytes, or four where the tokenizer has more than 65,536.

    Null texts are empty and become the end id alone. Null ids come first; rows with an equal
    id are ordered by text and all written. An empty table writes no blocks.
    """
    partitions = shuffle_partitions(docs)
    base = docs.select(F.col("doc_id").cast("bigint"), "text")
    placed = id_buckets(base, "doc_id", "bucket", 8 * partitions)
    dealt = placed.repartition(partitions, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "text")
    # a nullable id arrives in pandas as a float, which would round large ones
    sent = dealt.select("bucket", F.col("doc_id").cast("string").alias("doc_id"), "text")
    sent.mapInPandas(_writer(tokenizer, spaced, end_id, block_ids), COLUMNS).write.parquet(path)


def _reader(digest: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for base, data in zip(batch["base"], batch["data"], strict=True):
                block = Block(data)
                bounds = np.array([0, *map(block.end, range(block.count))], np.int64)  # an end starts the next
                parts = [block.ids(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": pd.array(block.doc_ids(), "Int64"), "start": bounds[:-1] + base})
                out["n_tokens"] = np.diff(bounds)
                if digest:
                    out["ids_crc32"] = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
                else:
                    out["ids"] = [p.astype(np.int32) for p in parts]
                yield out

    return lean(read)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Per document of a folder: doc_id, start, n_tokens and its ids, or their crc32.

    start counts the ids of all documents before it. It comes from the blocks' counts, of
    which the totals per bucket alone are summed in one task.
    """
    blocks = spark.read.schema(COLUMNS).parquet(path)
    sizes = blocks.select("bucket", "block", "n_ids")
    earlier = Window.partitionBy("bucket").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    totals = sizes.groupBy("bucket").agg(F.sum("n_ids").alias("total"))
    offsets = totals_before(totals, "bucket", "total", "before")
    bases = inside.join(offsets, "bucket").select("bucket", "block", (F.col("inside") + F.col("before")).alias("base"))
    rows = blocks.select("bucket", "block", "data").join(small_side(bases), ["bucket", "block"]).select("base", "data")
    last = "ids_crc32 bigint" if digest else "ids array<int>"
    return rows.mapInPandas(_reader(digest), f"doc_id bigint, start bigint, n_tokens bigint, {last}")


def find_documents(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """doc_id and ids of the documents with one of a few stated ids, rows with a repeated id included.

    Only blocks whose range holds one of them are read, and inside a block two selects lead to
    a document's ids. An id that no document has gives no row; null ids cannot be asked for.
    """
    wanted = sorted(set(doc_ids))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                block = Block(data)
                rows = [(d, block.document(i).astype(np.int32)) for d in wanted for i in block.places(d)]
                yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    ranges = [(F.col("first_id") <= d) & (F.col("last_id") >= d) for d in wanted]
    blocks = spark.read.schema(COLUMNS).parquet(path).where(reduce(or_, ranges, F.lit(False))).select("data")
    return blocks.mapInPandas(lean(find), "doc_id bigint, ids array<int>")
