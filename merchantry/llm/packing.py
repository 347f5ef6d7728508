"""Best-fit packing by the sum-of-squares rule."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.memory import lean
from merchantry.llm.tokens import encoder
from merchantry.sources.shared import written

CAPACITY = 1024
GROUP_ROWS = 20_000
NEVER = np.iinfo(np.int64).max


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the rest."""
    first = n - capacity * (-(-n // capacity) - 1)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def sum_of_squares(lengths: np.ndarray, capacity: int, any_fit: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, longest items first.

    With N(g) open bins of residual gap g, an item goes where the sum of N(g) squared
    becomes smallest: into a bin of some gap, or into a new one. With `any_fit` a new bin is
    opened only when no open one has room. Full bins leave the count.
    """
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    chosen, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        gained = 2 * count[: capacity + 1 - size] + 1
        gained[0] = 0
        cost = np.where(count[size:] > 0, gained - 2 * count[size:] + 1, NEVER)
        best = int(cost.argmin())
        if cost[best] == NEVER or (not any_fit and gained[capacity - size] < cost[best]):
            at, gap = opened, capacity
            opened += 1
        else:
            gap = size + best
            at = bins[gap].pop()
            count[gap] -= 1
        chosen[i], offset[i] = at, capacity - gap
        if gap > size:
            bins[gap - size].append(at)
            count[gap - size] += 1
    return chosen, offset


def pack_items(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and whether the bin is full. Items of bins that stayed open are packed once
    more by themselves, without opening a bin while one has room."""
    bins, offsets = sum_of_squares(lengths, capacity)
    levels = np.bincount(bins, lengths).astype(np.int64) if len(bins) else np.empty(0, np.int64)
    rest = np.flatnonzero(levels[bins] < capacity)
    if len(rest):
        again, places = sum_of_squares(lengths[rest], capacity, any_fit=True)
        if again.max() + 1 <= (levels < capacity).sum():
            bins[rest], offsets[rest] = again + len(levels), places
    levels = np.bincount(bins, lengths)
    return bins, offsets, levels[bins] >= capacity


def token_pieces(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, capacity: int, keep_ids: bool) -> DataFrame:
    """The pieces of every document, with the crc32 of their ids and, if asked for, the ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = encoder(tokenizer, spaced)
        encode, kind = found.ids, f"<u{found.width}"
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.frombuffer(encode(text or "") + end, kind).astype("<u4")
                for piece, (start, length) in enumerate(cut_points(len(ids), capacity)):
                    own = ids[start : start + length].tobytes()
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), own if keep_ids else None))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        found.forget()

    schema = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"
    # a nullable id arrives in pandas as a float, which would round large ones
    found = docs.select(F.col("doc_id").cast("bigint").cast("string"), "text").mapInPandas(lean(cut), schema)
    return found if keep_ids else found.drop("ids")


def pack(
    docs: DataFrame,
    tokenizer: str,
    spaced: bool = True,
    end_id: int = 2,
    capacity: int = CAPACITY,
    keep_ids: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, 32-bit
    little-endian, with `keep_ids`). Only documents longer than a sequence are cut.

    Full pieces are sequences by themselves. The others are dealt at random into groups of
    about `group_rows`, each packed in one task. Bins that a group fills to the last token
    are final; the pieces of its other bins go to the next round, in fewer groups, so that
    only the last group leaves sequences with room. A round that places less than a tenth,
    as when no lengths fit together, ends the search: its groups keep what they have.
    Rounds are written to the shared folder. Their number grows with the logarithm of the
    number of documents, and no task or driver sees more than a group.

    A null text is packed as the end id alone. Null ids and repeated rows are packed like any
    others. An empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer, spaced, end_id, capacity, keep_ids)
    # the row number tells equal rows apart; writing fixes it
    pieces = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in pieces.columns if c != "_row"]
    whole = pieces.where(F.col("length") == capacity).select(
        *columns, (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    out, rest = [whole], pieces.where(F.col("length") < capacity)
    n, level, last = rest.count(), 0, False
    while n:
        groups = max(1, math.ceil(n / group_rows))
        last = last or groups == 1
        placed = written(_packed_groups(rest, groups, level, capacity), "packed")
        closed = placed if last else placed.where("_full")
        out.append(closed.select(*columns, "sequence_id", "offset"))
        if last:
            break
        rest = placed.where("not _full").select(*columns, "_row")
        left = rest.count()
        last = left > 0.9 * n  # the next round is the last one
        n, level = left, level + 1
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _packed_groups(rest: DataFrame, groups: int, level: int, capacity: int) -> DataFrame:
    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, full = pack_items(rows["length"].to_numpy(), capacity)
        number = (level << 56) + rows["_group"].to_numpy() * (1 << 24) + bins
        return rows.drop(columns="_group").assign(sequence_id=number, offset=offsets, _full=full)

    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(groups)))
    fields = ", ".join(f"{name} {kind}" for name, kind in rest.dtypes)
    return dealt.groupBy("_group").applyInPandas(
        pack_group, f"{fields}, sequence_id bigint, offset bigint, _full boolean"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence, from a result with `keep_ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return joined.select("sequence_id", "n_tokens", ids.alias("ids"))
