"""Near-duplicates by HyperMinHash registers, banded, estimated and then confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.llm.graph import components
from merchantry.llm.memory import lean
from merchantry.llm.words import common, mixed, set_key, shingle_set
from merchantry.operators.joins import small_side
from merchantry.sources.shared import written

BANDS = 30
ROWS = 5
REGISTERS = 300
ERRORS = 4.5
MANTISSA = 10
VALUE_BITS = 52
EMPTY = 0xFFFF
BLOCK = 1024
FOREST_BANDS = 10
SALT = np.uint64(0x2545F4914F6CDD1D)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash of a shingle set: per bucket the smallest hash value, kept as its number
    of leading zeros (6 bits) and the ten bits after the leading one. Empty buckets are EMPTY."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if not len(hashes):
        return out
    value = mixed(hashes ^ SALT)
    bucket = (hashes >> np.uint64(32)) % np.uint64(REGISTERS)
    keys = np.sort((bucket << np.uint64(VALUE_BITS)) | (value >> np.uint64(64 - VALUE_BITS)))
    at = keys >> np.uint64(VALUE_BITS)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    least = keys[first] & np.uint64((1 << VALUE_BITS) - 1)
    zeros = (VALUE_BITS - np.frexp(least.astype(np.float64))[1]).astype(np.uint64)
    after = (least << (zeros + np.uint64(1))) & np.uint64((1 << VALUE_BITS) - 1)
    out[at[first].astype(np.int64)] = (zeros << np.uint64(MANTISSA)) | (after >> np.uint64(VALUE_BITS - MANTISSA))
    return out


def banded_registers(rows: np.ndarray) -> np.ndarray:
    """The registers that feed the bands: those of BANDS * ROWS buckets, each the smaller value of
    the buckets that are equal modulo that number, so that every hash has a place in a band."""
    parts = rows.reshape(len(rows), -1, BANDS * ROWS)
    # smaller values have more leading zeros, then a smaller mantissa; empty ones come last
    order = np.where(parts == EMPTY, -1, parts.astype(np.int32) ^ ((1 << MANTISSA) - 1))
    return np.take_along_axis(parts, order.argmax(axis=1)[:, None, :], axis=1)[:, 0, :]


def octaves(n: np.ndarray) -> np.ndarray:
    """Chance that the smallest of n / REGISTERS values has 0, 1, ... leading zeros, a row per n."""
    ends = np.exp2(-np.arange(VALUE_BITS + 1, dtype=np.float64))
    survive = np.exp(-np.outer(n / REGISTERS, ends))
    return survive[:, 1:] - survive[:, :-1]


def estimate(a: np.ndarray, b: np.ndarray, a_octaves: np.ndarray, b_octaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarity of rows of registers, and the number of registers used.

    Registers of unrelated sets agree by chance when their smallest values fall into the
    same octave and then the same mantissa. That chance is computed from the set sizes and
    taken out of the share of equal registers.
    """
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(axis=1), 1)
    same = ((a == b) & used).sum(axis=1) / n
    chance = (a_octaves * b_octaves).sum(axis=1) / (1 << MANTISSA)
    return (same - chance) / (1 - chance), n


def passes(est: np.ndarray, n: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a pair may reach the threshold: by its estimate, within ERRORS standard errors,
    and by its sizes, which the threshold bounds exactly.

    Every register in use shows one element of the union, drawn without replacement, so the
    error vanishes as their number comes near to the size of the union.
    """
    t = percent / 100
    sized = 100 * np.minimum(sizes_a, sizes_b) >= percent * np.maximum(sizes_a, sizes_b)
    unseen = np.clip(1 - n * (1 + t) / (sizes_a + sizes_b), 0, 1)
    return sized & (est >= t - ERRORS * np.sqrt(t * (1 - t) / n * unseen) - 1 / n)


def _described(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            found = shingle_set(text)
            rows.append((len(found), set_key(found), registers(found).tobytes() if len(found) else None))
        yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "registers"])


def signatures(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_key and registers (null without words)."""
    described = F.pandas_udf(lean(_described), "n_shingles bigint, set_key binary, registers binary")
    found = docs.select(F.col("doc_id").cast("bigint"), described("text").alias("found"))
    return found.select("doc_id", "found.*")


def _fold(registers: pd.Series) -> pd.Series:
    return pd.Series([r.tobytes() for r in banded_registers(_rows_of(registers))], dtype=object)


def _bands() -> Column:
    """A key for every band of `banded_registers`, null where all of the band are empty."""
    width = 2 * ROWS

    def key(i: Column) -> Column:
        piece = F.substring(F.col("banded"), i * F.lit(width) + F.lit(1), F.lit(width))
        return F.when(piece != F.lit(b"\xff" * width), F.xxhash64(i, piece))

    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)


def _rows_of(column: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def _confirmer(percent: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[tuple, np.ndarray] = {}
            linked = []
            sizes = [batch["n_a"].to_numpy(np.float64), batch["n_b"].to_numpy(np.float64)]
            est, used = estimate(
                _rows_of(batch["registers_a"]), _rows_of(batch["registers_b"]), octaves(sizes[0]), octaves(sizes[1])
            )
            likely = batch[passes(est, used, *sizes, percent)]
            for row in likely.itertuples(index=False):
                sets = []
                for node, key, text in ((row.a, row.key_a, row.text_a), (row.b, row.key_b, row.text_b)):
                    if (node, text) not in known:
                        if len(known) > 32:
                            known.clear()
                        found = shingle_set(text)
                        known[node, text] = found if set_key(found) == bytes(key) else None
                    sets.append(known[node, text])
                if sets[0] is None or sets[1] is None:  # another text under the same doc_id
                    continue
                both = common(sets[0], sets[1])
                if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both):
                    linked.append((row.a, row.b))
            yield pd.DataFrame(linked, columns=["a", "b"], dtype="int64")

    return lean(confirm)


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets reach the threshold."""
    sides = [pairs.select(F.col(c).alias("node")).distinct() for c in ("a", "b")]
    wanted = sides[0].union(sides[1]).distinct()
    chosen = nodes.join(wanted, "node")
    text = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text").where("text is not null")
    same = F.col("_id").eqNullSafe(F.col("doc_id"))
    texts = written(text.join(chosen, same).drop("_id", "doc_id"), "texts")

    def side(name: str) -> DataFrame:
        renamed = {"node": name, "set_key": f"key_{name}", "n_shingles": f"n_{name}"}
        return texts.select(
            *[F.col(c).alias(renamed.get(c, f"{c}_{name}")) for c in texts.columns]
        )

    # the join on the centre comes last, so that its rows arrive together
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.mapInPandas(_confirmer(percent), "a bigint, b bigint")


class _Forest:
    """Disjoint sets of the members of a block."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[i] = j
        return i != j


def _block_pairs(members: list, band: int, same_block: bool, percent: int, every: bool) -> list[tuple[int, int]]:
    """Pairs of a block that may reach the threshold and are in different components.

    Either a spanning forest of the best estimates, fewer pairs than members, or `every` pair,
    each in the first band that its nodes share only.
    """
    nodes = np.array([m["node"] for m in members])
    comps = np.array([m["comp"] for m in members])
    sides = np.array([m["side"] for m in members])
    sizes = np.array([m["n_shingles"] for m in members], np.float64)
    rows = _rows_of(m["registers"] for m in members)
    chances = octaves(sizes)
    found = []
    for i in range(len(nodes) - 1):
        wanted = comps[i + 1 :] != comps[i]
        if not same_block:
            wanted &= sides[i + 1 :] != sides[i]
        other = np.flatnonzero(wanted) + i + 1
        if len(other):
            est, used = estimate(rows[i][None, :], rows[other], chances[i][None, :], chances[other])
            near = passes(est, used, sizes[i], sizes[other], percent)
            found += [(e, i, j) for e, j in zip(est[near].tolist(), other[near].tolist(), strict=True)]
    if every:
        banded = banded_registers(rows).reshape(-1, BANDS, ROWS)
        full = (banded != EMPTY).any(axis=2)
        kept = [(i, j) for _, i, j in found if ((banded[i] == banded[j]).all(axis=1) & full[i]).argmax() == band]
    else:
        forest = _Forest(len(nodes))
        kept = [(i, j) for _, i, j in sorted(found, reverse=True) if forest.join(i, j)]
    return [(int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))) for i, j in kept]


def _pairs_in_buckets(members: DataFrame, nodes: DataFrame, percent: int, every: bool) -> DataFrame:
    """Candidate pairs (a < b) inside the buckets of members (bucket, band, node, comp).

    A bucket is compared in pairs of blocks of about BLOCK members, so its size bounds no task.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [
                pair
                for band, i, j, rows in zip(batch["band"], batch["i"], batch["j"], batch["members"], strict=True)
                for pair in _block_pairs(rows, band, i == j, percent, every)
            ]
            yield pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    spread = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    spread = spread.where("lo != hi").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = members.join(spread, "bucket").withColumn("x", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    rest = rest.withColumn("y", F.explode(F.expr("sequence(0, blocks - 1)")))
    rest = rest.join(nodes.select("node", "n_shingles", "registers"), "node")
    member = F.struct("node", "comp", F.col("x").alias("side"), "n_shingles", "registers")
    grouped = rest.groupBy("bucket", "band", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).agg(
        F.collect_list(member).alias("members")
    )
    return grouped.drop("bucket").mapInPandas(lean(compare), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, and its shingle set's key.

    Documents with 100 * intersection >= percent * union of their five-word shingle sets are
    linked; component_id is the smallest doc_id reachable, kept says doc_id = component_id.

    1. Each text becomes a set key and HyperMinHash registers in one pass. Equal sets form
       one node, so copies of any number cost one row each and are never paired.
    2. Nodes are bucketed by bands of registers. Inside the larger buckets of the first
       FOREST_BANDS bands the collision-corrected estimates give a spanning forest of the best
       pairs, fewer than there are members; these are confirmed on the full sets, which joins
       most of a dense group.
    3. In the buckets of all bands, pairs in different components that may pass the threshold
       are all confirmed as well. A pair inside a component is never expanded.
    The bands take in all hashes of a set. A pair at the threshold shares no band with a chance
    of about 2e-8 if its sets are long (7e-6 at 80 percent). Sets with c common shingles and one
    more in either do with one of at most 30 ** -c (1.4e-9 for 6 against 7 shingles, the smallest
    that can be linked; 1.2e-6 for 4 against 5 at 80 percent). It is estimated too low to be
    confirmed with a chance of about 4e-6.

    Null or empty texts and texts without words have no shingles and stay alone. A null
    doc_id is kept as a document; it never becomes the component_id of another one. Rows
    repeated as a whole are all returned. An empty table gives no rows.
    """
    rows = written(signatures(docs), "signatures")
    shingled = rows.where("set_key is not null")
    nodes = shingled.groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"),
        F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("registers").alias("registers"),
    )
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # ids are fixed by writing
    folded = nodes.select("node", F.pandas_udf(_fold, "binary")("registers").alias("banded"))
    banded = folded.select("node", F.posexplode(_bands()).alias("band", "bucket")).where("bucket is not null")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(shared, "bucket"), "buckets")

    crowds = members.where((F.col("n") > 2) & (F.col("band") < FOREST_BANDS)).select("bucket", "band", "node")
    forest = _pairs_in_buckets(crowds.withColumn("comp", F.col("node")), nodes, percent, every=False)
    tried = written(forest, "pairs")
    links = written(_confirmed(tried, nodes, docs, percent), "confirmed")
    roots = written(components(links), "roots")

    parted = members.select("bucket", "band", "node").join(roots, "node", "left")
    parted = parted.withColumn("comp", F.coalesce("root", "node")).drop("root")
    more = _pairs_in_buckets(parted, nodes, percent, every=True)
    more = written(more.join(tried, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = written(links.union(_confirmed(more, nodes, docs, percent)), "confirmed")
        roots = written(components(links), "roots")

    least = nodes.join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    moved = roots.join(least, "root").select("node", "component_id")
    classes = nodes.join(moved, "node", "left").select(
        F.col("set_key").alias("_key"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
    out = rows.join(classes, F.col("set_key") == F.col("_key"), "left")
    component = F.coalesce(F.when(F.col("set_key").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "set_key",
    )


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each group: that of the smallest doc_id.

    Rows whose id stands once, all of them as a rule, are kept or dropped by id. Where an id
    is repeated, rows are told apart by their shingle set as well, and of equal ones one is
    kept. Texts without words have no duplicates and all stay.
    """
    verdict = written(near_duplicates(docs, percent), "verdict")
    marks = verdict.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("any"))
    marks = marks.where("n > 1 or not any").select(F.col("doc_id").alias("_id"), (F.col("n") > 1).alias("_again"))
    marks = written(marks, "marks")  # ids to drop, and ids that are repeated
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id").join(small_side(marks), same, "left")
    once = rows.where("_again is null").select("_row.*")
    if marks.where("_again").isEmpty():
        return once

    key = F.pandas_udf(lambda texts: pd.Series([set_key(shingle_set(t)) for t in texts], dtype=object), "binary")
    again = rows.where("_again").select("_row", "_id").withColumn("_key", key(F.col("_row.text")))
    keep = verdict.where("kept and set_key is not null").groupBy("doc_id", "set_key").agg(F.lit(True).alias("keep"))
    keep = keep.withColumnsRenamed({"doc_id": "_of", "set_key": "_set"})
    chosen = again.join(keep, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_set")))
    first = chosen.groupBy("_id", "_key").agg(F.first("_row").alias("_row")).select("_row.*")
    empty = again.where("_key is null").select("_row.*")
    return once.union(first).union(empty)
