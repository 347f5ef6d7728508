"""Bounded training samples: which rows may be learned from, and how many of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDS = 4
HELD_OUT = 2


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept back from learning: crc32 of its id as text leaves remainder 2 by 4.

    A null id counts as the empty text.
    """
    fold = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS
    return fold == HELD_OUT


def sampled(doc_id: str, available: int | Column, bound: int) -> Column:
    """Whether a row is among about `bound` of `available` rows, by a hash of its id; all if there are fewer."""
    rows = F.greatest(F.lit(available), F.lit(1))
    share = F.floor(F.least(F.lit(1.0), F.lit(float(bound)) / rows) * (1 << 30))
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id)), F.lit(1 << 30)) < share
