"""Words, word shingles and their 64-bit hashes, computed inside tasks with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
FOLD = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
SHIFT = np.uint64(33)


def split_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lowered, cut at space and U+0009 to U+000D only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    values = (values ^ (values >> SHIFT)) * MIX_A
    values = (values ^ (values >> SHIFT)) * MIX_B
    return values ^ (values >> SHIFT)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def folded(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash per window of `size` neighbouring word hashes, order included."""
    last = len(hashes) - size + 1
    out = hashes[:last].copy()
    for k in range(1, size):
        out = out * FOLD + hashes[k : k + last]
    return mixed(out + np.uint64(size))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Hash of every shingle in text order, repeats included.

    A text with fewer words than `size` is one shingle, a text without words has none.
    """
    if not words:
        return np.empty(0, np.uint64)
    return folded(word_hashes(words), min(size, len(words)))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    return np.unique(shingle_hashes(split_words(text), size))


def set_key(hashes: np.ndarray) -> bytes | None:
    """128-bit digest of a shingle set; None for an empty one."""
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays of distinct values."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
