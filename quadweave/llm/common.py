"""Shared pieces: reading tables, slicing Arrow texts, and vectorised hashes of words.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Those bytes never occur
inside a multi-byte UTF-8 character, so splitting bytes equals splitting text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Texts are handled in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 2_000_000

WORD_SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def held_out(column: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{wish}"
    while name.lower() in taken:
        name += "_"
    return name


# ---------------------------------------------------------------- Arrow texts


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of about limit bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


# ---------------------------------------------------------------- hashes

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_K = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(256, np.uint64)


def powers(n: int, base: np.uint64 = _K) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        if n:
            out[0] = 1
        return np.multiply.accumulate(out)


_POWERS = powers(256)


def mix(x: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit words (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts_of_docs: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in data, and where each document's words begin.

    data: the bytes of some texts, one after the other; starts_of_docs: their
    offsets in it. fold: A-Z count as a-z. The second result has one entry
    more than there are documents.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts_of_docs) + 1, np.int64)
    separator = _SEPARATOR[data]
    inside = ~separator
    first, last = inside.copy(), inside.copy()
    first[1:] &= separator[:-1]
    last[:-1] &= separator[1:]
    at = starts_of_docs[starts_of_docs < n]
    first[at] = inside[at]
    at = at[at > 0] - 1
    last[at] = inside[at]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    pointers = np.append(np.searchsorted(begin, starts_of_docs), len(begin))
    if not len(begin):
        return np.zeros(0, np.uint64), pointers
    size = end - begin
    table = _FOLDED if fold else _BYTE
    place = np.flatnonzero(inside)
    sizes_before = np.concatenate([[0], np.cumsum(size)[:-1]])
    power = _POWERS if size.max() <= len(_POWERS) else powers(int(size.max()))
    with np.errstate(over="ignore"):
        value = table[data[place]] * power[place - np.repeat(begin, size)]
        return mix(np.add.reduceat(value, sizes_before) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), pointers


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i:i+width] for every i; windows may cross documents, callers leave those out."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        if width <= 8:
            for k, p in enumerate(powers(width, np.uint64(0xC2B2AE3D27D4EB4F))):
                out += words[k : k + n] * p
            return mix(out)
        base = np.uint64(0xC2B2AE3D27D4EB4F)
        inverse = np.uint64(pow(int(base), -1, 2**64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(len(words), base), dtype=np.uint64)])
        return mix((sums[width:] - sums[:-width]) * powers(n, inverse))
