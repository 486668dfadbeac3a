"""Shared helpers of the text operators: Arrow slicing, word finding and vectorised hashes.

Hashes of spans are polynomial modulo 2**64 and only propose matches: every
operator that acts on equality of texts compares the texts themselves.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: larger than any other

_powers: dict[int, np.ndarray] = {}
#: Tables that a worker keeps from batch to batch.
KEPT: list[dict] = [_powers]


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def schema_with(frame: DataFrame, names, more: str) -> StructType:
    """The fields ``names`` of the frame, then those of the DDL string."""
    return StructType([*frame.select(*names).schema.fields, *StructType.fromDDL(more).fields])


def free_name(name: str, taken) -> str:
    """The name, or one like it that is not taken."""
    return next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if n not in taken)


def set_aside(frame: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with all but the needed columns in one struct, so that no name clashes with those an operator
    adds, and a function that gives a frame with these columns the first frame's columns back, and drops others.
    """
    rest = [c for c in frame.columns if c not in needed]
    packed = frame.select(*(c for c in frame.columns if c in needed), *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_aside")] if rest else []))

    def restore(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(f"_aside.`{c}`").alias(c) if c in rest else F.col(c) for c in frame.columns))

    return packed, restore


def give_back() -> None:
    """Hands memory that is no longer used back to the system: workers live on, and what one step needed must not be held through the next."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def forget_tables() -> None:
    """Drops what earlier steps kept in this worker for their next batches; whoever needs a table again makes it anew."""
    for table in KEPT:
        table.clear()
    give_back()


def crc_part(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words, so that all bits of a hash are usable."""
    x = x ^ (x >> U64(31))
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); kept up to 4 M entries for the worker's next batches, a power of two so that they are seldom made anew."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        size = 1 << max(16, int(n).bit_length())
        kept = np.full(size, base, U64)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if size <= 1 << 22:
            _powers[int(base)] = kept
    return kept[:n]


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """H with len+1 entries; see span_hash."""
    out = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * powers(BASE, len(symbols)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of symbols[start:end], the same wherever the span stands."""
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of each k consecutive symbols, by doubling."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    part, width, factor = symbols, 1, BASE
    out, done = None, 0
    rest = k
    while True:
        if rest & 1:
            shifted = part[done : done + n] if done else part[:n]
            if out is None:
                out = shifted.copy()
            else:
                out *= factor
                out += shifted
            done += width
        rest >>= 1
        if not rest:
            return mixed(out)
        part = part[:-width] * factor + part[width:]
        factor = U64(int(factor) * int(factor) & 0xFFFFFFFFFFFFFFFF)
        width *= 2


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n+1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``rows`` rows and ``limit`` bytes each, or of one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = min(low + rows, max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1))
        yield low, high
        low = high


def doc_slices(batches, limit: int = 1 << 20, rows: int = 1 << 30, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts, offsets) for runs of rows of a bounded size."""
    for batch in batches:
        data, offsets = buffers(batch.column(text))
        for low, high in slices(offsets, limit, rows):
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


#: True for the bytes of a word: all but space and \t \n \v \f \r.
SOLID = np.ones(256, bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: True for digits, letters and all bytes of other code points than ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Symbol of each byte in the hashes, never 0.
SYMBOL = mixed(np.arange(1, 257, dtype=U64))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (n+1 entries)."""
    n = len(data)
    inside = table[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:n])
    after = np.empty(n + 1, bool)
    after[:n] = inside
    after[n] = False
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each word."""
    return mixed(span_hash(prefix_hashes(SYMBOL[data]), starts, ends))


def numbered_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word of ``words(data, ..)``, equal for equal words only, and the distinct words by number."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[SOLID[data]])])
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def xxh64_of(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each of these words."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w, seed) for w in distinct.to_pylist()], U64)


LONG = 32


def safe_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, distinct: pa.Array, number: np.ndarray) -> np.ndarray:
    """A hash of each distinct word: polynomial for short words, among which no two are equal by their form, XXH64 for those of more than LONG bytes."""
    first = np.empty(len(distinct), np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    out = word_hashes(data, starts[first], ends[first])
    long = np.flatnonzero((ends - starts)[first] > LONG)
    out[long] = xxh64_of(distinct.take(pa.array(long)))
    return out


def owners(first: np.ndarray) -> np.ndarray:
    """For first with n+1 entries: the index of the row that holds each item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start+1 .. for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def hash_share(column_: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone; it picks the same sample everywhere."""
    return F.xxhash64(F.col(column_), F.lit(seed)) / F.lit(2.0**64) + F.lit(0.5)


def ids_of(column_: pa.Array) -> np.ndarray:
    """doc_id as int64, NO_ID for null."""
    if isinstance(column_, pa.ChunkedArray):
        column_ = column_.combine_chunks()
    return np.asarray(pc.fill_null(column_, NO_ID).to_numpy(zero_copy_only=False), np.int64)
