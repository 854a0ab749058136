"""Integer codecs of posting blocks: frame of reference, its delta form, plain."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTHS = (2, 4, 5, 6, 8, 10, 16, 32)


def width(largest: int) -> int:
    """The smallest of WIDTHS that holds a value."""
    return next(w for w in WIDTHS if largest < 1 << w)


def width_column(largest: Column) -> Column:
    out = F.lit(32)
    for w in reversed(WIDTHS[:-1]):
        out = F.when(largest < 1 << w, w).otherwise(out)
    return out


def pack(values: list[int]) -> bytes:
    """One byte of width, then 32-bit words, each with as many values as fit."""
    if not values:
        return b""
    w = width(max(values))
    fit = 32 // w
    words = [0] * -(-len(values) // fit)
    for i, v in enumerate(values):
        words[i // fit] |= v << i % fit * w
    return struct.pack(f"<B{len(words)}I", w, *words)


def unpack(blob: bytes, n: int) -> list[int]:
    if not n:
        return []
    w = blob[0]
    fit = 32 // w
    words = struct.unpack(f"<{(len(blob) - 1) // 4}I", blob[1:])
    return [words[i // fit] >> i % fit * w & (1 << w) - 1 for i in range(n)]


def pack_delta(values: list[int]) -> bytes:
    """First value and differences of a sequence that doesn't decrease."""
    return pack([b - a for a, b in zip([0, *values], values, strict=False)])


def unpack_delta(blob: bytes, n: int) -> list[int]:
    out, at = [], 0
    for d in unpack(blob, n):
        at += d
        out.append(at)
    return out


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an array of lists one after another, and the lists' lengths (null: 0)."""
    values = lists.flatten()
    if values.null_count:
        raise ValueError("a list holds a null")
    return values.to_numpy().astype(np.int64), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def _ends(sizes: np.ndarray, nulls: pa.Array) -> pa.Array:
    """Offsets of lists of these lengths, null where ``nulls`` is."""
    ends = np.append(0, np.cumsum(sizes))
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch holds too many values")
    return pa.array(ends.astype(np.int32), mask=np.append(nulls.is_null().to_numpy(zero_copy_only=False), False))


def _listed(values: np.ndarray, sizes: np.ndarray, nulls: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(_ends(sizes, nulls), pa.array(values.astype(np.int64)))


def _within(sizes: np.ndarray) -> np.ndarray:
    """The index of each value in its list."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def differences(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """First value and differences of each list."""
    out = np.diff(values, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[starts] = values[starts]
    return out


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums of each list."""
    before = np.append(0, np.cumsum(values))
    return before[1:] - np.repeat(before[np.cumsum(sizes) - sizes], sizes)


def pack_lists(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pack`` of many lists: their bytes one after another, and the numbers of bytes."""
    if len(values) and (values.min() < 0 or values.max() >= 1 << 32):
        raise ValueError("a value doesn't fit 32 bits")
    some = sizes > 0
    w = np.full(len(sizes), WIDTHS[0])
    w[some] = np.array(WIDTHS)[np.searchsorted([1 << x for x in WIDTHS], np.maximum.reduceat(values, (np.cumsum(sizes) - sizes)[some]), "right")] if some.any() else 0
    fit = 32 // w
    words = -(-sizes // fit)
    at, of = np.divmod(_within(sizes), np.repeat(fit, sizes))
    shifted = values.astype(np.uint64) << (of * np.repeat(w, sizes)).astype(np.uint64)
    made = np.bitwise_or.reduceat(shifted, np.flatnonzero(of == 0)) if len(values) else shifted
    length = np.where(some, 1 + 4 * words, 0)
    starts = np.cumsum(length) - length
    out = np.empty(length.sum(), np.uint8)
    out[starts[some]] = w[some]
    out[(np.repeat(starts + 1, words) + 4 * _within(words))[:, None] + np.arange(4)] = made.astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, length


def unpack_lists(data: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of lists of these sizes, of bytes that ``pack_lists`` made."""
    starts = np.cumsum(length) - length
    some = sizes > 0
    w = np.full(len(sizes), WIDTHS[0])
    w[some] = data[starts[some]]
    at, of = np.divmod(_within(sizes), np.repeat(32 // w, sizes))
    words = data[(np.repeat(starts + 1, sizes) + 4 * at)[:, None] + np.arange(4)].view("<u4").ravel().astype(np.uint64)
    w = np.repeat(w, sizes).astype(np.uint64)
    return (words >> of.astype(np.uint64) * w & (np.uint64(1) << w) - np.uint64(1)).astype(np.int64)


def deltas(values: Column) -> Column:
    """First value and differences of an array."""

    def run(lists: pa.Array) -> pa.Array:
        own, sizes = flat(lists)
        return _listed(differences(own, sizes), sizes, lists)

    return F.arrow_udf(run, "array<bigint>")(values)


def restored(diffs: Column) -> Column:
    """Running sums of an array, in one pass over it."""

    def run(lists: pa.Array) -> pa.Array:
        own, sizes = flat(lists)
        return _listed(sums(own, sizes), sizes, lists)

    return F.arrow_udf(run, "array<bigint>")(diffs)


def to_bytes(values: np.ndarray, sizes: np.ndarray, codec: str) -> tuple[np.ndarray, np.ndarray]:
    """Many lists in a codec of CODECS: their bytes one after another, and the numbers of bytes."""
    if codec in ("for", "for-delta"):
        return pack_lists(differences(values, sizes) if codec == "for-delta" else values, sizes)
    if len(values) and (values.min() < 0 or values.max() >= 1 << 32):
        raise ValueError("a value doesn't fit 32 bits")
    plain = values.astype("<u4").view(np.uint8)
    if codec == "plain":
        return plain, 4 * sizes
    ends, raw = (4 * np.cumsum(sizes)).tolist(), plain.tobytes()
    parts = [deflated(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
    return np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64)


def of_bytes(data: np.ndarray, length: np.ndarray, sizes: np.ndarray, codec: str) -> np.ndarray:
    """The values of lists of these sizes, of bytes that ``to_bytes`` made."""
    if codec in ("for", "for-delta"):
        values = unpack_lists(data, length, sizes)
        return sums(values, sizes) if codec == "for-delta" else values
    if codec == "gzip":
        ends, raw = np.cumsum(length).tolist(), data.tobytes()
        parts = [zlib.decompress(raw[a:b]) if b > a else b"" for a, b in zip([0, *ends], ends, strict=False)]
        data, length = np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64)
    if (length != 4 * sizes).any():
        raise ValueError("bytes of another length")
    return data.view("<u4").astype(np.int64)


def packed(values: Column, codec: str = "for") -> Column:
    """The bytes of an array of integers in a codec of CODECS."""

    def run(lists: pa.Array) -> pa.Array:
        own, sizes = flat(lists)
        data, length = to_bytes(own, np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, sizes), codec)
        blobs = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(np.append(0, np.cumsum(length)).astype(np.int32)), pa.py_buffer(data)])
        return pc.if_else(lists.is_valid(), blobs, pa.scalar(None, pa.binary()))

    return F.arrow_udf(run, "binary")(values)


def unpacked(blob: Column, n: Column, codec: str = "for") -> Column:
    """The ``n`` integers of bytes that ``packed`` made."""

    def run(blobs: pa.Array, n: pa.Array) -> pa.Array:
        valid = blobs.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(valid, pc.fill_null(n, 0).to_numpy().astype(np.int64), 0)
        length = pc.fill_null(pc.binary_length(blobs), 0).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(x for x in blobs.to_pylist() if x), np.uint8)
        return _listed(of_bytes(data, length, sizes, codec), sizes, blobs)

    return F.arrow_udf(run, "array<bigint>")(blob, n)


def round_trips(values: Column) -> Column:
    """For each of CODECS, by name, whether an array is the same after packing and unpacking."""

    def run(lists: pa.Array) -> pa.Array:
        own, sizes = flat(lists)
        out = np.empty((len(lists), len(CODECS)), bool)
        for k, codec in enumerate(sorted(CODECS)):
            back = of_bytes(*to_bytes(own, sizes, codec), sizes, codec)
            wrong = np.append(0, np.cumsum(back != own))
            ends = np.cumsum(sizes)
            out[:, k] = wrong[ends] == wrong[ends - sizes]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * len(CODECS)), pa.array(out.ravel()))

    return F.arrow_udf(run, "array<boolean>")(values)


def pack_plain(values: list[int]) -> bytes:
    return struct.pack(f"<{len(values)}I", *values)


def unpack_plain(blob: bytes, n: int) -> list[int]:
    return list(struct.unpack(f"<{n}I", blob))


def _briefly(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 9, 1)
    return c.compress(raw) + c.flush()


_single = lru_cache(1 << 15)(_briefly)


def deflated(raw: bytes) -> bytes:
    """``raw`` as a zlib stream. Short ones get the least window, as setting up the usual one takes
    ten times as long as the rest; those of single values repeat, and the last ones are kept."""
    return _single(raw) if len(raw) <= 4 else _briefly(raw) if len(raw) <= 128 else zlib.compress(raw)


def pack_gzip(values: list[int]) -> bytes:
    return deflated(pack_plain(values))


def unpack_gzip(blob: bytes, n: int) -> list[int]:
    return unpack_plain(zlib.decompress(blob), n)


#: Name -> (pack, unpack).
CODECS = {"plain": (pack_plain, unpack_plain), "gzip": (pack_gzip, unpack_gzip), "for": (pack, unpack), "for-delta": (pack_delta, unpack_delta)}
