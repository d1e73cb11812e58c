"""Ids, packed entries, variable-length integers and small scalar functions."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pack_separated(high: Column, low: Column, bits: int) -> Column:
    return F.shiftleft(high, bits).bitwiseOR(low)


def separated_high(x: Column, bits: int) -> Column:
    return F.shiftrightunsigned(x, bits)


def separated_low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def compact_separated(x: Column, bits: int, size: int) -> Column:
    return separated_high(x, bits) * size + separated_low(x, bits)


def swap_low(x: Column, bits: int, low: Column) -> Column:
    return x.bitwiseAND(F.lit(-1 << bits)).bitwiseOR(low)


def pack_edge(v0: Column, v1: Column) -> list[Column]:
    """Two 48-bit ids in three 32-bit words: the low halves, then both high parts."""
    word = F.lit(0xFFFFFFFF)
    high = F.shiftright(v0, 32).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.shiftleft(F.shiftright(v1, 32).bitwiseAND(F.lit(0xFFFF)), 16))
    return [v0.bitwiseAND(word), v1.bitwiseAND(word), high]


def unpack_edge(low0: Column, low1: Column, high: Column) -> list[Column]:
    return [low0.bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 32)), low1.bitwiseOR(F.shiftleft(F.shiftright(high, 16).bitwiseAND(F.lit(0xFFFF)), 32))]


def pack_entry(parent: Column, depth: Column) -> Column:
    """Depth in the 16 high bits, parent in the 48 low ones; not reached is -1."""
    entry = F.shiftleft(depth.cast("long"), 48).bitwiseOR(parent.bitwiseAND(F.lit((1 << 48) - 1)))
    return F.when(parent.isNull() | (parent < 0), F.lit(-1)).otherwise(entry)


def entry_parent(entry: Column) -> Column:
    return F.shiftright(F.shiftleft(entry, 16), 16)


def entry_depth(entry: Column) -> Column:
    """0 to 65535; 65535 stands for not reached."""
    return F.shiftrightunsigned(entry, 48).bitwiseAND(F.lit(0xFFFF)).cast("int")


def highest_bit(v: Column) -> Column:
    """The number of the highest set bit; -1 for zero."""
    return F.when(v == 0, F.lit(-1)).otherwise(F.length(F.bin(v)) - 1)


def lowest_bit(v: Column) -> Column:
    """The number of the lowest set bit; 64 for zero."""
    return F.when(v == 0, F.lit(64)).otherwise(F.length(F.regexp_extract(F.bin(v), "(0*)$", 1)))


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1))))


def round_up(v: Column, unit: int) -> Column:
    return F.ceil(v / unit).cast("long") * unit


def blocks(v: Column, unit: int) -> Column:
    return F.ceil(v / unit).cast("long")


def round_up_power(v: Column) -> Column:
    """The least power of two not below v (v > 0)."""
    return F.when(v <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(v - 1))).cast("long"))


def percent_over(v: Column, mean: Column) -> Column:
    return (v - mean) / mean * 100


def giga(v: Column) -> Column:
    return v / float(1 << 30)


def mega(v: Column) -> Column:
    return v / float(1 << 20)


# Integer types by the largest value they are chosen for, as bits.
TYPES = [(7, "int8_t"), (8, "uint8_t"), (15, "int16_t"), (16, "uint16_t"), (31, "int32_t"), (32, "uint32_t")]


def minimum_type(top: Column) -> Column:
    out = F.lit("int64_t")
    for bits, name in reversed(TYPES):
        out = F.when(top <= (1 << bits), name).otherwise(out)
    return out


def sparsity_factor(span: Column, n: Column) -> Column:
    """0 without values, else 1 to 10: how many bytes of seven bits the mean gap takes, and one."""
    gap = span.cast("double") / n
    out = F.lit(10)
    for k in range(8, -1, -1):
        out = F.when(gap < 128.0**k, k + 1).otherwise(out)
    return F.when(n == 0, 0).otherwise(out)


# Suffixes of steps of a thousand.
UNITS = ["", "K", "M", "G", "T"]


def _by_unit(v: Column, of) -> Column:
    out = of(len(UNITS) - 1)
    for k in range(len(UNITS) - 2, -1, -1):
        out = F.when(v < 1000 ** (k + 1), of(k)).otherwise(out)
    return out


def display_value(v: Column) -> Column:
    return _by_unit(v, lambda k: v / 1000.0**k)


def display_suffix(v: Column) -> Column:
    return _by_unit(v, lambda k: F.lit(UNITS[k]))


def delta(v: Column, before: Column) -> Column:
    """Differences of sorted ids, the first as it is; zig-zag keeps them short."""
    return zigzag(v - F.coalesce(before, F.lit(0)))


def varint_block(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values together, and how many bytes each takes.

    Seven bits a byte, the lowest first; the high bit says that more follow.
    """
    v = values.astype(np.int64).view(np.uint64)
    sizes = np.ones(len(v), np.int64)
    for k in range(1, 10):
        sizes += v >= np.uint64(1 << 7 * k)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(10):
        has = sizes > k
        if not has.any():
            break
        low = (v[has] >> np.uint64(7 * k)) & np.uint64(0x7F)
        out[starts[has] + k] = low.astype(np.uint8) | np.where(sizes[has] > k + 1, 0x80, 0).astype(np.uint8)
    return out, sizes


def varint_unblock(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some bytes, and where each one's bytes end."""
    ends = np.flatnonzero(data < 0x80) + 1
    if not len(ends):
        return np.empty(0, np.int64), ends
    starts = np.concatenate([[0], ends[:-1]])
    shift = np.arange(int(ends[-1])) - np.repeat(starts, ends - starts)
    bits = (data[: ends[-1]] & 0x7F).astype(np.uint64) << (7 * shift).astype(np.uint64)
    return np.bitwise_or.reduceat(bits, starts).view(np.int64), ends


def encode_varint(values: list[int]) -> bytes:
    return varint_block(np.array(values, np.int64))[0].tobytes()


def decode_varint(data: bytes) -> list[int]:
    return varint_unblock(np.frombuffer(data, np.uint8))[0].tolist()


def _with_nulls(found: list, given: pd.Series) -> pd.Series:
    rest = iter(found)
    return pd.Series([next(rest) if there else None for there in given.notna()], dtype=object)


@F.pandas_udf(T.BinaryType())
def varint_bytes(lists: pd.Series) -> pd.Series:
    """The values of a whole batch are coded at once; a null list gives null."""
    there = lists[lists.notna()]
    lengths = there.map(len).to_numpy(np.int64)
    data, sizes = varint_block(np.concatenate([np.empty(0, np.int64), *there]))
    cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
    whole = data.tobytes()
    return _with_nulls([whole[a:b] for a, b in zip(cuts, cuts[1:])], lists)


@F.pandas_udf(T.ArrayType(T.LongType()))
def varint_values(data: pd.Series) -> pd.Series:
    there = data[data.notna()]
    values, ends = varint_unblock(np.frombuffer(b"".join(there), np.uint8))
    cuts = np.searchsorted(ends, np.concatenate([[0], np.cumsum(there.map(len).to_numpy(np.int64))]), "right")
    return _with_nulls([values[a:b] for a, b in zip(cuts, cuts[1:])], data)


def delta_stream(sets: DataFrame, key: str = "bucket", column: str = "vertex") -> DataFrame:
    """(key, n, stream) of sets of ids: sorted, as differences, in VarInt bytes."""
    gaps = F.col(column) - F.coalesce(F.lag(column).over(Window.partitionBy(key).orderBy(column)), F.lit(0))
    rows = sets.select(key, column, zigzag(gaps).alias("gap"))
    lists = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(column, "gap"))), lambda x: x["gap"]).alias("gaps"))
    return lists.select(key, F.size("gaps").cast("long").alias("n"), varint_bytes("gaps").alias("stream"))


def stream_members(streams: DataFrame, key: str = "bucket", column: str = "vertex") -> DataFrame:
    """The ids of :func:`delta_stream`."""
    rows = streams.select(key, F.posexplode(varint_values("stream")).alias("at", "gap"))
    return rows.select(key, F.sum(unzigzag(F.col("gap"))).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias(column))


def edge_weight(edge: Column, bits: int) -> Column:
    """The weight in the low bits of an edge entry."""
    return edge.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def edge_target(edge: Column, bits: int) -> Column:
    """The vertex above the weight of an edge entry."""
    return F.shiftright(edge, bits)


def reverse_bits_text(v: Column) -> Column:
    """The 64 bits of a non-negative id in reverse order, as text."""
    return F.reverse(F.lpad(F.bin(v), 64, "0"))


def swap_endian(data: bytes, layout: str) -> bytes:
    """Fields of a little-endian record written big-endian."""
    return struct.pack(">" + layout, *struct.unpack("<" + layout, data))


def partition_bounds(size: int, parts: int, part: int) -> tuple[int, int]:
    """The contiguous stretch of ``size`` things that one of ``parts`` has; the last may be short."""
    share = -(-size // parts)
    begin = min(share * part, size)
    return begin, min(begin + share, size)


def blocked_bounds(offsets: list[int], per_block: int, part: int) -> tuple[int, int]:
    """As :func:`partition_bounds` within blocks that begin at ``offsets`` (the last is the end), ``per_block`` parts each."""
    block, inner = divmod(part, per_block)
    begin, end = partition_bounds(offsets[block + 1] - offsets[block], per_block, inner)
    return offsets[block] + begin, offsets[block] + end


def aligned_bounds(keys: list[int], shift: int, parts: int, part: int) -> tuple[int, int]:
    """As :func:`partition_bounds` over sorted keys, moved on to where the high bits change."""

    def after(at: int) -> int:
        end = at
        while 0 < at and end < len(keys) and at < len(keys) and keys[end] >> shift == keys[at] >> shift:
            end += 1
        return end

    begin, end = partition_bounds(len(keys), parts, part)
    return after(begin), after(end)
