"""CRC-32 of a whole from the checksums of its parts, in any order and by any tree of partial results.

Appending n bytes multiplies a checksum by x^8n modulo the polynomial, over GF(2), and x has the order 2^32 - 1 there. So
the checksum of a whole is the exclusive or of its parts' checksums, each multiplied by x to the bits behind it. Counted
from the front instead, by inverse powers, a part needs no knowledge of what follows: the sum is an ordinary aggregate,
and one multiplication by the total length ends it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.sliced import Sliced

#: Fixed value: the polynomial, least power first, and the order of x.
POLYNOMIAL, ORDER = np.uint32(0xEDB88320), (1 << 32) - 1


def multiplied(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Products of checksums as polynomials modulo POLYNOMIAL; the top bit stands for 1."""
    total, factor = np.zeros(len(one), np.uint32), one.astype(np.uint32)
    for k in range(31, -1, -1):
        total ^= factor * ((two >> np.uint32(k)) & np.uint32(1))
        factor = (factor >> np.uint32(1)) ^ (POLYNOMIAL * (factor & np.uint32(1)))
    return total


def powers() -> list[np.ndarray]:
    """x to the powers of two, by squaring."""
    out = [np.array([1 << 30], np.uint32)]
    while len(out) < 32:
        out.append(multiplied(out[-1], out[-1]))
    return out


def shifted(crc: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Each checksum times x to so many bits, which may be negative."""
    out, left = crc.astype(np.uint32), np.mod(bits.astype(np.int64), ORDER)
    for k, power in enumerate(powers()):
        some = np.flatnonzero(left >> k & 1)
        if len(some):
            out[some] = multiplied(out[some], np.broadcast_to(power, len(some)))
    return out


@F.pandas_udf(T.LongType())
def _shift(crc: pd.Series, size: pd.Series) -> pd.Series:
    # Eight bits a byte; lengths are reduced first, so that no product overflows.
    return pd.Series(shifted(crc.to_numpy(), np.mod(size.to_numpy(), ORDER) * 8).astype(np.int64))


def crc_of_parts(parts: DataFrame, keys: list[str], order: list[str], value: Column, slice_rows: int | None = None) -> DataFrame:
    """``keys, crc, size``: the CRC-32 and length of the values of each group joined in order.

    Parts are bytes; nulls and empty ones add nothing. No task holds a group: places are prefix sums over slices, and the
    rest is one aggregate of a number per part. Parts of equal order must be equal.
    """
    own = parts.select(*keys, *order, F.crc32(value).alias("part_crc"), F.coalesce(F.octet_length(value), F.lit(0)).cast("long").alias("part_size"))
    placed = Sliced.of(own, keys, order, slice_rows).before(part_start=("sum", F.col("part_size"))).done()
    moved = _shift(F.coalesce("part_crc", F.lit(0)), -(F.col("part_start") + F.col("part_size")))
    whole = placed.withColumn("part_moved", moved).groupBy(*keys).agg(F.bit_xor("part_moved").alias("crc"), F.sum("part_size").alias("size"))
    return whole.withColumn("crc", _shift(F.col("crc"), F.col("size")))
