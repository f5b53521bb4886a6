"""Bitmaps of hashes, 2**``BITS`` bits whatever they hold, built in the JVM and broadcast to tasks.

A set bit admits a row to an exact step, a clear one proves that it has no business there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**26 bits are 8 MB.
BITS = 26
#: Bits of one row of ``bitmap_construct_agg``.
_PAGE = 15


def broadcast_bits(rows: DataFrame, column: str):
    """A broadcast of the bits of a column of longs; null has none."""
    spark = rows.sparkSession
    bit = F.col(column).bitwiseAND((1 << BITS) - 1)
    pages = rows.where(F.col(column).isNotNull()).groupBy(F.shiftright(bit, _PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(bit.bitwiseAND((1 << _PAGE) - 1)).alias("held"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (_PAGE - 3)
    for row in pages.collect():
        out[row.page * size : (row.page + 1) * size] = np.frombuffer(row.held, np.uint8)
    return spark.sparkContext.broadcast(out)


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each signed or unsigned 64-bit number is set."""
    place = hashes.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
