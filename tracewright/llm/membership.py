"""A set of keys as a broadcast bitmap of fixed size, to leave out rows before a join.

It only saves work: rows that pass are joined all the same, so chance hits change no result. Its size does
not depend on the data; with very many keys it lets more rows pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap (8 MB).
BITS = 26


def slot(key: Column) -> Column:
    """A key's place in the bitmap."""
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS))


def bitmap(keys: DataFrame, key: str, hashed: bool = False) -> Broadcast:
    """The bitmap of all keys, in bytes of eight. At most 64 pieces of 128 kB reach the driver.

    Keys that are hashes themselves (``hashed``, long integers) have their last ``BITS`` bits as their place.
    """
    words = keys.select((F.col(key).bitwiseAND(F.lit((1 << BITS) - 1)) if hashed else slot(F.col(key))).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    size = 1 << (BITS - 12)  # words in a piece

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out, at = np.zeros(size, dtype=np.int64), group["word"].to_numpy(dtype=np.int64)
        out[at % size] = group["bits"].to_numpy(dtype=np.int64)
        return pd.DataFrame({"piece": [int(at[0]) // size], "bits": [out.tobytes()]})

    out = np.zeros(64 * size, dtype=np.int64)
    for r in words.groupBy(F.expr(f"word div {size}")).applyInPandas(pack, "piece int, bits binary").collect():
        out[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["bits"], dtype=np.int64)
    return keys.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def contains(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
