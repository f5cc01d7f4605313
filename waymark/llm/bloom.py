"""A Bloom filter of keys, so that wide rows which can't meet a list of keys aren't shuffled to be told so.

Bits are set by Spark: the places of each key's hash, combined by words of 64 bits before and after the shuffle. The
words, ``max_bits / 8`` bytes at most whatever the number of keys, come to the driver and go to all workers. A full filter
lets more rows pass, up to all of them, and never holds one back that has its key; so an exact join follows, and nothing
depends on its size. With 12 bits a key or more, four places let about 0.6 % of other rows pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 28
BITS_A_KEY, PLACES = 12, 4


def _hash(*cols: str | Column) -> Column:
    return F.xxhash64(*cols, F.lit(7))


class Bloom:
    """Keys of ``keys`` over the columns ``cols``; a row with a null key counts like any other."""

    def __init__(self, keys: DataFrame, cols: list[str], max_bits: int = MAX_BITS):
        n = keys.count()
        self.bits = bits = min(max_bits, max(64, 1 << (BITS_A_KEY * n).bit_length()))
        h = keys.select(_hash(*cols).alias("h")).select(F.col("h").bitwiseAND(bits - 1).alias("a"), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1)).alias("b"))
        places = h.select(F.explode(F.array(*[(F.col("a") + F.col("b") * i).bitwiseAND(bits - 1) for i in range(PLACES)])).alias("p"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int"))
        words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("v")).toArrow()
        table = np.zeros(bits >> 6, np.int64)
        table[words.column("w").to_numpy()] = words.column("v").to_numpy()
        self.words = keys.sparkSession.sparkContext.broadcast(table)

    def maybe(self, *cols: str | Column) -> Column:
        """False only for rows whose key isn't among the keys. Only the hash goes to Python, in batches."""
        bits, words = self.bits, self.words

        @F.pandas_udf("boolean")
        def test(h: pd.Series) -> pd.Series:
            v, table, found = h.to_numpy(), words.value, np.ones(len(h), bool)
            a, b = v & (bits - 1), (v.view(np.uint64) >> np.uint64(32)).astype(np.int64) | 1
            for i in range(PLACES):
                p = (a + b * i) & (bits - 1)
                found &= (table[p >> 6] >> (p & 63)) & 1 == 1
            return pd.Series(found)

        return test(_hash(*cols))
