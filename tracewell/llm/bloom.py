"""A Bloom filter of fixed size, to tell rows that need a join from those that can stay where they lie.

There are no false negatives, so rows that the filter lets by need no join; the
fuller the filter, the more rows take the join, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter has two to this power bits (16 MB), whatever the corpus.
FILTER_BITS = 27


def _places(mark: Column, half: int) -> Column:
    return F.shiftrightunsigned(mark, half * FILTER_BITS).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def words(marks: DataFrame) -> np.ndarray:
    """The filter's words: each ``mark`` sets two bits. The driver gets at most 2 ** (FILTER_BITS - 6) words."""
    bits = marks.select(F.explode(F.array(_places(F.col("mark"), 0), _places(F.col("mark"), 1))).alias("p"))
    found = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    if found.num_rows:
        out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def _hits(shared, bits: int):
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, low = shared.value, np.uint64((1 << bits) - 1)
        for batch in batches:
            first = np.concatenate(([0], np.cumsum(np.asarray(batch.value_lengths()).astype(np.int64))))
            mark = np.asarray(batch.flatten()).view(np.uint64)
            hit = np.ones(len(mark), bool)
            for half in (0, 1):
                place = (mark >> np.uint64(half * bits)) & low
                hit &= (held[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
            total = np.concatenate(([0], np.cumsum(hit)))
            yield pa.array(total[first[1:]] > total[first[:-1]])

    return hits


def may_hold(marks: DataFrame, own: Column) -> Column:
    """Whether one of a row's own marks (an array of longs, not null) may be among ``marks`` (column ``mark``)."""
    shared = marks.sparkSession.sparkContext.broadcast(words(marks))
    return F.arrow_udf(_hits(shared, FILTER_BITS), "boolean")(own)
