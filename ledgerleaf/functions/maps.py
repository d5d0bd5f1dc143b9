"""Maps of bits: which rows may have one of many keys, told where the rows are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a map, 2 MB of them.
BITS = 1 << 24


def in_map(rows: DataFrame, key: Column, keys: DataFrame, bits: int | None = None) -> DataFrame:
    """The ``rows`` whose hash ``key`` may be in ``keys`` (its column key): a bit for each hash, 64 to a number.

    A bit may stand for several hashes, so some others are let through, and all with a full map; none is lost.
    """
    bits = bits or BITS
    place = lambda k: k.bitwiseAND(F.lit(bits - 1))
    at = keys.select(place(F.col("key")).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
    every = rows.sparkSession.range(bits // 64).join(words, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    made = every.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["bits"])).scalar()
    word = F.get(made, F.shiftright(place(key), 6).cast("int"))
    return rows.where(F.getbit(word, place(key).bitwiseAND(F.lit(63)).cast("int")) == 1)
