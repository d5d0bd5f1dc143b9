"""Runs of words as numbers: which runs of many texts a map of bits may hold.

Texts come with one space between words. A run's number follows from its words and a salt, so that texts in tasks and
the runs that a map was made of agree; several runs may share one.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a run, at least and at most.
LOW, HIGH = 2, 5
#: Characters that are looked at together.
AT_ONCE = 4_000_000
# Odd numbers with bits all over.
_NEXT, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(words: list[str]) -> np.ndarray:
    codes, different = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(np.asarray(different, dtype=object), categorize=False)[codes]


def _places(runs: np.ndarray, salts: np.ndarray, bits: int) -> np.ndarray:
    mixed = runs ^ salts
    return ((mixed ^ (mixed >> np.uint64(32))) * _LAST) >> np.uint64(64 - bits.bit_length() + 1)


def places(runs: list[str], salts: list[str], bits: int) -> np.ndarray:
    """The place of each run in a map of ``bits`` bits, a power of two."""
    words = [r.split(" ") for r in runs]
    h, sizes = _hashes(list(chain.from_iterable(words))), np.array([len(w) for w in words], np.int64)
    first = np.cumsum(sizes) - sizes
    made = h[first]
    for n in range(2, sizes.max(initial=0) + 1):
        long = sizes >= n
        made[long] = made[long] * _NEXT + h[first[long] + n - 1]
    return _places(made, _hashes(salts), bits).astype(np.int64)


def held(texts: list[str], salts: list[str], bits: np.ndarray) -> list[set[str]]:
    """The distinct runs of each text that a map may hold. Where it holds a run, it must hold the run's beginnings: what
    it does not is not made longer."""
    words = [t.split() for t in texts]
    flat = list(chain.from_iterable(words))
    text_of = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    h, salt, octets = _hashes(flat), _hashes(salts), bits.view(np.uint8)
    out: list[set[str]] = [set() for _ in texts]
    at, runs = np.arange(len(flat)), h
    for n in range(2, HIGH + 1):
        inside = at + n - 1 < len(flat)
        inside[inside] = text_of[at[inside]] == text_of[at[inside] + n - 1]
        at = at[inside]
        runs = runs[inside] * _NEXT + h[at + n - 1]
        place = _places(runs, salt[text_of[at]], len(bits) * 64)
        there = (octets[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at, runs = at[there], runs[there]
        for i, k in zip(at.tolist(), text_of[at].tolist(), strict=True):
            out[k].add(" ".join(flat[i : i + n]))
    return out


def map_of(rows: DataFrame, salt: Column, run: Column, bits: int) -> Broadcast:
    """A map of the runs in ``rows`` for all tasks: a bit for each, 64 to a number. Its size is the same for any table."""

    @F.pandas_udf(T.LongType())
    def place(run: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series(places(run.tolist(), salt.tolist(), bits))

    at = rows.select(place(run, salt).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits")).toArrow()
    made = np.zeros(bits // 64, "<i8")
    made[words["id"].to_numpy()] = words["bits"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(made)


def in_map(normal: Column, salt: Column, bits: Broadcast) -> Column:
    """The distinct runs of a normal form that a map may hold."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def look(said: pd.Series, salt: pd.Series) -> pd.Series:
        out, lot, size = [], [], 0
        for i, t in enumerate(said):
            lot.append(t)
            size += len(t)
            if size >= AT_ONCE or i == len(said) - 1:
                out += [list(found) for found in held(lot, salt[len(out) : i + 1].tolist(), bits.value)]
                lot, size = [], 0
        return pd.Series(out, dtype=object)

    # What stands between words as the engine's expressions tell it.
    return look(F.regexp_replace(normal, r"(?U)[^\w'’-]+", " "), salt)
