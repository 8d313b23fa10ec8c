"""Edit distance of long sequences, bit-parallel."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of the table of distances up to which Spark's own levenshtein is used.
CELLS = 1_000_000


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance. A column of the table of distances is two whole numbers with a bit for each row (its steps up and down), so a
    step takes a few operations on as many bits as the shorter sequence has items, and memory grows with that one only."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[len(a) - 1 - tail] == b[len(b) - 1 - tail]:
        tail += 1
    a, b = sorted((a[head : len(a) - tail], b[head : len(b) - tail]), key=len)
    if not a:
        return len(b)
    places: dict = {}
    for i, item in enumerate(a):
        places.setdefault(item, []).append(i)
    where = {}
    for item, at in places.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        where[item] = int.from_bytes(bits, "little")
    every, last = (1 << len(a)) - 1, len(a) - 1
    up, down, found = every, 0, len(a)
    for item in b:
        same = where.get(item, 0) | down
        diagonal = (((same & up) + up) ^ up | same) & every
        less = up & diagonal
        more = down | every ^ (up | diagonal)
        found += (more >> last & 1) - (less >> last & 1)
        more = (more << 1 | 1) & every
        down = more & diagonal
        up = (less << 1) & every | every ^ (more | diagonal)
    return found


@F.pandas_udf(T.LongType())
def _texts(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def _lists(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else distance(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")


def edit_distance(a: Column, b: Column) -> Column:
    """levenshtein, whatever the lengths; long pairs alone go to Python."""
    long = F.length(a).cast("long") * F.length(b) > CELLS
    return F.when(long, _texts(F.when(long, a), F.when(long, b))).otherwise(F.levenshtein(a, b).cast("long"))


def list_distance(a: Column, b: Column, short: Column) -> Column:
    """Edit distance of two arrays of words; short is the same for pairs of at most CELLS cells."""
    long = F.size(a).cast("long") * F.size(b) > CELLS
    return F.when(long, _lists(F.when(long, a), F.when(long, b))).otherwise(short)
