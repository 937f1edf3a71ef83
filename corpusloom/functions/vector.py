"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance, summed in double precision."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + rank)


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """A deterministic stand-in for a text embedding: tokens fall on signed places, then the length becomes 1."""
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(size))
    sign = lambda t: F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    # A list of one gives a value a name: inside a lambda its expression would be computed for every item.
    named = lambda c, use: F.get(F.transform(F.array(c), use), F.lit(0))
    placed = F.transform(tokens, lambda t: F.struct(place(t).alias("p"), sign(t).alias("s")))
    raw = named(placed, lambda at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(at, lambda x: x["p"] == i), F.lit(0.0), lambda s, x: s + x["s"])))
    norm = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda r, n: F.transform(r, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)).cast("float"))
    return named(raw, lambda r: named(norm(r), lambda n: scaled(r, n)))
