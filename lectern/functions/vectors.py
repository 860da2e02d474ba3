"""Vector functions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIMENSION = 8192


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def valid(vector: Column) -> Column:
    """Finite numbers, one of them not zero, at most MAX_DIMENSION of them."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0) & F.size(vector).between(1, MAX_DIMENSION), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In one pass each: vectors and largest magnitudes are bound once, squares neither overflow nor vanish."""
    top = lambda v: F.array_max(F.transform(v, F.abs))
    bound = F.array(F.struct(a.alias("a"), top(a).alias("ta"), b.alias("b"), top(b).alias("tb")))

    def value(s: Column) -> Column:
        x, y = F.transform(s["a"], lambda v: F.try_divide(v, s["ta"])), F.transform(s["b"], lambda v: F.try_divide(v, s["tb"]))
        pair = F.zip_with(x, y, lambda v, w: F.struct((v * w).alias("d"), (v * v).alias("p"), (w * w).alias("q")))
        zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
        add = lambda m, t: F.struct((m["d"] + t["d"]).alias("d"), (m["p"] + t["p"]).alias("p"), (m["q"] + t["q"]).alias("q"))
        return F.aggregate(pair, zero, add, lambda m: F.try_divide(m["d"], F.sqrt(m["p"] * m["q"])))

    found = F.element_at(F.transform(bound, value), 1)
    return F.when(found.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), found)))  # greatest and least skip nulls
