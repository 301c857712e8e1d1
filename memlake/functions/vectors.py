"""Vector expressions on array<float> columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(total(F.transform(_d(a), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Lenient: 0 for a null, a length mismatch or a zero norm."""
    n = norm(a) * norm(b)
    ok = (F.size(_d(a)) == F.size(_d(b))) & (n > 0)
    return F.when(ok, dot(a, b) / n).otherwise(0.0)


def cosine_strict(a: Column | str, b: Column | str) -> Column:
    """Strict: raises for an empty vector or a length mismatch, and for values that are not finite."""
    n = norm(a) * norm(b)
    ok = (F.size(_d(a)) == F.size(_d(b))) & (F.size(_d(a)) > 0) & ~F.isnan(n)
    return F.when(ok, F.when(n > 0, dot(a, b) / n).otherwise(0.0)).otherwise(F.raise_error(F.lit("vectors must be finite, not empty and of one length")).cast("double"))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: F.abs(x - y)))


def normalise(a: Column | str) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_d(a), lambda x: x / n)).otherwise(_d(a))


def subsample(a: Column | str, step: int = 6) -> Column:
    return F.filter(_d(a), lambda _, i: i % step == 0)


def blend(a: Column | str, b: Column | str, share: float = 0.6) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: share * x + (1 - share) * y)
