"""Scores of memories: recency, composite score, relevance, retention, trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score weights and the time constant of recency in seconds (30 days).
W_SIMILARITY, W_IMPORTANCE, W_RECENCY, TAU = 2.0, 1.0, 1.0, 2_592_000.0
#: Least similarity at which importance and recency count for ranking.
FLOOR = 0.3


def finite_or_zero(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two timestamps of either kind."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 1e6


def recency(at: Column, now: Column) -> Column:
    return F.exp(-seconds(now, at) / TAU)


def proximity(hours: Column, rate: float = 0.1) -> Column:
    return F.exp(-rate * hours)


def score(similarity: Column, importance: Column, recency_: Column, trust: Column) -> Column:
    return (W_SIMILARITY * similarity + W_IMPORTANCE * importance + W_RECENCY * recency_) * trust


def ranking_score(similarity: Column, importance: Column, recency_: Column, trust: Column, floor: float = FLOOR) -> Column:
    extra = F.when(similarity >= floor, W_IMPORTANCE * importance + W_RECENCY * recency_).otherwise(0.0)
    return (W_SIMILARITY * similarity + extra) * trust


def retention(importance: Column, age_days: Column, accesses: Column, trust: Column) -> Column:
    return (0.4 * importance + 0.4 * F.exp(-age_days / 30.0) + 0.2 * F.least(F.lit(1.0), accesses / 10.0)) * trust


def trust_score(site: Column, known: list[str], injections: Column, warnings: Column) -> Column:
    """1, less 0.2 for a site outside the known domains, up to 0.9 for injection findings, 0.1 for each warning."""
    familiar = F.lit(False)
    for d in known:
        familiar = familiar | (site == d) | site.endswith("." + d)
    return clamp(F.lit(1.0) - F.when(familiar, 0.0).otherwise(0.2) - F.least(0.3 * injections, F.lit(0.9)) - 0.1 * warnings)


def backoff(attempts: Column, base: float, most: float) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempts))


def tokens(text: Column) -> Column:
    """Estimated tokens, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def tokens_or_none(text: Column) -> Column:
    """The other estimator: an empty text has none."""
    return F.ceil(F.length(text) * 0.25).cast("long")
