"""Scores, rounding and dates as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking contract.
K1, B, LEAST_LENGTH = 1.2, 0.75, 120.0
COVERAGE = 0.15
RRF_K = 60
RRF_BONUS = {1: 0.05, 2: 0.02, 3: 0.02}
HALF_LIFE_DAYS = 30.0
NUDGE = 0.75


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves of the binary value upwards, also for negative numbers."""
    p = float(10**digits)
    return F.floor(x * p + 0.5) / p


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def saturated(tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    long = F.greatest(length, F.lit(LEAST_LENGTH)) / average
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * long))


def coverage(hits: Column) -> Column:
    return 1 + COVERAGE * (hits - 1)


def rrf_bonus(rank: Column) -> Column:
    out = F.lit(0.0)
    for at, bonus in RRF_BONUS.items():
        out = F.when(rank == at, bonus).otherwise(out)
    return out


def decay(age_days: Column) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / HALF_LIFE_DAYS)


def nudged(rank: Column, score: Column) -> Column:
    return rank - NUDGE * F.tanh(score)


def age_days(since: Column, now: Column) -> Column:
    return F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(since.cast("timestamp"))) / 86_400_000)


def threshold_between(good_least: Column, weak_most: Column) -> Column:
    """The geometric mean where good exceeds weak, else 0.8 of good; two decimals."""
    between = F.when((weak_most > 0) & (weak_most < good_least), F.sqrt(good_least * weak_most)).otherwise(good_least * 0.8)
    return half_up(between, 2)


def day_or_today(text: Column) -> Column:
    return F.coalesce(F.try_to_date(text), F.current_date())


def hash_seed(text: str) -> int:
    """FNV-1a, 32 bits, over UTF-16 units."""
    h = 0x811C9DC5
    data = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(data), 2):
        h = (h ^ (data[i] | data[i + 1] << 8)) * 0x01000193 & 0xFFFFFFFF
    return h
