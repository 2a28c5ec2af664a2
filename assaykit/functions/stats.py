"""Statistics over aggregates: closed forms as columns, resampling in plain Python.

Neither Spark nor common SQL engines have erf, so the normal distribution function
is the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7);
test statistics are columns of their own, so they can be checked exactly.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard normal quantiles at 0.975 and 0.8.
Z95, Z80 = 1.959963984540054, 0.8416212335729143
#: Coefficients of the approximation, and its rate.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911


def tail(z: Column) -> Column:
    """Two-sided normal tail probability of a non-negative statistic."""
    x = z / math.sqrt(2)
    t = 1.0 / (1.0 + F.lit(ERF_P) * x)
    poly = t * (ERF[0] + t * (ERF[1] + t * (ERF[2] + t * (ERF[3] + t * ERF[4]))))
    return poly * F.exp(-x * x)


def wilson(passes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a rate; (0, 1) without trials."""
    m = n.cast("double")
    p = passes / F.nullif(m, F.lit(0.0))
    mid = p + z * z / (2 * m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    scale = 1 + z * z / m
    return (F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / scale)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), (mid + half) / scale)).otherwise(1.0))


def sample_size(delta: Column, base: Column) -> Column:
    """Cases a side to see a gain of delta over base at 5 % and 80 % power."""
    other = F.least(F.lit(1.0), base + delta)
    return F.ceil((Z95 + Z80) ** 2 * (base * (1 - base) + other * (1 - other)) / (delta * delta))


def detectable(n: Column, base: Column) -> Column:
    """Smallest gain that n cases a side can show."""
    return F.when(n > 0, F.round(F.least(F.lit(1.0), F.sqrt((Z95 + Z80) ** 2 * 2 * base * (1 - base) / F.nullif(n.cast("double"), F.lit(0.0)))), 4)).otherwise(1.0)


def effect_h(p: Column, q: Column) -> Column:
    """Difference of arcsine-transformed rates."""
    arc = lambda x: 2 * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))
    return F.round(arc(q) - arc(p), 4)


def effect_label(h: Column) -> Column:
    return F.when(F.abs(h) < 0.2, "small").when(F.abs(h) < 0.5, "medium").otherwise("large")


def any_of_k(n: Column, c: Column, k: int) -> Column:
    """Chance that k of n trials, c of which pass, hold a pass; null when k > n."""
    none = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * F.greatest(n - c - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))
    return F.when(n >= k, 1 - none)


def all_of_k(n: Column, c: Column, k: int) -> Column:
    """Chance that k of n trials all pass; null when k > n."""
    return F.when(n >= k, F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * F.greatest(c - i, F.lit(0)) / F.greatest(n - i, F.lit(1))))


def discordance(b: Column, c: Column) -> Column:
    """Continuity-corrected statistic of discordant pairs; 0 without any."""
    return F.when(b + c > 0, F.pow(F.abs(b - c) - 1, 2) / F.nullif((b + c).cast("double"), F.lit(0.0))).otherwise(0.0)


def discordance_p(b: Column, c: Column) -> Column:
    return F.when(b + c > 0, tail(F.sqrt(discordance(b, c)))).otherwise(1.0)


def two_rates_z(p: Column, n: Column, q: Column, m: Column) -> Column:
    """Pooled z statistic; null where a side is empty or the pool has no spread."""
    pool = (p * n + q * m) / F.nullif((n + m).cast("double"), F.lit(0.0))
    spread = F.sqrt(F.greatest(pool * (1 - pool), F.lit(0.0)) * (1 / F.nullif(n.cast("double"), F.lit(0.0)) + 1 / F.nullif(m.cast("double"), F.lit(0.0))))
    return F.when((n > 0) & (m > 0) & (pool > 0) & (pool < 1), F.abs((q - p) / F.nullif(spread, F.lit(0.0))))


def two_rates_p(p: Column, n: Column, q: Column, m: Column) -> Column:
    return F.coalesce(tail(two_rates_z(p, n, q, m)), F.lit(1.0))


def significance(p: Column) -> Column:
    return F.when(p < 0.01, "highly significant").when(p < 0.05, "significant").when(p < 0.10, "marginal").otherwise("not significant")


def quantile_normal(p: float) -> float:
    return NormalDist().inv_cdf(min(max(p, 1e-9), 1 - 1e-9))


def wilson_value(passes: float, n: int, confidence: float = 0.95) -> tuple[float, float]:
    if n == 0:
        return 0.0, 1.0
    z = quantile_normal(1 - (1 - confidence) / 2)
    p, scale = passes / n, 1 + z * z / n
    mid, half = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return max(0.0, (mid - half) / scale), min(1.0, (mid + half) / scale)


def bootstrap_mean(scores: Sequence[float], confidence: float = 0.95, draws: int = 2000, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of the mean, from Python's seeded generator so that runs agree everywhere."""
    if len(scores) < 2:
        return (scores[0], scores[0]) if scores else (0.0, 1.0)
    rng, n = random.Random(seed), len(scores)
    pick = rng.choice
    means = sorted(sum(pick(scores) for _ in range(n)) / n for _ in range(draws))
    low, high = int((1 - confidence) / 2 * draws), int((1 + confidence) / 2 * draws) - 1
    return round(means[low], 4), round(means[high], 4)


def cluster_bootstrap(values: Sequence[float], confidence: float = 0.95, draws: int = 2000, seed: int = 0) -> tuple[float, float]:
    """Interval of the mean of per-case estimates, cases resampled; a score interval where all are equal. It holds the mean itself."""
    m = len(values)
    if min(values) == max(values):
        return wilson_value(values[0] * m, m, confidence)
    rng = random.Random(seed)
    means = sorted(sum(rng.choice(values) for _ in range(m)) / m for _ in range(draws))

    def at(q: float) -> float:
        place = q * (draws - 1)
        i = int(place)
        return means[i] + (means[min(i + 1, draws - 1)] - means[i]) * (place - i)

    point = sum(values) / m
    return min(point, at((1 - confidence) / 2)), max(point, at((1 + confidence) / 2))


def credible(passes: int, n: int, confidence: float = 0.95, draws: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """Central interval of the rate's posterior under a uniform prior; sampled up to 100 trials, normal beyond."""
    if n == 0:
        return 0.0, 1.0
    a, b, half = passes + 1, n - passes + 1, (1 - confidence) / 2
    if n > 100:
        mean, spread = a / (a + b), math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        reach = quantile_normal(1 - half) * spread
        return max(0.0, round(mean - reach, 4)), min(1.0, round(mean + reach, 4))
    rng = random.Random(seed)
    gamma = lambda k: -sum(math.log(rng.random() or 1e-300) for _ in range(k))
    shares = []
    for _ in range(draws):
        x = gamma(a)
        shares.append(x / (x + gamma(b)))
    shares.sort()
    return round(shares[int(half * draws)], 4), round(shares[min(int((1 - half) * draws), draws - 1)], 4)


def _resampled_means(values: Sequence[tuple[float, int]], draws: int, seed: int):
    """Sorted means of resamples of (value, count) pairs: counts are drawn, so the cost doesn't follow the number of cases."""
    import numpy as np

    v, n = np.array([x for x, _ in values], float), np.array([c for _, c in values])
    m = int(n.sum())
    return np.sort(np.random.default_rng(seed).multinomial(m, n / m, draws) @ v / m), float(v @ n / m), m


def bootstrap_mean_counts(values: Sequence[tuple[float, int]], confidence: float = 0.95, draws: int = 2000, seed: int = 42) -> tuple[float, float]:
    """The percentile interval of ``bootstrap_mean`` from distinct values with counts, in a random stream of its own."""
    m = sum(n for _, n in values)
    if m < 2:
        return (values[0][0], values[0][0]) if m else (0.0, 1.0)
    means, _, _ = _resampled_means(values, draws, seed)
    low, high = int((1 - confidence) / 2 * draws), int((1 + confidence) / 2 * draws) - 1
    return round(float(means[low]), 4), round(float(means[high]), 4)


def cluster_bootstrap_counts(values: Sequence[tuple[float, int]], confidence: float = 0.95, draws: int = 2000, seed: int = 0) -> tuple[float, float]:
    """The cluster interval from distinct values with counts; it holds the mean itself."""
    import numpy as np

    means, point, m = _resampled_means(values, draws, seed)
    if len({x for x, _ in values}) == 1:
        return wilson_value(point * m, m, confidence)
    low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
    return min(point, float(low)), max(point, float(high))
