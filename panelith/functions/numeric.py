"""Box-Cox transforms, ridge coefficients and seeds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelith.constants import EXPONENT_LIMIT, TINY, TINY_BOXCOX


def boxcox(y: Column, power: Column) -> Column:
    base = F.greatest(y, F.lit(TINY_BOXCOX))
    return F.when(power == 0, F.ln(base)).otherwise((F.pow(base, power) - 1) / F.when(power == 0, F.lit(1.0)).otherwise(power))


def boxcox_inverse(z: Column, power: Column) -> Column:
    """Inverse with exponents held within EXPONENT_LIMIT."""
    safe = F.when(power == 0, F.lit(1.0)).otherwise(power)
    base = F.least(F.greatest(z * power + 1, F.lit(TINY)), F.exp(power * EXPONENT_LIMIT))
    return F.when(power == 0, F.exp(F.least(F.greatest(z, F.lit(-EXPONENT_LIMIT)), F.lit(EXPONENT_LIMIT)))).otherwise(F.pow(base, 1 / safe))


def recover_beta(theta: Column, is_diff: Column | bool, at: int = 2) -> Column:
    """Coefficients of the level from those of its differences: entry `at` becomes one less itself."""
    flag = F.lit(is_diff) if isinstance(is_diff, bool) else is_diff
    return F.transform(theta, lambda x, i: F.when(flag & (i == at), 1 - x).otherwise(x))


def item_seed(item_id: Column, channel: Column | int = 0) -> Column:
    """A seed in 0..2^32-1 from the first 32 bits of the id's MD5, plus the channel."""
    first = F.conv(F.substring(F.md5(item_id.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(first + (F.lit(channel) if isinstance(channel, int) else channel), F.lit(1 << 32))


def cross_periods(secondary: Column, p: Column, period: Column, nc: Column) -> Column:
    """Lags in units of periods: secondary periods over p that fit twice into nc; for p = 1 also the primary period, sorted."""
    lags = F.transform(secondary, lambda s: F.when(p >= 2, F.floor(s / p).cast("int")).otherwise(s.cast("int")))
    kept = F.filter(lags, lambda c: (c >= 2) & (c <= F.floor(nc / 2)))
    own = (p == 1) & (period >= 2) & (period <= F.floor(nc / 2))
    return F.when(own, F.array_sort(F.array_distinct(F.concat(kept, F.array(period.cast("int")))))).otherwise(kept)


def damped_trend(phi: Column, m: Column | int, nc: Column) -> Column:
    """The trend regressor at steps 1..m: a geometric sum, constant where phi is 0."""
    capped = F.least(phi, F.lit(1 - TINY))
    steps = F.sequence(F.lit(1), F.lit(m) if isinstance(m, int) else m)
    return F.transform(steps, lambda j: F.when(capped <= TINY, (nc - 1) / nc).otherwise((nc - 1 + capped * (1 - F.pow(capped, j.cast("double"))) / (1 - capped)) / nc))


def point_path(beta: Column, trend: Column, history: Column, max_cp: int) -> Column:
    """The noise-free recursion of the level: beta = (constant, trend, lag 1[, lag max_cp]); history in order."""
    grow = lambda acc, d: F.concat(acc, F.array(beta[0] + beta[1] * d + beta[2] * F.element_at(acc, -1) + (beta[3] * F.element_at(acc, F.lit(-max_cp)) if max_cp >= 2 else F.lit(0.0))))
    kept = F.slice(history, F.greatest(F.size(history) - max(max_cp, 1) + 1, F.lit(1)), F.lit(max(max_cp, 1)))
    full = F.aggregate(trend, kept, grow)
    return F.slice(full, F.size(kept) + 1, F.size(trend))
