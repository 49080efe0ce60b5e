"""Column expressions: thresholds, guarded quotients, decay, units, and the geometry of detectors and bins."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MM_PER_PS = 0.299792458


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.greatest(x, F.lit(float(low)))
    return x if high is None else F.least(x, F.lit(float(high)))


def pow_times_add(x: Column, power: float = 1.0, times: float = 1.0, add: float = 0.0, low: float | None = None, high: float | None = None) -> Column:
    """add + times * clamp(x) ** power."""
    x = clamp(x, low, high)
    x = x if power == 1.0 else F.pow(x, F.lit(float(power)))
    return F.lit(float(add)) + F.lit(float(times)) * x


def binary_mask(x: Column, threshold: float) -> Column:
    return F.when(x < threshold, 0.0).otherwise(1.0)


def safe_divide(num: Column, den: Column, small: Column | float) -> Column:
    """0 where numerator and denominator are both within ``small``; null, not an error, for other zero denominators."""
    small = small if isinstance(small, Column) else F.lit(float(small))
    return F.when((F.abs(num) <= small) & (F.abs(den) <= small), 0.0).otherwise(F.try_divide(num, den))


def decay_factor(start_s: Column, end_s: Column, half_life_s: float) -> Column:
    """Factor that corrects mean activity over a frame to time zero; short frames take the exponential at the start."""
    rate = math.log(2) / half_life_s
    span = rate * (end_s - start_s)
    return F.when(F.abs(span) < 0.01, F.exp(rate * start_s)).otherwise(span / (F.exp(-rate * start_s) - F.exp(-rate * end_s)))


def hounsfield_to_mu(x: Column, a1: float, b1: float, a2: float, b2: float, at: float) -> Column:
    return F.when(x < at, F.greatest(F.lit(0.0), a1 + b1 * x)).otherwise(a2 + b2 * x)


def ps_to_mm(ps: Column) -> Column:
    """Offset of the emission point along the line for a difference of arrival times."""
    return ps * (MM_PER_PS / 2)


def view_of_detectors(d1: Column, d2: Column, n: int) -> tuple[Column, Column, Column]:
    """View, tangential position and whether the pair was exchanged, for detectors numbered 0 to n - 1 on a ring."""
    t = F.pmod(d1 - d2 + F.lit(3 * n // 2), F.lit(n))
    v = F.pmod(d1 - F.shiftright(t, 1) + n, F.lit(n))
    # the view is folded to half a turn, the position to about 0; exactly one of the two exchanges the detectors
    half = n // 2
    early, near = v < half, t < half
    view = F.when(early, v).otherwise(v - half)
    tang = F.when(early & near, t).when(early, n - t).when(near, -t).otherwise(t - n)
    return view, tang, early != near


def detectors_of_view(view: Column, tang: Column, n: int) -> tuple[Column, Column]:
    return F.pmod(view + F.shiftright(tang, 1) + n, F.lit(n)), F.pmod(view - F.shiftright(tang + 1, 1) + n // 2, F.lit(n))


def kl_term(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Summand of the Kullback-Leibler divergence."""
    return F.when(a <= threshold, b).otherwise(a * (F.log(a) - F.log(b)) + b - a)


def log_likelihood_term(y: Column, mean: Column, small: Column | float) -> Column:
    """Summand of the Poisson log-likelihood; the mean is kept above a ten-thousandth of the measurement."""
    small = small if isinstance(small, Column) else F.lit(float(small))
    m = F.greatest(mean, y / 10000.0)
    return F.when(y <= small, -m).otherwise(y * F.log(m) - m)


def seconds_of_stamp(stamp: Column) -> Column:
    """Seconds since 1970 of yyyyMMddHHmmss[.fraction][+hhmm]; without an offset UTC is meant, another form is null."""
    form = r"^(\d{8})(\d{6})(\.\d+)?([+-]\d{4})?$"
    part = lambda i: F.regexp_extract(stamp, form, i)
    day = F.datediff(F.try_to_timestamp(part(1), F.lit("yyyyMMdd")), F.lit("1970-01-01").cast("date")).cast("double") * 86400
    two = lambda text, at: F.substring(text, at, 2).cast("double")
    clock = two(part(2), 1) * 3600 + two(part(2), 3) * 60 + two(part(2), 5)
    fraction = F.when(part(3) == "", 0.0).otherwise(F.concat(F.lit("0"), part(3)).try_cast("double"))
    offset = F.when(part(4) == "", 0.0).otherwise(F.when(F.substring(part(4), 1, 1) == "-", -1.0).otherwise(1.0) * (two(part(4), 2) * 3600 + two(part(4), 4) * 60))
    return F.when(stamp.rlike(form), day + clock + fraction - offset)
