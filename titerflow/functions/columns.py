"""Column expressions: everything here stays inside whole-stage code generation."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number with optional exponent.
NUMBER_PATTERN = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
# Coefficients of the Abramowitz and Stegun 7.1.26 approximation of erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(col: Column | str) -> Column:
    """NaN becomes NULL, so that comparisons and aggregates treat it as untested."""
    col = as_col(col)
    return F.when(~F.isnan(col), col)


def to_number(col: Column | str) -> Column:
    """A double if the text is a plain finite number, else NULL."""
    return within_range(F.regexp_extract(as_col(col), rf"^\s*({NUMBER_PATTERN})\s*$", 1).try_cast("double"))


def within_range(number: Column) -> Column:
    """NULL where a number was too large for a double."""
    return F.when(F.abs(number) < float("inf"), number)


def parse_censored(col: Column | str) -> Column:
    """Struct ``(value, flag)`` from text such as ``>100``, ``< 5`` or ``12.5``.

    ``flag`` is ``>``, ``<``, ``=`` or ``invalid``; the value of an invalid text is NULL.
    """
    text = F.coalesce(as_col(col), F.lit(""))
    pattern = rf"^\s*([<>]?)\s*({NUMBER_PATTERN})\s*$"
    value = within_range(F.regexp_extract(text, pattern, 2).try_cast("double"))
    sign = F.regexp_extract(text, pattern, 1)
    flag = F.when(value.isNull(), "invalid").when(sign != "", sign).otherwise("=")
    return F.struct(value.alias("value"), flag.alias("flag"))


def key_block(col: Column | str, sep: str = "-") -> Column:
    """The part of a structure key before the first separator."""
    return F.substring_index(as_col(col), sep, 1)


def safe_id(*cols: Column | str) -> Column:
    """Join the parts with ``_`` and replace characters that are unsafe in file names."""
    joined = F.concat_ws("_", *[as_col(c).cast("string") for c in cols])
    return F.regexp_replace(joined, r"[^A-Za-z0-9_.-]", "_")


def binary_label(value: Column | str, threshold: Column | float, op: str = ">") -> Column:
    """0/1 label that stays NULL where the value or the threshold is missing."""
    value = finite(value)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    tests = {">": value > limit, ">=": value >= limit, "<=": value <= limit, "<": value < limit}
    return tests[op].cast("int")


def clip_probability(p: Column | str, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(as_col(p), F.lit(eps)), F.lit(1.0 - eps))


def link_probability(margin: Column | str, eps: float = 1e-6) -> Column:
    """Logistic link of a decision margin, clipped away from 0 and 1."""
    return clip_probability(1.0 / (1.0 + F.exp(-as_col(margin))), eps)


def hash_key(seed: int | str, *cols: Column | str) -> Column:
    """Reproducible random order: md5 of the seed and the columns as text, in hex."""
    parts = [as_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def hash_number(hexed: Column) -> Column:
    """The first eight hex digits of a hash as a non-negative long."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint")


def hash_draw(hexed: Column) -> Column:
    """The first fifteen hex digits of a hash as a non-negative long: fine enough to reach every row of a large table."""
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("bigint")


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error below 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + F.lit(ERF_P) * x)
    poly = reduce(lambda acc, a: acc * t + F.lit(a), reversed(ERF_A[:-1]), F.lit(ERF_A[-1])) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return 0.5 * (1.0 + F.when(z < 0, -erf).otherwise(erf))


def class_lag(p: Column | str) -> Column:
    """Distance of a probability from its nearest class."""
    p = as_col(p)
    return F.least(p, 1.0 - p)


def std_prob(mean: Column | str, std: Column | str, eps: float = 1e-9) -> Column:
    """Chance that the vote would flip, from the mean and spread of several models."""
    mean, std = as_col(mean), as_col(std)
    phi = normal_cdf((0.5 - mean) / std)
    return F.when(std < eps, class_lag(mean)).otherwise(F.least(phi, 1.0 - phi))


def desirability(col: Column | str, kind: str, low: float = 0.0, high: float = 1.0, k: float = 0.25) -> Column:
    """Map a property to [0, 1]: ``sigmoid``, ``reverse_sigmoid``, ``step`` or ``none``."""
    x = as_col(col).cast("double")
    if kind == "none":
        return x
    if kind == "step":
        return F.when(x.between(low, high), F.lit(1.0)).when(x.isNotNull(), F.lit(0.0))
    if kind not in ("sigmoid", "reverse_sigmoid"):
        raise ValueError(f"unknown transform {kind!r}")
    sign = 1.0 if kind == "sigmoid" else -1.0
    slope = sign * 10.0 * k / (low - high)
    return 1.0 / (1.0 + F.pow(F.lit(10.0), F.lit(slope) * (x - F.lit((low + high) / 2.0))))


def weighted_product(scores: list[Column], weights: list[float]) -> Column:
    """Weighted geometric mean; any zero component makes the result zero."""
    logs = [F.lit(float(w)) * F.log(s) for s, w in zip(scores, weights, strict=True)]
    mean_log = reduce(lambda a, b: a + b, logs) / F.lit(float(sum(weights)))
    any_zero = reduce(lambda a, b: a | b, [s <= 0 for s in scores])
    return F.when(any_zero, F.lit(0.0)).otherwise(F.exp(mean_log))


def safe_ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """``num / den`` with a fixed answer for a zero denominator."""
    return F.when(den != 0, num / den).otherwise(F.lit(empty).cast("double"))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Aggregate: Pearson r of the rows that have both; NULL where one side does not vary, in ANSI mode too."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
