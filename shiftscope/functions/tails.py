"""Tails of distributions as columns, from the mathematics library that ships with Spark."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _call(kind: str, method: str, *args: Column) -> Column:
    return F.reflect(F.lit(f"org.apache.commons.math3.{kind}"), F.lit(method), *args).cast("double")


def gamma_q(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function, 1 where a is 0."""
    return F.when(a > 0, _call("special.Gamma", "regularizedGammaQ", F.greatest(a, F.lit(0.5)).cast("double"), x.cast("double"))).otherwise(F.lit(1.0))


def chi2_tail(statistic: Column, dof: Column) -> Column:
    return gamma_q(dof / 2, statistic / 2)


def beta_i(x: Column, a: Column, b: Column) -> Column:
    return _call("special.Beta", "regularizedBeta", x.cast("double"), a.cast("double"), b.cast("double"))


def f_tail(statistic: Column, d1: Column, d2: Column) -> Column:
    """P(F > statistic)."""
    return beta_i(d2 / (d2 + d1 * statistic), d2 / 2, d1 / 2)


def log_gamma(x: Column) -> Column:
    return _call("special.Gamma", "logGamma", x.cast("double"))


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def ks_tail_equal(d: Column, n: Column) -> Column:
    """Exact two-sided p of the two-sample statistic d with n values on either side."""
    h = F.round(d * n).cast("long")
    term = lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(log_choose(2 * n, n - k * h) - log_choose(2 * n, n))
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.floor(n / F.greatest(h, F.lit(1))), F.lit(1)).cast("long"))
    p = 2 * F.aggregate(steps, F.lit(0.0), term)
    return F.when(h == 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
