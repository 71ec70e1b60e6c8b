"""Proportion statistics as Column expressions (no UDF, no collected table)."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed value: two-sided 95% normal quantile.
Z95 = 1.959963984540054

_ERFC_SERIES_TERMS = 80
_ERFC_FRACTION_DEPTH = 80


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def wilson_ci(k, n, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of k / n in percent; null when n <= 0."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    n = F.when(n > 0, n)
    p = k / n
    zz = F.lit(z * z)
    denom = 1 + zz / n
    centre = (p + zz / (2 * n)) / denom
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / denom
    return (centre - half) * 100, (centre + half) * 100


def diff_ci(k1, n1, k2, n2, z: float = Z95) -> tuple[Column, Column, Column]:
    """k1/n1 − k2/n2 with Newcombe's hybrid score interval (method 10, 1998), in points."""
    k1, n1, k2, n2 = (_c(x).cast("double") for x in (k1, n1, k2, n2))
    p1, p2 = k1 / F.when(n1 > 0, n1), k2 / F.when(n2 > 0, n2)
    (lo1, hi1), (lo2, hi2) = wilson_ci(k1, n1, z), wilson_ci(k2, n2, z)
    d = p1 - p2
    down = F.sqrt(F.pow(p1 - lo1 / 100, 2) + F.pow(hi2 / 100 - p2, 2))
    up = F.sqrt(F.pow(hi1 / 100 - p1, 2) + F.pow(p2 - lo2 / 100, 2))
    return d * 100, (d - down) * 100, (d + up) * 100


def erfc(z) -> Column:
    """Complementary error function for z >= 0.

    Below 2 the all-positive series of erf; from 2 on the continued fraction, evaluated backwards.
    """
    z = _c(z)
    bell = F.exp(-z * z) / math.sqrt(math.pi)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_ERFC_SERIES_TERMS)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * 2 * z * z / (2 * i + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2 * z * z / (2 * i + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(_ERFC_FRACTION_DEPTH), F.lit(1), F.lit(-1)),
        z,
        lambda acc, i: z + (i / 2) / acc,
    )
    return F.when(z < 2, 1 - 2 * bell * series).otherwise(bell / F.when(z > 0, fraction))


def chi2_sf(x, dof) -> Column:
    """Upper tail of the chi-square distribution with a whole number of degrees of freedom.

    Q(dof/2, x/2) is a finite sum for whole dof: Poisson terms for even dof, erfc plus
    half-integer terms for odd dof. Terms are built in logs so a large x cannot overflow.
    """
    x, dof = _c(x), _c(dof).cast("int")
    h = x / 2
    odd = dof % 2 == 1
    n_terms = F.when(odd, (dof - 1) / 2).otherwise(dof / 2).cast("int")
    first = F.when(odd, -h + F.log(h) / 2 - math.log(math.sqrt(math.pi) / 2)).otherwise(-h)
    step = lambda i: F.log(h) - F.log(F.when(odd, i + 0.5).otherwise(i.cast("double")))
    steps = F.when(n_terms > 1, F.sequence(F.lit(1), n_terms - 1)).otherwise(
        F.array().cast("array<int>")
    )
    tail = F.aggregate(
        steps,
        F.struct(first.alias("log_term"), F.exp(first).alias("total")),
        lambda acc, i: F.struct(
            (acc["log_term"] + step(i)).alias("log_term"),
            (acc["total"] + F.exp(acc["log_term"] + step(i))).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    tail = F.when(n_terms >= 1, tail).otherwise(0.0)
    q = F.when(odd, erfc(F.sqrt(h)) + tail).otherwise(tail)
    return (
        F.when(x.isNull() | dof.isNull(), F.lit(None).cast("double"))
        .when((dof <= 0) | (x <= 0), 1.0)
        .otherwise(F.least(q, F.lit(1.0)))
    )


def t_two_sided_p(t, dof) -> Column:
    """Two-sided p of Student's t with whole dof >= 1 (finite cosine sums)."""
    t, dof = _c(t), _c(dof).cast("int")
    theta = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    cos2 = F.pow(F.cos(theta), 2)
    odd = dof % 2 == 1
    n_terms = F.floor(F.when(odd, (dof - 1) / 2).otherwise(dof / 2)).cast("int")
    factor = lambda i: F.when(odd, 2.0 * i / (2.0 * i + 1)).otherwise((2.0 * i - 1) / (2.0 * i))
    steps = F.when(n_terms > 1, F.sequence(F.lit(1), n_terms - 1)).otherwise(
        F.array().cast("array<int>")
    )
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * factor(i) * cos2).alias("term"),
            (acc["total"] + acc["term"] * factor(i) * cos2).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    total = F.when(n_terms >= 1, total).otherwise(0.0)
    inside = F.when(odd, 2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * total)).otherwise(
        F.sin(theta) * total
    )
    return F.when(dof >= 1, F.greatest(F.lit(0.0), 1 - inside))
