"""Closed forms of forecasts given by two parameters, beside the normal ones.

All are column expressions over the two parameters and the observation; null
where the parameters make no distribution. Formulas: Jordan, Krueger and Lerch
(2019), "Evaluating probabilistic forecasts with scoringRules".
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofcast.functions import columns as C

#: Standard normal quantiles of the levels that scores report.
NORMAL_QUANTILES = {0.5: 0.0, 0.9: C.Z_900, 0.95: C.Z_950, 0.975: C.Z_975}


@dataclass(frozen=True)
class Family:
    """Two parameters by name and what follows from them.

    `quantile` takes a level, `draw` the digest that stands in for a random number.
    """

    parameters: tuple[str, str]
    valid: Callable[[Column, Column], Column]
    crps: Callable[[Column, Column, Column], Column]
    logs: Callable[[Column, Column, Column], Column]
    mean: Callable[[Column, Column], Column]
    sd: Callable[[Column, Column], Column]
    quantile: Callable[[Column, Column, float], Column]
    draw: Callable[[Column, Column, Column], Column]


def _z(level: float) -> float:
    level = round(level, 12)
    return NORMAL_QUANTILES[level] if level in NORMAL_QUANTILES else -NORMAL_QUANTILES[round(1.0 - level, 12)]


def _uniform(digest: Column) -> Column:
    """A number between 0 and 1, never either, from eight hex digits."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _log_crps(y: Column, mu: Column, sigma: Column) -> Column:
    z = (F.log(y) - mu) / sigma
    below, shifted = (F.when(y > 0, C.normal_cdf(x)).when(y <= 0, 0.0) for x in (z, z - sigma))
    middle = C.normal_cdf(sigma / math.sqrt(2.0))
    return y * (2.0 * below - 1.0) - 2.0 * F.exp(mu + sigma * sigma / 2.0) * (shifted + middle - 1.0)


def _log_logs(y: Column, mu: Column, sigma: Column) -> Column:
    z = (F.log(y) - mu) / sigma
    return F.when(y > 0, z * z / 2.0 + F.log(sigma) + F.log(y) + 0.5 * math.log(2.0 * math.pi))


def _logistic_tail(y: Column, location: Column, scale: Column) -> tuple[Column, Column]:
    a = F.abs(y - location) / scale
    return a, F.log1p(F.exp(-a))


def _logistic_crps(y: Column, location: Column, scale: Column) -> Column:
    a, tail = _logistic_tail(y, location, scale)
    return scale * (a + 2.0 * tail - 1.0)


def _logistic_logs(y: Column, location: Column, scale: Column) -> Column:
    a, tail = _logistic_tail(y, location, scale)
    return a + F.log(scale) + 2.0 * tail


def _uniform_crps(y: Column, low: Column, high: Column) -> Column:
    w = (y - low) / (high - low)
    # greatest and least pass over nulls, an unknown observation must not
    inside = F.when(w.isNotNull(), F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)))
    return (high - low) * (F.abs(w - inside) + inside * inside - inside + 1.0 / 3.0)


#: Families by name. An observation where the density is zero has no log score.
FAMILIES: dict[str, Family] = {
    "lognormal": Family(
        ("meanlog", "sdlog"),
        valid=lambda a, b: b > 0,
        crps=_log_crps,
        logs=_log_logs,
        mean=lambda a, b: F.exp(a + b * b / 2.0),
        sd=lambda a, b: F.exp(a + b * b / 2.0) * F.sqrt(F.expm1(b * b)),
        quantile=lambda a, b, p: F.exp(a + b * _z(p)),
        draw=lambda a, b, digest: F.exp(a + b * C.standard_normal(digest)),
    ),
    "logistic": Family(
        ("location", "scale"),
        valid=lambda a, b: b > 0,
        crps=_logistic_crps,
        logs=_logistic_logs,
        mean=lambda a, b: a,
        sd=lambda a, b: b * (math.pi / math.sqrt(3.0)),
        quantile=lambda a, b, p: a + b * math.log(p / (1.0 - p)),
        draw=lambda a, b, digest: a + b * F.log(_uniform(digest) / (1.0 - _uniform(digest))),
    ),
    "uniform": Family(
        ("min", "max"),
        valid=lambda a, b: b > a,
        crps=_uniform_crps,
        logs=lambda y, a, b: F.when(y.between(a, b), F.log(b - a)),
        mean=lambda a, b: (a + b) / 2.0,
        sd=lambda a, b: (b - a) / math.sqrt(12.0),
        quantile=lambda a, b, p: a + (b - a) * p,
        draw=lambda a, b, digest: a + (b - a) * _uniform(digest),
    ),
}

#: Every parameter name of a registered family.
PARAMETERS = tuple(p for f in FAMILIES.values() for p in f.parameters)


def by_family(value: Callable[[Family, Column, Column], Column], family: str = "family") -> Column:
    """One figure of whichever registered family a row is of; null for others and bad parameters.

    The frame has a column for each name in PARAMETERS.
    """
    out = F.lit(None).cast("double")
    for name, kind in FAMILIES.items():
        a, b = (F.col(p) for p in kind.parameters)
        out = F.when((F.col(family) == name) & kind.valid(a, b), value(kind, a, b)).otherwise(out)
    return out
