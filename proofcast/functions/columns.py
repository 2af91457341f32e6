"""Column expressions: lead times, flags, scores and reproducible draws.

Everything here stays on the JVM; nothing is a Python UDF.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The study's lakes, in its display order.
LAKE_SITES = ("TOOK", "PRLA", "PRPO", "CRAM", "LIRO", "BARC", "SUGG")

# The weather covariates a model may list.
WEATHER_COVARIATES = (
    "air_temperature",
    "air_pressure",
    "relative_humidity",
    "surface_downwelling_longwave_flux_in_air",
    "surface_downwelling_shortwave_flux_in_air",
    "precipitation_flux",
    "eastward_wind",
    "northward_wind",
)

# The two reference models and their display labels.
CLIMATOLOGY = "climatology"
PERSISTENCE = "persistenceRW"
BASELINE_LABELS = {CLIMATOLOGY: "day-of-year", PERSISTENCE: "persistence"}

# Display labels of the baseline outcome classes, in display order.
OUTCOME_LABELS = {"none": "Neither", "RW": "Persistence", "DOY": "Day-of-year", "both": "Both"}

# Other spellings of model classes and the one used here.
MODEL_TYPE_SPELLINGS = {"process": "process-based", "multi-model ensemble": "MME"}

# Fewest observations for which a monthly figure is shown.
MIN_MONTHLY_SAMPLE = 18


def quoted(name: str) -> Column:
    """Column whose name may contain dots."""
    return F.col(f"`{name}`")


# --- lead time and filters -------------------------------------------------


def lead_days(valid: str = "datetime", issued: str = "reference_datetime") -> Column:
    """Whole days from issue date to valid date."""
    return F.datediff(F.to_date(F.col(valid)), F.to_date(F.col(issued)))


def lead_days_fractional(valid: str = "datetime", issued: str = "reference_datetime") -> Column:
    """Days from issue time to valid time, with the time of day."""
    seconds = F.col(valid).cast("timestamp").cast("double") - F.col(issued).cast("timestamp").cast("double")
    return seconds / 86400.0


def in_eval_window(horizon: str = "horizon", lo: int = 1, hi: int = 30, skip: Sequence[int] = (15,)) -> Column:
    """Lead times kept in an evaluation; null lead times are dropped."""
    h = F.col(horizon)
    keep = h.between(lo, hi)
    for day in skip:
        keep = keep & (h != day)
    return keep


def with_horizon(df: DataFrame) -> DataFrame:
    return df.withColumn("horizon", lead_days())


def eval_window(df: DataFrame, lo: int = 1, hi: int = 30, skip: Sequence[int] = (15,)) -> DataFrame:
    """Rows inside the evaluation window, lead time added."""
    return with_horizon(df).filter(in_eval_window(lo=lo, hi=hi, skip=skip))


def not_one_of(name: str, values: Iterable[str]) -> Column:
    """Negated membership that keeps rows whose value is null."""
    return ~F.coalesce(F.col(name).isin(list(values)), F.lit(False))


# --- flags -----------------------------------------------------------------


def mentions(text: str, word: str) -> Column:
    """Does a free-text list contain a word; null text gives null."""
    return F.col(text).contains(word)


def yes_no(flag: str) -> Column:
    f = F.col(flag)
    return F.when(f.isNotNull(), F.when(f == 1, "yes").otherwise("no"))


def row_sum(names: Sequence[str]) -> Column:
    """Sum across columns; null as soon as one is null."""
    return reduce(lambda a, b: a + b, [F.col(n).cast("int") for n in names])


def relabel(name: str, labels: dict[str, str]) -> Column:
    """Replace known values by labels and leave the others."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(name)), F.col(name))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def site_part(name: str = "site_id") -> Column:
    return F.get(F.split(F.col(name), "-", 2), F.lit(0))


def depth_part(name: str = "site_id") -> Column:
    return F.get(F.split(F.col(name), "-", 2), F.lit(1)).try_cast("double")


# --- binning ---------------------------------------------------------------


def order_bin(value: Column, per_octave: int = 1 << 16) -> Column:
    """Integer that never decreases as the value grows.

    Logarithmic in the magnitude, mirrored for negative values. It depends on
    the value alone, so recomputed tasks always agree. The default resolves
    values to one part in 10^5, so even values close together spread over many
    bins.
    """
    magnitude = F.floor(F.log2(F.abs(value)) * float(per_octave)) + F.lit(1100 * per_octave)
    return F.when(value > 0, magnitude).when(value < 0, -magnitude).when(value == 0, F.lit(0)).cast("bigint")


def rank_bin(rank: Column, most: int, bins: int = 10) -> Column:
    """Right-closed bins 1..bins over ranks 1..most; bins + 1 holds the ranks beyond."""
    edges = [math.ceil(most * i / bins) for i in range(bins + 1)]
    label = F.when(rank <= edges[0], F.lit(None))
    for i in range(1, bins + 1):
        label = label.when(rank <= edges[i], F.lit(i))
    return label.when(rank > edges[-1], F.lit(bins + 1)).cast("int")


# --- normal distribution ---------------------------------------------------

# Rational approximation of the normal tail (Hart 1968, West 2005),
# highest power first.
TAIL_NUMERATOR = (
    3.52624965998911e-2,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-2,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
TAIL_SWITCH = 7.07106781186547
TAIL_SCALE = 2.506628274631

# Standard normal quantiles for the central intervals.
Z_975 = 1.959963984540054
Z_950 = 1.6448536269514722
Z_900 = 1.2815515655446004


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function in double precision."""
    a = F.abs(x)
    bell = F.exp(-a * a / 2.0)
    near = bell * _polynomial(a, TAIL_NUMERATOR) / _polynomial(a, TAIL_DENOMINATOR)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    tail = F.when(a > 37.0, 0.0).when(a < TAIL_SWITCH, near).otherwise(bell / fraction / TAIL_SCALE)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def crps_normal(y: Column, mu: Column, sigma: Column) -> Column:
    """Closed-form CRPS of a normal forecast (Gneiting and Raftery 2007)."""
    z = (y - mu) / sigma
    density = F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    score = sigma * (z * (2.0 * normal_cdf(z) - 1.0) + 2.0 * density - 1.0 / math.sqrt(math.pi))
    return F.when(sigma > 0, score).when(sigma == 0, F.abs(y - mu))


def logs_normal(y: Column, mu: Column, sigma: Column) -> Column:
    """Negative log density of a normal forecast; needs a positive sigma."""
    z = (y - mu) / sigma
    return F.when(sigma > 0, z * z / 2.0 + F.log(sigma) + 0.5 * math.log(2.0 * math.pi))


# --- reproducible randomness -----------------------------------------------


def draw_key(seed: int, *parts: Column) -> Column:
    """Digest that stands in for a random number; same inputs, same draw."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def standard_normal(digest: Column) -> Column:
    """Box-Muller on the first sixteen hex digits of a digest.

    They make two numbers of eight digits. Conversions take most of the time, so one
    takes fifteen digits, which fit a long, and the last one is looked up.
    """
    most = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    last = F.instr(F.lit("0123456789abcdef"), F.substring(digest, 16, 1)) - 1
    u1 = F.shiftright(most, 28).cast("double")
    u2 = (most.bitwiseAND(F.lit((1 << 28) - 1)) * 16 + last).cast("double")
    radius = F.sqrt(-2.0 * F.log((u1 + 1.0) / 4294967297.0))
    return radius * F.cos(2.0 * math.pi * u2 / 4294967296.0)
