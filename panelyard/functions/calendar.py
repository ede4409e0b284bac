"""Calendar, location and classification columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Left-closed classes, upper bounds and labels.
LATITUDE_BANDS = ((-60, "[-90,-60)"), (-30, "[-60,-30)"), (0, "[-30,0)"), (30, "[0,30)"), (60, "[30,60)"), (None, "[60,90]"))
INDEX_BINS = ((-2, "(-inf,-2)"), (-1.5, "[-2,-1.5)"), (-1, "[-1.5,-1)"), (1, "[-1,1)"), (1.5, "[1,1.5)"), (2, "[1.5,2)"), (None, "[2,inf)"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_index(d: Column | str) -> Column:
    return F.year(col(d)) * 12 + F.month(col(d)) - 1


def months_between(a: Column | str, b: Column | str) -> Column:
    """Signed count of calendar months from ``a`` to ``b``; days don't matter."""
    return month_index(b) - month_index(a)


def months_since_epoch(d: Column | str) -> Column:
    return month_index(d) - 1970 * 12


def add_months(d: Column | str, n: Column | int) -> Column:
    return F.add_months(col(d), n)


def target_month(d: Column | str) -> Column:
    return add_months(d, 1)


def effective_horizon(last_observed: Column | str, target: Column | str) -> Column:
    return months_between(last_observed, target)


def cell_index(degrees: Column | str) -> Column:
    """Twice the degrees, as a whole number; exact on a half-degree grid."""
    return F.round(col(degrees) * 2).cast("bigint")


def location_id(lat2: Column | str = "lat2", lon2: Column | str = "lon2") -> Column:
    return F.concat(F.lit("lat2="), col(lat2).cast("string"), F.lit(";lon2="), col(lon2).cast("string"))


def parse_location(value: Column | str) -> tuple[Column, Column]:
    lat, lon = (F.split_part(F.split_part(col(value), F.lit(";"), F.lit(i)), F.lit("="), F.lit(2)).cast("bigint") for i in (1, 2))
    return lat, lon


def finite(x: Column | str) -> Column:
    """True for numbers, false for NaN, infinities and null."""
    return F.coalesce(F.abs(col(x).cast("double")) < F.lit(float("inf")), F.lit(False))


def classify(x: Column | str, classes) -> Column:
    """Label of the left-closed class; null for null and NaN."""
    out = None
    for bound, label in classes:
        if bound is not None:
            out = F.when(col(x) < bound, label) if out is None else out.when(col(x) < bound, label)
        else:
            out = out.when(finite(x), label)
    return out


def latitude_band(lat: Column | str) -> Column:
    return F.when(F.abs(col(lat)) <= 90, classify(lat, LATITUDE_BANDS))


def index_bin(x: Column | str) -> Column:
    return classify(x, INDEX_BINS)


def wide_band(lat: Column | str) -> Column:
    """Number of the 30-degree band, from the south."""
    return F.floor((col(lat) + 90) / 30).cast("int")


def spherical(lat: Column | str, lon: Column | str) -> dict[str, Column]:
    return {"lat_sin": F.sin(F.radians(col(lat))), "lat_cos": F.cos(F.radians(col(lat))), "lon_sin": F.sin(F.radians(col(lon))), "lon_cos": F.cos(F.radians(col(lon)))}


def recency_weight(month: Column | str, latest: Column | str, half_life: float = 24.0) -> Column:
    return F.pow(F.lit(0.5), months_between(month, latest) / F.lit(half_life))


def first_available(stages: dict[str, Column]) -> dict[str, Column]:
    """Fallback chain: the value, the level (0 first), the stage's name, and what was missing before it."""
    names = list(stages)
    level = stage = F
    for i, (name, c) in enumerate(stages.items()):
        level, stage = level.when(c.isNotNull(), i), stage.when(c.isNotNull(), name)
    level = level.otherwise(F.lit(None).cast("int"))
    missing = F.array_join(F.slice(F.array(*map(F.lit, names)), 1, level), ",")
    return {"prediction": F.coalesce(*stages.values()), "fallback_level": level, "fallback_stage": stage.otherwise("exhausted"), "fallback_reason": F.when(level == 0, "primary").when(level > 0, F.concat(F.lit("missing:"), missing)).otherwise("exhausted")}
