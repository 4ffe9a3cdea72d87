"""Classes, labels and suppression advice as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 16 points of the compass; limits of the suppression classes (kW/m) with their strategy; limits of the metric bands; kinds of teams.
POINTS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
CLASSES = (
    ("I", 200.0, "Direct Attack", True),
    ("II", 500.0, "Flanking / Direct on Flanks", True),
    ("III", 2000.0, "Indirect Attack", True),
    ("IV", 4000.0, "Defensive — Structure & Value Protection", False),
    ("V", None, "Life Safety Only — No Suppression", False),
)
BANDS = (10.0, 500.0, 2000.0, 4000.0, 10000.0)
COMPLEXITY = (
    (200.0, "Type 5 — Single resource / small crew"),
    (500.0, "Type 4 — Initial attack, small IMT"),
    (2000.0, "Type 3 — Extended attack IMT"),
    (4000.0, "Type 2 — Multi-agency / multi-division"),
    (None, "Type 1 — National/Regional IMT"),
)
TYPES = ("surface", "surface_with_torching", "passive_crown", "active_crown")


def _ladder(value: Column, steps, last) -> Column:
    out = F.lit(last)
    for limit, then in reversed(steps):
        out = F.when(value < limit, F.lit(then)).otherwise(out)
    return out


def intensity_class(hfi: Column) -> Column:
    return _ladder(hfi, [(c[1], c[0]) for c in CLASSES[:-1]], CLASSES[-1][0])


def strategy(hfi: Column) -> Column:
    return _ladder(hfi, [(c[1], c[2]) for c in CLASSES[:-1]], CLASSES[-1][2])


def feasible(hfi: Column) -> Column:
    return hfi < 2000.0


def intensity_band(hfi: Column) -> Column:
    return _ladder(hfi, [(b, i) for i, b in enumerate(BANDS)], len(BANDS))


def complexity(hfi: Column) -> Column:
    return _ladder(hfi, COMPLEXITY[:-1], COMPLEXITY[-1][1])


def standoff_m(fire_type: Column, spot_count: Column, max_spot_m: Column) -> Column:
    """Distance that drones keep: 500 m, or half as far again as embers fly; 1 km more at a crown fire."""
    base = F.when(spot_count > 0, F.greatest(F.lit(500.0), max_spot_m * 1.5)).otherwise(500.0)
    return base + F.when(F.contains(F.lower(fire_type), F.lit("crown")), 1000.0).otherwise(0.0)


def type_rank(fire_type: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TYPES]), fire_type), F.lit(0))


def title(fire_type: Column) -> Column:
    return F.initcap(F.replace(fire_type, F.lit("_"), F.lit(" ")))


def wind_label(degrees: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in POINTS]), (F.floor(degrees / 22.5 + 0.5) % 16 + 1).cast("int"))


def hours_label(hours: Column) -> Column:
    """T+30min, T+2h, T+2.5h."""
    whole = hours == F.floor(hours)
    return F.when(hours < 1, F.concat(F.lit("T+"), F.round(hours * 60).cast("int").cast("string"), F.lit("min"))).when(whole, F.concat(F.lit("T+"), hours.cast("int").cast("string"), F.lit("h"))).otherwise(F.concat(F.lit("T+"), F.format_number(hours, 1), F.lit("h")))
