"""Checks of incoming rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of a request, as column, least and greatest value.
REQUEST_LIMITS = (
    ("temp", -50.0, 60.0), ("rh", 0.0, 100.0), ("wind", 0.0, 200.0), ("rain", 0.0, 500.0), ("ffmc", 0.0, 101.0), ("dmc", 0.0, 1000.0), ("dc", 0.0, 2000.0),
)


def broken(rules) -> Column:
    """The names of the columns outside their limits, in the rules' order; a null breaks none."""
    return F.filter(F.array(*[F.when((F.col(c) < a) | (F.col(c) > b), c) for c, a, b in rules]), lambda x: x.isNotNull())


def split_valid(df: DataFrame, rules=REQUEST_LIMITS) -> tuple[DataFrame, DataFrame]:
    """Rows within all limits, and the others with a column ``broken``."""
    x = df.withColumn("broken", broken([k for k in rules if k[0] in df.columns]))
    return x.where(F.size("broken") == 0).drop("broken"), x.where(F.size("broken") > 0)


def reading(text: Column, keep_negative: bool = False) -> Column:
    """A sensor's text as a number; null if it is none, or negative unless those are kept (temperatures)."""
    v = text.try_cast("double")
    return v if keep_negative else F.when(v >= 0, v)
