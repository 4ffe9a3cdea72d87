"""All queries over the driver's tables, with the SQL that gives the same rows where there is such SQL."""

from __future__ import annotations

from emberline.plans import behaviour, consequences, grids, incidents, places, weather  # noqa: F401  they register their queries
from emberline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
