"""All registered queries. Importing a family registers it."""

from __future__ import annotations

from spendlake.plans import (  # noqa: F401
    catalog_detectors, catalog_recommend, catalog_series, catalog_sources, catalog_spend,
    catalog_staging,
)
from spendlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
