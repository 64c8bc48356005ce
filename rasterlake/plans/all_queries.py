"""All registered queries."""

from __future__ import annotations

from rasterlake.plans import graph_queries, metric_queries, raster_queries, run_queries  # noqa: F401
from rasterlake.plans.registry import QUERIES, SQL  # noqa: F401
