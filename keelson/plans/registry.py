"""All queries of the engine and their SQL."""

from __future__ import annotations

from keelson.plans import control, log, parts, replica, rundir, steps, telemetry  # noqa: F401
from keelson.plans.names import FLAGSHIP, ORACLES, QUERIES, Query, query

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "Query", "query"]
