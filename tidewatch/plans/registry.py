"""All queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from tidewatch.plans import boxes_queries, detection_queries, parse_queries, raster_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (detection_queries, parse_queries, raster_queries, boxes_queries):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
