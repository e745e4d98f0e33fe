"""Registered queries and their check SQL, grouped by inventory section."""

from placeloom.catalog import aggregates, filters, functions, joins, jobs, ranking, scans, streams, tables  # noqa: F401
from placeloom.catalog.registry import CHECKS, QUERIES  # noqa: F401
