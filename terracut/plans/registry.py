"""All plan-sheet queries and their SQL."""

from __future__ import annotations

from terracut.plans import contours, drawn, queries, stages

QUERIES = queries.QUERIES | stages.QUERIES | contours.QUERIES | drawn.QUERIES
SQL = queries.SQL | stages.SQL | contours.SQL | drawn.SQL
