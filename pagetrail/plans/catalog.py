"""All core queries with their SQL twins."""

from __future__ import annotations

from pagetrail.plans import extras, extras_sql, nested, pools, pools_sql, requests, runs, runs_sql

QUERIES = {**nested.QUERIES, **pools.QUERIES, **runs.QUERIES, **extras.QUERIES, **requests.QUERIES}
SQL = {**nested.SQL, **pools_sql.SQL, **runs_sql.SQL, **extras_sql.SQL, **requests.SQL}
FLAGSHIP = pools.shortlist_top20
