"""Queries over the driver's tables: each a Spark callable and, where SQL can express it, DuckDB SQL for the same rows."""

from aerolith.queries import features, geodesy, streams, symbols, terrain, tiles, tracking

QUERIES = {}
ORACLE_SQL = {}
for _m in (geodesy, tracking, terrain, tiles, symbols, features, streams):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
