"""All named queries of the analytics part, with their DuckDB texts."""

from tallymill.plans import log_queries, scale_queries, surface, usage_queries

QUERIES = {**usage_queries.QUERIES, **log_queries.QUERIES, **surface.QUERIES, **scale_queries.QUERIES}
ORACLE_SQL = {**usage_queries.ORACLE_SQL, **log_queries.ORACLE_SQL, **surface.ORACLE_SQL, **scale_queries.ORACLE_SQL}
