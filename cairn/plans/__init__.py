"""Whole queries over the test tables, with SQL to compare them with."""
from . import profile_queries, report_queries, table_queries, trace_queries, training_queries

QUERIES = trace_queries.QUERIES | table_queries.QUERIES | report_queries.QUERIES | training_queries.QUERIES | profile_queries.QUERIES
SQL = trace_queries.ORACLE_SQL | table_queries.ORACLE_SQL | report_queries.ORACLE_SQL | training_queries.ORACLE_SQL | profile_queries.ORACLE_SQL
