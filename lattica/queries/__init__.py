"""Queries over the test tables, one per operator, each with the SQL that gives the same rows."""

from lattica.queries import algebra, api, graphs

QUERIES = algebra.QUERIES | api.QUERIES | graphs.QUERIES
ORACLE = algebra.ORACLE | api.ORACLE | graphs.ORACLE
