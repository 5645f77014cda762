"""Queries by name for the entry module, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronopath.plans import frontier_queries, function_queries, graph_queries, profile_queries, star_queries, study_queries, workload_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**graph_queries.QUERIES, **frontier_queries.QUERIES, **function_queries.QUERIES, **profile_queries.QUERIES, **star_queries.QUERIES, **study_queries.QUERIES, **workload_queries.QUERIES}
SQL: dict[str, str] = {**graph_queries.SQL, **frontier_queries.SQL, **function_queries.SQL, **profile_queries.SQL, **star_queries.SQL, **study_queries.SQL, **workload_queries.SQL}
flagship = graph_queries.flagship
