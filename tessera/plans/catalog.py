"""Registered queries of the engine's own operators, each with the DuckDB SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import matching, projects, requests, retrieval, searching, tracking, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = retrieval.QUERIES | requests.QUERIES | projects.QUERIES | workspace.QUERIES | matching.QUERIES | tracking.QUERIES | searching.QUERIES
ORACLE: dict[str, str] = retrieval.ORACLE | requests.ORACLE | projects.ORACLE | workspace.ORACLE | matching.ORACLE | tracking.ORACLE | searching.ORACLE
