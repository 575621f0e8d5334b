"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, ladder, markets, research

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**ladder.QUERIES, **research.QUERIES, **markets.QUERIES, **files.QUERIES}
SQL: dict[str, str] = {**ladder.SQL, **research.SQL, **markets.SQL, **files.SQL}
