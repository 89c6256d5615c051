"""Where queries register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _filtered_counts(sql: str) -> str:
    """count_if(x) as a filtered count, whose type is BIGINT in SQL engines."""
    while (at := sql.find("count_if(")) >= 0:
        start = at + len("count_if(")
        depth, end = 1, start
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}(count(*) FILTER (WHERE {sql[start : end - 1]})){sql[end:]}"
    return sql


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _filtered_counts(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def literal(x: float) -> Column:
    return F.lit(float(x))
