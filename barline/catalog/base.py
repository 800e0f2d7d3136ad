"""Registration: a query is a callable on (spark, sf_dir); its twin is a SQL string or absent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import rounded
from .sql import build

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def normalised(df: DataFrame, digits: int = 6) -> DataFrame:
    """BIGINT integers and rounded doubles, so values compare across engines."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(rounded(F.col(f.name).cast("double"), digits).alias(f.name))
        elif isinstance(f.dataType, T.IntegralType):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def query(name: str, deps: str | None = None, sql: str | None = None, keys: str = "", ints: str = "",
          floats: str = "", digits: int = 6):
    """Register a query and, when ``sql`` is given, its twin."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        cols = [*keys.split(), *ints.split(), *floats.split()]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return normalised(df.select(*cols) if cols else df, digits)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = build(deps or "", sql, keys, ints, floats, digits)
        return fn
    return wrap
