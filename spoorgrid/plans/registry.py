"""Registered queries: the Spark job, its independent SQL and the columns compared after rounding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorgrid.plans.bindings import bound, with_duck

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


class Source:
    """Bindings of one table folder, by name: `src.frames`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return bound(self.spark, self.sf_dir, name)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round floating columns so that two engines agree to `digits` places; whole numbers become BIGINT."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append((F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def query(name: str, binds: str = "", sql: str | None = None, real: str = "", whole: str = "",
          digits: int = DIGITS):
    """Register `fn(src)`. `real` lists floating output columns, `whole` integer ones (cast to BIGINT)."""

    def register(fn):
        full = None
        if sql is not None:
            body = with_duck(binds, sql) if binds else sql
            swaps = [f"round(cast({c} as double), {digits}) + 0e0 as {c}" for c in real.split()]
            swaps += [f"cast({c} as bigint) as {c}" for c in whole.split()]
            full = f"select * replace ({', '.join(swaps)}) from ({body})" if swaps else body
        REGISTRY[name] = Query(name, lambda spark, sf_dir: rounded(fn(Source(spark, sf_dir)), digits), full)
        return fn

    return register
