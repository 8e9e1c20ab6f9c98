"""A helper that keeps large expressions from being copied through a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once.

    Filters and projections above are otherwise rewritten in terms of the full expressions, which multiplies
    nested ones. A one-element `inline` passes the values on as plain attributes and stays in code generation.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))
