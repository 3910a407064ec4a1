"""Columns bound to one evaluation per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row.

    A later filter on a plain projected column is pushed below it and repeats
    its expression; it is not pushed below a generator. The generator here
    yields exactly one row, so it only binds the values.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)).alias(*columns))
