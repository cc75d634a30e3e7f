"""Steps of a plan that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, **steps: Column) -> DataFrame:
    """Add columns through a one-row generator, so that each is computed once per row.

    Plain projections collapse into one expression: later steps would repeat the earlier ones
    for every use and pull lambda functions into the arguments of Python functions.
    """
    one = F.struct(*[value.alias(name) for name, value in steps.items()])
    return df.select("*", F.inline(F.array(one)))
