"""Event families as one timeline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timeline(families: dict[str, DataFrame]) -> DataFrame:
    """All families in one table with `family`; columns that a family lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("family", F.lit(name)) for name, df in families.items()])
