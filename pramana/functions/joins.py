"""How the sides of a join meet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join on equal keys: both sides are dealt by key and sorted, whatever size Spark expects of them.

    What is expected from a file's size says little once texts are parsed and lists exploded, and a side that is small when
    packed for a shuffle need not be small in memory: a side that grows with the input would go whole through the driver.
    """
    return df.hint("merge")
