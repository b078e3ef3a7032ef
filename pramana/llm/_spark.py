"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that all executors share (``spark.checkpoint.dir``).

    Only a local master, as in tests, gets a folder of its own where the setting is unset.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def need_integer_ids(df: DataFrame, column: str) -> None:
    """An error that tells what is wrong, before any task fails on a cast."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise ValueError(f"{column} must be of an integer type, not {kind.simpleString()}")
