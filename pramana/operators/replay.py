"""Controls as one sequential generator draws them, item after item, made in parallel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pramana.functions.twister import uniforms
from pramana.sources.shared import shared_folder

#: Boxes that a task draws, about.
TOGETHER = 200_000
_BOX = ("x0", "y0", "x1", "y1")


def replayed_controls(regions: DataFrame, order: list[str], box: str = "box", seed: int = 0, together: int = TOGETHER) -> DataFrame:
    """Adds ``control``: for each box one of its size, at the place where ``random.Random(seed)`` puts it when it draws
    an x and a y for one box after the other in ``order``, which must tell all boxes apart (say file, line and box).

    Equal to that run bit by bit, however the rows are dealt: a box takes two numbers, so what was drawn before a part of
    the rows is twice a sum of counts, and the generator's state there is reached by a jump. Rows without a box draw
    nothing and have no control. Draws whose number depends on what was drawn before, as with tries until a
    box is free, cannot be replayed so.
    """
    spark = regions.sparkSession
    given = regions.where(F.col(box).isNotNull())
    parts = max(1, -(-given.count() // together))
    path = shared_folder(spark, "replayed")
    given.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.schema(T.StructType([*given.schema.fields, T.StructField("_id", T.LongType())])).parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    past = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_past"))
    dealt = kept.join(past, "_part")
    size = {c: dealt.schema[box].dataType.fieldNames().index(c) for c in _BOX}

    def draw(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t["_id"].to_numpy())))
        b = t[box].combine_chunks()
        x0, y0, x1, y1 = (b.field(size[c]).to_numpy(zero_copy_only=False).astype(float) for c in _BOX)
        drawn = uniforms(seed, 2 * t["_past"][0].as_py(), 2 * t.num_rows).reshape(-1, 2)
        w, h = x1 - x0, y1 - y0
        x, y = np.maximum(0.0, 1.0 - w) * drawn[:, 0], np.maximum(0.0, 1.0 - h) * drawn[:, 1]
        control = pa.StructArray.from_arrays([pa.array(v) for v in (x, y, x + w, y + h)], names=list(_BOX))
        return t.drop_columns(["_id", "_part", "_past"]).append_column("control", control)

    double = T.StructType([T.StructField(c, T.DoubleType()) for c in _BOX])
    out = T.StructType([*given.schema.fields, T.StructField("control", double)])
    made = dealt.groupBy("_part").applyInArrow(draw, out)
    return made.unionByName(regions.where(F.col(box).isNull()).withColumn("control", F.lit(None).cast(double)))
