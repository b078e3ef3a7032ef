"""Profiles of nested JSON by path, to any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pramana.sources.shared import kept, shared_folder

#: Deeper than this no JSON is followed: an error tells so.
DEEPEST = 100
_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")


def nested_profile(df: DataFrame, column: str) -> DataFrame:
    """(path, kind, n, low, high, shortest, longest) of a column of JSON texts, of a VARIANT, or of any nested column.

    A path names keys after dots and any element of an array as [*]; $ is the whole. Kinds are object, array, number,
    string, boolean, null, and invalid for a text that is no JSON; a path has a row for each kind it takes. low and high are of
    numbers, shortest and longest of the characters of strings and the elements of arrays. Null texts are left out.

    Texts are parsed once, into the shared folder; each level is one pass over them: nodes are exploded in the JVM and counted by path in each task before the shuffle, so that what
    moves follows the number of paths. Levels go on as long as there are objects or arrays that hold something.
    """
    spark = df.sparkSession
    kind = df.schema[column].dataType.typeName()
    c = F.col(f"`{column}`")
    value = c if kind == "variant" else F.try_parse_json(c if kind == "string" else F.to_json(c, {"ignoreNullFields": "false"}))
    root, out = shared_folder(spark, "profile"), None
    # read and parsed once, whatever the depth
    level = kept(df.where(c.isNotNull()).select(value.alias("v")), "parsed").select(F.lit("$").alias("path"), "v")
    for depth in range(DEEPEST + 1):
        named = level.withColumn("type", F.schema_of_variant("v"))
        head = F.regexp_extract("type", "^[A-Z]+", 0)
        kinds = F.when(F.col("v").isNull(), "invalid").when(head.isin(*_NUMBERS), "number").when(head == "VOID", "null").otherwise(F.lower(head))
        number = F.when(head.isin(*_NUMBERS), F.try_variant_get("v", "$", "double"))
        size = F.when(head == "STRING", F.length(F.try_variant_get("v", "$", "string"))).when(head == "ARRAY", F.size(F.try_variant_get("v", "$", "array<variant>")))
        found = named.groupBy("path", kinds.alias("kind")).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), F.min(size).alias("shortest"), F.max(size).alias("longest"))
        found.write.parquet(f"{root}/{depth}")
        done = spark.read.schema(found.schema).parquet(f"{root}/{depth}")
        out = done if out is None else out.unionByName(done)
        if done.where("kind = 'object' or kind = 'array' and longest > 0").isEmpty():
            return out
        holders = named.where(head.isin("OBJECT", "ARRAY"))
        inner = holders.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key"), F.col("value")))
        step = F.when(F.col("key").isNull(), "[*]").otherwise(F.concat(F.lit("."), "key"))
        level = inner.select(F.concat("path", step).alias("path"), F.col("value").alias("v"))
    raise ValueError(f"JSON is nested more than {DEEPEST} deep")
