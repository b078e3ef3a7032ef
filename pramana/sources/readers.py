"""Readers and writers of the evaluation's files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "id string, question_type string, prompt string, raw string, gold string, pred string, correct int, qid string, qset string, frames_key string, masked_fraction double"
QUESTIONS = "scene_index int, video_filename string, questions array<struct<question_id:int,question:string,question_type:string,question_subtype:string,program:array<string>,answer:string,choices:array<struct<choice_id:int,choice:string,program:array<string>,answer:string>>>>"


def run_rows(spark: SparkSession, path: str, schema: str = RUN) -> DataFrame:
    """Rows of result files, the last of each id; a broken last line is dropped."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at")).where("_corrupt is null and id is not null")
    kept = [c for c in rows.columns if c not in ("_corrupt", "_file", "_at", "id")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*kept), F.struct("_file", "_at")).alias("r")).select("id", "r.*")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each question of nested scene files."""
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path).select("scene_index", "video_filename", F.explode("questions").alias("q")).select("scene_index", "video_filename", "q.*")


def option_csv(spark: SparkSession, path: str) -> DataFrame:
    """Question, answer number and options a0 to a4 of a comma-separated file with quoted fields."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return raw.select("video", "qid", "type", "question", F.col("answer").try_cast("int").alias("right"), F.array("a0", "a1", "a2", "a3", "a4").alias("options"))


def split_choices(column) -> F.Column:
    """Pipe-delimited numbered choices as an array; empty ones go before their numbers are cut off."""
    parts = F.filter(F.transform(F.split(column, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    return F.transform(parts, lambda c: F.regexp_replace(c, r"^\d+\.\s*", ""))


def two_set_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row for each of a question's two option sets, with its video where the file names one; sets without an answer are left out."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    sets = F.array(*[F.struct(F.lit(k).alias("set"), F.col(f"choices{k}").alias("choices"), F.col(f"correct{k}").alias("gold")) for k in (1, 2)])
    video = F.col("renamed_video") if "renamed_video" in raw.columns else F.lit(None).cast("string")
    head = ["qid", "type", "question", "difficulty", "video"]
    return raw.withColumn("video", video).select(*head, F.explode(sets).alias("s")).select(*head, "s.set", split_choices(F.col("s.choices")).alias("options"), F.trim("s.gold").alias("gold")).where("gold <> ''")


def entity_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(video, phrase, frame, box) of nested detection files; keys that start with an underscore are summaries."""
    text = spark.read.text(path, wholetext=True)
    maps = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("video", "v")).where("video not like '\\\\_%'")
    phrases = maps.select("video", F.explode(F.from_json("v", "map<string,map<string,array<double>>>")).alias("phrase", "frames"))
    b = F.col("b")
    return phrases.select("video", "phrase", F.explode("frames").alias("frame", "b")).select("video", "phrase", F.col("frame").cast("int").alias("frame"), F.struct(*[b[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]).alias("box"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of audit files; quoted JSON strings are read as their content, quoted texts that are no JSON stay as they are."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")
    is_json = F.col("value").rlike(r'^"([^"\\\x00-\x1f]|\\.)*"$')
    return raw.select("name", F.when(is_json, F.coalesce(quoted, F.col("value"))).otherwise(F.col("value")).alias("value"))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_runs(df: DataFrame, path: str) -> None:
    """One folder for each tag and condition, so that a report reads only its own."""
    df.write.mode("append").partitionBy("tag", "condition").parquet(path)


def _small(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows: write it as a table")
    return rows


def json_report(df: DataFrame, key: str, most: int = 1000) -> str:
    """A small report as one indented JSON object: an object of the other columns for each key, null ones left out, keys and columns in the report's order.

    An error if it has more than ``most`` rows, as none is left out, or if a key is null or comes twice.
    """
    # Spark writes the values, so that nested ones, times and decimals read as in any other file
    line = F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("line")
    out = {}
    for k, text in _small(df.select(F.col(key).cast("string"), line), most):
        if k is None or k in out:
            raise ValueError(f"a report has one row for each {key}: {k}")
        out[k] = json.loads(text)
    return json.dumps(out, indent=2, ensure_ascii=False)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small report as a table; an error if it has more than ``most`` rows, as none is left out."""
    rows = _small(df, most)
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(show, r)) + " |" for r in rows]])
