"""Readers of scenes, proposals, maps and lists, chains as JSON, and writers of summaries and packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.functions import rle

CHAIN = "video_id string, question string, question_type string, final_answer string, triplets array<struct<question:string,answer:string,role:string,depends_on:array<int>,evidence:struct<t_start:int,t_end:int,box:array<double>>>>"
SCENE = "scene_index int, video_filename string, object_property array<struct<object_id:int,color:string,material:string,shape:string>>, motion_trajectory array<struct<frame_id:int,objects:array<struct<object_id:int,velocity:array<double>,inside_camera_view:boolean>>>>, collision array<struct<object_ids:array<int>,frame_id:int>>"
PROPOSALS = "video_name string, frames array<struct<frame_index:int,objects:array<struct<mask:struct<size:array<int>,counts:string>,color:string,material:string,shape:string,score:double>>>>"


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with a stated schema; broken lines are dropped."""
    read = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).select(read.alias("r")).where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")


def choices(questions: DataFrame) -> DataFrame:
    """One row for each choice of the questions that ``readers.questions`` gives, with null for those without."""
    return questions.select("*", F.posexplode_outer("choices").alias("choice_at", "c")).select(*[c for c in questions.columns if c != "choices"], "choice_at", F.col("c.choice").alias("choice"), F.col("c.answer").alias("choice_answer"), F.col("c.program").alias("choice_program"))


def scene_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """objects (scene, obj, color, material, shape), frames (scene, obj, frame, speed) while visible, and collisions (scene, a, b, frame) of rows of annotations.

    The two objects of a collision stand as the annotation has them; an object of which it is not said is visible.
    """
    o = raw.select(F.col("scene_index").alias("scene"), F.explode("object_property").alias("o")).select("scene", F.col("o.object_id").alias("obj"), "o.color", "o.material", "o.shape")
    m = raw.select(F.col("scene_index").alias("scene"), F.explode("motion_trajectory").alias("m")).select("scene", F.col("m.frame_id").alias("frame"), F.explode("m.objects").alias("o"))
    v = F.col("o.velocity")
    frames = m.where(F.coalesce("o.inside_camera_view", F.lit(True))).select("scene", F.col("o.object_id").alias("obj"), "frame", F.hypot(F.coalesce(F.get(v, 0), F.lit(0.0)), F.coalesce(F.get(v, 1), F.lit(0.0))).alias("speed"))
    c = raw.select(F.col("scene_index").alias("scene"), F.explode("collision").alias("c")).select("scene", F.get("c.object_ids", 0).alias("a"), F.get("c.object_ids", 1).alias("b"), F.col("c.frame_id").alias("frame"))
    return {"objects": o, "frames": frames, "collisions": c}


def scenes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``scene_tables`` of annotation files, the smaller object of a collision first."""
    t = scene_tables(spark.read.schema(SCENE).option("multiLine", True).json(path))
    return t | {"collisions": t["collisions"].select("scene", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "frame")}


def proposals(spark: SparkSession, path: str) -> DataFrame:
    """(scene, frame, color, material, shape, score, ord, box) of detection files; ``ord`` is the place in the frame, a box is the mask's, as shares of its size, null if the mask is empty."""
    raw = spark.read.schema(PROPOSALS).option("multiLine", True).json(path)
    f = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1).cast("int").alias("scene"), F.explode("frames").alias("f"))
    o = f.select("scene", F.col("f.frame_index").alias("frame"), F.posexplode("f.objects").alias("ord", "o")).select("scene", "frame", "o.color", "o.material", "o.shape", "o.score", "ord", F.col("o.mask.counts").alias("counts"), F.get("o.mask.size", 0).alias("h"), F.get("o.mask.size", 1).alias("w"))
    # runs are a list of numbers, or their compressed string
    runs = F.when(F.col("counts").startswith("["), F.from_json("counts", "array<bigint>")).otherwise(rle.decode_counts("counts"))
    b = rle.runs_to_box(runs, F.col("h"))
    share = F.struct((b["x0"] / F.col("w")).alias("x0"), (b["y0"] / F.col("h")).alias("y0"), (b["x1"] / F.col("w")).alias("x1"), (b["y1"] / F.col("h")).alias("y1"))
    return o.select("scene", "frame", "color", "material", "shape", "score", "ord", F.when(b.isNotNull(), share).alias("box"))


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a file that is one JSON object of strings."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a file that is one JSON array of strings."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("id")).distinct()


def scene_folder(scene, head: str = "video") -> Column:
    """The folder of a thousand scenes that a scene is in."""
    low = F.floor(scene / 1000) * 1000
    return F.format_string(f"{head}_%05d-%05d", low, low + 1000)


def scene_file(scene, head: str = "video", ending: str = "mp4") -> Column:
    return F.concat_ws("/", scene_folder(scene, head), F.format_string(f"{head}_%05d.{ending}", scene.cast("long")))


def chain_to_json(chain, answer, video: Column | None = None, question: Column | None = None, kind: Column | None = None) -> Column:
    """A chain in the form that files hold, roles where its steps have them."""
    blank = F.lit("")
    step = lambda s: F.struct(s["question"].alias("question"), s["answer"].alias("answer"), s["role"].alias("role"), F.struct(s["t0"].alias("t_start"), s["t1"].alias("t_end"), F.array(*[s["box"][c] for c in ("x0", "y0", "x1", "y1")]).alias("box")).alias("evidence"), s["deps"].alias("depends_on"))
    return F.to_json(F.struct((video if video is not None else blank).alias("video_id"), (question if question is not None else blank).alias("question"), (kind if kind is not None else F.lit(None).cast("string")).alias("question_type"), answer.alias("final_answer"), F.transform(chain, step).alias("triplets")))


def chain_from_json(text, schema: str = CHAIN) -> Column:
    return F.from_json(text, schema)


def type_tree(spark: SparkSession, path: str) -> str:
    """The types of a JSON file's nested fields, as Spark infers them over all of it."""
    return spark.read.option("multiLine", True).json(path).schema.simpleString()


def write_summary(df: DataFrame, path: str) -> None:
    """A small summary as one JSON file next to the rows."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_pack(records: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Writes records in a folder for each group, and returns the counts of the groups."""
    records.write.mode("overwrite").partitionBy(*by).parquet(path)
    return records.sparkSession.read.parquet(path).groupBy(*by).agg(F.count("*").alias("n"))
