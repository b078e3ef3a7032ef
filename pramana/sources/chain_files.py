"""Chains from files to files: the questions, annotations and detections of a split in, JSON lines of chains and a table of outcomes out.

    <root>/questions/<split>.json                                           a list of videos with their questions
    <root>/annotations/<split>/annotation_<split>/annotation_<first>-<end>  annotations, a thousand scenes to a folder
    <root>/derender_proposals/proposal_<scene>.json                         detections
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.operators import chains as C
from pramana.operators import programs as P
from pramana.operators import scenes as S
from pramana.sources import files, folders, readers
from pramana.sources.shared import kept

#: The types of questions; the first has no choices, of the others each choice has a chain.
TYPES = ("descriptive", "explanatory", "predictive", "counterfactual")
KEYS = ["scene", "question_id", "choice_id"]


def units(questions: DataFrame, types=TYPES) -> DataFrame:
    """A row for each question without choices and for each choice of the others, with its program and known answer.

    questions: as ``readers.questions`` gives them. A choice runs its own program, then its question's; its answer is yes if it is
    correct, else no. ``choice_id`` is -1 without a choice; a question of another type that has no choices has no row.
    """
    plain = F.col("question_type") == TYPES[0]
    alone = F.array(F.lit(None).cast(questions.schema["choices"].dataType.elementType))
    q = questions.where(F.col("question_type").isin(*types)).select("*", F.explode(F.when(plain, alone).otherwise(F.col("choices"))).alias("c"))
    none = F.array().cast("array<string>")
    steps = F.concat(F.when(plain, none).otherwise(F.coalesce("c.program", none)), F.coalesce("program", none))
    gold = F.when(plain, F.col("answer")).when(F.col("c.answer") == "correct", "yes").otherwise("no")
    return q.select(
        F.col("scene_index").alias("scene"), "question_id", F.coalesce("c.choice_id", F.lit(-1)).alias("choice_id"), "video_filename", "question", "question_type", "question_subtype",
        F.col("program").alias("question_program"), F.col("c.choice").alias("choice"), F.col("c.program").alias("choice_program"), steps.alias("program"), gold.alias("gold"), (~plain).alias("is_choice"),
    )


def scene_rows(annotations: DataFrame, proposals: DataFrame, frames: int = C.FRAMES) -> DataFrame:
    """What ``chains.build`` asks of a scene: its objects, events, visible frames and detections in one row.

    Collisions of one frame stand in the order of their objects.
    """
    t = files.scene_tables(annotations)
    log = S.events(t["frames"], S.retimed_collisions(t["collisions"], t["frames"]), frames - 1)
    return C.with_detections(P.scene_rows(t["objects"], t["frames"], log), t["objects"], C.best_detections(proposals))


def record():
    """A chain as a line of JSON, with where it comes from as its meta."""
    box = lambda s: F.array(*[s["evidence"]["box"][c] for c in ("x0", "y0", "x1", "y1")])
    step = lambda s: F.struct(s["question"].alias("question"), s["answer"].alias("answer"), F.struct(s["evidence"]["t0"].alias("t_start"), s["evidence"]["t1"].alias("t_end"), box(s).alias("box")).alias("evidence"), s["depends_on"].alias("depends_on"), s["role"].alias("role"))
    meta = [F.col("scene").alias("scene_index"), "question_id", "question_subtype", F.col("question_program").alias("program"), "executor_answer"]
    line = lambda more: F.to_json(F.struct(F.col("video_filename").alias("video_id"), "question", F.transform("triplets", step).alias("triplets"), "final_answer", "question_type", F.struct(*meta, *more).alias("meta")), {"ignoreNullFields": "false"})
    return F.when(F.col("is_choice"), line(["choice_id", "choice", "choice_program"])).otherwise(line([]))


def generate(spark: SparkSession, root: str, split: str, out: str, types=TYPES, n_videos: int | None = None, frames: int = C.FRAMES) -> DataFrame:
    """Writes the chains of a split under ``out``, and returns ``chains.status_counts`` of them by type.

    ``out/outcomes`` is a table with a row for each question or choice whatever came of it, ``out/chains`` has a line of JSON for each
    chain. ``n_videos`` takes the videos of the lowest scene numbers. Annotations outside the questions' range of scenes are
    not opened. Files are read and scenes put together once; an ``out`` that is there already is an error. Scenes without an annotation have
    no rows, scenes without detections none with evidence.
    """
    asked = readers.questions(spark, f"{root}/questions/{split}.json")
    if n_videos is not None:
        few = asked.select("scene_index").distinct().orderBy("scene_index").limit(n_videos)
        asked = asked.join(few, "scene_index", "left_semi")
    asked = kept(units(asked, types), "units")
    # two numbers, so that the sources can leave folders shut
    low, high = asked.agg(F.min("scene"), F.max("scene")).first()
    wanted, ours = asked.select("scene").distinct(), F.col("scene").between(*(F.lit(x if x is not None else -1) for x in (low, high)))
    folders.use_scene_folders(spark)
    a = folders.annotations(spark, f"{root}/annotations/{split}/annotation_{split}").where(ours).join(wanted, "scene", "left_semi")
    a = kept(a.select("scene_index", "object_property", "motion_trajectory", "collision"), "annotations")
    d = files.proposals(spark, f"{root}/derender_proposals").where(ours).join(wanted, "scene", "left_semi")
    rows = kept(scene_rows(a, d, frames), "scenes")
    # few bytes and much work for each question: a stated number of tasks, whatever the files were cut into
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = asked.select(*KEYS, "program", "gold", "is_choice").repartition(wide, *KEYS)
    built = C.build(spread.join(rows, "scene"), KEYS, frames=frames)
    built.join(asked.drop("program", "gold"), KEYS).write.parquet(f"{out}/outcomes")
    done = spark.read.parquet(f"{out}/outcomes")
    done.where("status = 'ok'").select(record().alias("value")).write.text(f"{out}/chains")
    return C.status_counts(done)
