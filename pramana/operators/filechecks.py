"""Checks of tables against each other: keys without a partner, keys that come twice, values out of place.

A check is a row (check, n, bad, status, samples): how many rows or keys it looked at, how many break it, PASS or else the
level it was given, and the first few that break it as text, in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = 5


def _check(name: str, level: str, n: DataFrame, bad: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """n, bad: one row for each thing looked at and each that breaks the check; bad has a column ``what``."""
    none = F.lit(None).cast("string")
    long = lambda v: F.lit(v).cast("long")
    total = n.agg(F.count("*").alias("n"))
    rows = total.select("n", long(0).alias("bad"), none.alias("what"))
    rows = rows.unionByName(bad.agg(F.count("*").alias("bad")).select(long(0).alias("n"), "bad", none.alias("what")))
    # the first few: an ordered limit keeps so many in each task
    rows = rows.unionByName(bad.select(F.col("what").cast("string")).orderBy("what").limit(samples).select(long(0).alias("n"), long(0).alias("bad"), "what"))
    one = rows.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.array_sort(F.collect_list("what")).alias("samples"))
    return one.select(F.lit(name).alias("check"), "n", "bad", F.when(F.col("bad") == 0, "PASS").otherwise(level).alias("status"), "samples")


def _text(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def has_partner(name: str, left: DataFrame, right: DataFrame, keys: list[str], level: str = "FAIL") -> DataFrame:
    """Every distinct key of ``left`` is in ``right``; a null in a key is a key without partner."""
    mine = left.select(*keys).distinct()
    bad = mine.join(right.select(*keys).distinct(), keys, "left_anti")
    return _check(name, level, mine, bad.select(_text(keys).alias("what")))


def is_unique(name: str, df: DataFrame, keys: list[str], level: str = "FAIL") -> DataFrame:
    """No key comes twice; counted are keys."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return _check(name, level, counts, counts.where("_n > 1").select(_text(keys).alias("what")))


def holds(name: str, df: DataFrame, rule: Column, what: Column, level: str = "FAIL") -> DataFrame:
    """``rule`` is true of every row; null counts as broken."""
    return _check(name, level, df, df.where(~F.coalesce(rule, F.lit(False))).select(what.cast("string").alias("what")))


def is_there(name: str, df: DataFrame, level: str = "FAIL") -> DataFrame:
    """There is at least one row."""
    n = df.agg(F.count("*").alias("n"))
    return n.select(F.lit(name).alias("check"), "n", (F.col("n") == 0).cast("long").alias("bad"), F.when(F.col("n") > 0, "PASS").otherwise(level).alias("status"), F.array().cast("array<string>").alias("samples"))


def takes_all(name: str, df: DataFrame, column: str, values: list, level: str = "WARN") -> DataFrame:
    """Each of ``values`` occurs; counted are the values."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` {dict(df.dtypes)[column]}")
    return has_partner(name, wanted, df, [column], level)


def same_counts(name: str, a: DataFrame, b: DataFrame, keys: list[str], n: str, level: str = "WARN") -> DataFrame:
    """Where both have a key, their ``n`` is the same."""
    both = a.select(*keys, F.col(n).alias("_a")).join(b.select(*keys, F.col(n).alias("_b")), keys)
    return holds(name, both, F.col("_a") == F.col("_b"), F.concat(_text(keys), F.lit(": "), F.col("_a").cast("string"), F.lit(" and "), F.col("_b").cast("string")), level)


def report(checks: list[DataFrame]) -> DataFrame:
    """All checks in one table."""
    return reduce(DataFrame.unionByName, checks)


QUESTION_TYPES = ["descriptive", "explanatory", "predictive", "counterfactual"]


def scene_file_checks(questions: DataFrame, annotations: DataFrame, proposals: DataFrame) -> DataFrame:
    """What must hold between question, annotation and detection files before chains are made of them.

    questions: (scene, qid, question_type, program array, choices array of structs with answer and program). annotations: (scene,
    object_property, motion_trajectory, collision) as files hold them, locations too. proposals: (scene, frame, color, material,
    shape, box) with a row for each detection and a null box where the mask has none. Masks are boxes here; no pixels are read.
    """
    attributes = [F.col(f"o.{c}").isNotNull() for c in ("color", "material", "shape")]
    three = reduce(lambda a, b: a & b, attributes)
    things = annotations.select("scene", F.explode_outer("object_property").alias("o"))
    frames = annotations.select("scene", F.explode_outer("motion_trajectory").alias("f"))
    placed = frames.select("scene", F.explode("f.objects").alias("o"))
    hits = annotations.select("scene", F.explode("collision").alias("c"))
    chosen = questions.where("choices is not null and size(choices) > 0")
    programmed = F.col("program").isNotNull() & (F.size("program") > 0)
    each_choice = F.forall("choices", lambda c: c["program"].isNotNull())
    asked = F.concat_ws("/", F.col("scene").cast("string"), F.col("qid").cast("string"))
    seen = proposals.where("box is not null")
    lengths = annotations.select("scene", F.size("motion_trajectory").cast("long").alias("n"))
    detected = proposals.groupBy("scene").agg(F.count_distinct("frame").alias("n"))
    scene = F.col("scene").cast("string")
    return report(
        [
            is_there("questions are there", questions),
            is_unique("a question is there once", questions, ["scene", "qid"]),
            takes_all("every type of question occurs", questions, "question_type", QUESTION_TYPES),
            holds("every question has a program", questions, programmed, asked),
            holds("every choice has a program", chosen, each_choice, asked),
            holds("every choice is right or wrong", chosen, F.forall("choices", lambda c: c["answer"].isin("correct", "wrong")), asked),
            holds("descriptive questions have an answer", questions.where("question_type = 'descriptive'"), F.col("answer").isNotNull(), asked),
            is_there("annotations are there", annotations),
            is_unique("an annotation is there once", annotations, ["scene"]),
            holds("objects have colour, material and shape", things, three, scene),
            holds("collisions have a frame", hits, F.col("c.frame_id").isNotNull(), scene),
            is_there("there are collisions", hits),
            holds("places are of two dimensions", placed, F.size("o.location") == 2, scene, "WARN"),
            holds("it is said what is in view", placed, F.col("o.inside_camera_view").isNotNull(), scene, "WARN"),
            is_there("detections are there", proposals),
            holds("detections have a box", proposals, F.col("box").isNotNull(), scene, "WARN"),
            holds("detections have colour, material and shape", proposals, F.col("color").isNotNull() & F.col("material").isNotNull() & F.col("shape").isNotNull(), scene, "WARN"),
            same_counts("detections have as many frames as the annotation", lengths, detected, ["scene"], "n"),
            has_partner("questions have an annotation", questions, annotations, ["scene"]),
            has_partner("annotations have questions", annotations, questions, ["scene"], "WARN"),
            has_partner("annotations have detections", annotations, seen, ["scene"]),
            has_partner("detections have an annotation", proposals, annotations, ["scene"], "WARN"),
        ]
    )


def verdict(checks: DataFrame) -> DataFrame:
    """(status, checks): FAIL if any check fails, else WARN if any warns, else PASS, and how many checks there were."""
    worst = F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").when(F.bool_or(F.col("status") == "WARN"), "WARN").otherwise("PASS")
    return checks.agg(worst.alias("status"), F.count("*").alias("checks"))
