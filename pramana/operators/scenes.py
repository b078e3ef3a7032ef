"""Scene event logs: visibility changes, collisions, causes, and the modules that question programs are made of.

All tables are keyed by scene and every operator works on all scenes at once. Events are
(scene, type, frame, objects: ARRAY<INT>, ord); a program is a composition of these functions, and a
scene for which a step has no result is missing from it. ``one`` of a set and what follows can fail; such
scenes are told by ``missing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAST = 127


def changes(visible: DataFrame, last: int = LAST) -> DataFrame:
    """Entries and exits: a visible frame after one that is not, and the frame after the last visible one."""
    w = Window.partitionBy("scene", "obj").orderBy("frame")
    v = visible.select("scene", "obj", "frame", F.lag("frame").over(w).alias("p"), F.lead("frame").over(w).alias("n"))
    came = v.where("frame > 0 and (p is null or p < frame - 1)").select("scene", F.lit("in").alias("type"), "frame", F.array("obj").alias("objects"))
    left = v.where(f"frame < {last} and (n is null or n > frame + 1)").select("scene", F.lit("out").alias("type"), (F.col("frame") + 1).alias("frame"), F.array("obj").alias("objects"))
    return came.union(left)


def retimed_collisions(pairs: DataFrame, visible: DataFrame) -> DataFrame:
    """Collisions (scene, a, b, frame) moved to the first frame from theirs on at which both are visible; dropped if neither is visible at theirs."""
    at = visible.select("scene", "obj", "frame")
    seen = pairs.join(at.select("scene", F.col("obj").alias("a"), "frame", F.lit(1).alias("va")), ["scene", "a", "frame"], "left").join(at.select("scene", F.col("obj").alias("b"), "frame", F.lit(1).alias("vb")), ["scene", "b", "frame"], "left").where("va is not null or vb is not null")
    both = at.alias("x").join(at.alias("y"), ["scene", "frame"]).where("x.obj < y.obj").select("scene", "frame", F.col("x.obj").alias("lo"), F.col("y.obj").alias("hi"))
    found = seen.select("scene", "a", "b", "frame", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).alias("s").join(both.withColumnRenamed("frame", "g"), ["scene", "lo", "hi"]).where("g >= s.frame")
    return found.groupBy("scene", "a", "b", "frame").agg(F.min("g").alias("moved"))


def events(visible: DataFrame, collisions: DataFrame, last: int = LAST) -> DataFrame:
    """All events of each scene in order: start, end, changes, collisions; of one frame in that order."""
    scenes = visible.select("scene").distinct()
    none = F.array().cast("array<int>")
    ends = scenes.select("scene", F.explode(F.array(F.struct(F.lit("start").alias("type"), F.lit(0).alias("frame")), F.struct(F.lit("end").alias("type"), F.lit(last).alias("frame")))).alias("e")).select("scene", "e.type", "e.frame", none.alias("objects"))
    hits = collisions.select("scene", F.lit("collision").alias("type"), F.col("moved").alias("frame"), F.array("a", "b").alias("objects"))
    kind = F.when(F.col("type").isin("start", "end"), 0).when(F.col("type").isin("in", "out"), 1).otherwise(2)
    every = ends.unionByName(changes(visible, last)).unionByName(hits).where(f"frame <= {last}")
    w = Window.partitionBy("scene").orderBy("frame", kind, "objects", "type")
    return every.withColumn("ord", F.row_number().over(w))


def led_to(objects: Column):
    """Start and step of a fold over the events before one of these objects, the last first: ``out`` has the places of those that led to it."""
    start = F.struct(objects.alias("open"), F.array().cast("array<int>").alias("out"))

    def back(a, e):
        is_cause = F.arrays_overlap(e["objects"], a["open"])
        return F.struct(F.when(is_cause, F.array_union(a["open"], e["objects"])).otherwise(a["open"]).alias("open"), F.when(is_cause, F.array_append(a["out"], e["ord"])).otherwise(a["out"]).alias("out"))

    return start, back


def ancestors(evs: DataFrame, targets: DataFrame) -> DataFrame:
    """(scene, ord, cause): events that led to each target, over any number of steps.

    What comes before an event in the trace of one of its objects led to it, and what led to that. Going
    back in time from the target, an event is a cause exactly if it has an object that the target or a later cause
    has, so one pass over a scene's log (a bounded list of events) finds all, without a join for each step.
    """
    log = evs.where("size(objects) > 0").groupBy("scene").agg(F.reverse(F.array_sort(F.collect_list(F.struct("ord", "objects")))).alias("log"))
    before = F.filter("log", lambda e: e["ord"] < F.col("ord"))
    return targets.join(log, "scene").select("scene", "ord", F.explode(F.aggregate(before, *led_to(F.col("objects")), lambda a: a["out"])).alias("cause"))


# ---- modules: sets of objects are (scene, obj), sets of events (scene, type, frame, objects, ord)


def filter_attr(objs: DataFrame, **attrs: str) -> DataFrame:
    for k, v in attrs.items():
        objs = objs.where(F.col(k) == v)
    return objs


def filter_motion(objs: DataFrame, frames: DataFrame, moving: bool, frame: DataFrame | None = None, threshold: float = 0.02) -> DataFrame:
    """Objects that are visible and moving (or not) at a frame of their scene, or at any. frames: (scene, obj, frame, speed) while visible."""
    f = frames if frame is None else frames.join(frame.select("scene", F.col("frame").alias("_at")), "scene").where("frame = _at")
    state = f.groupBy("scene", "obj").agg(F.max(F.col("speed") > threshold).alias("_m"))
    return objs.join(state, ["scene", "obj"]).where(F.col("_m") == moving).drop("_m")


def filter_event(evs: DataFrame, kind: str, objs: DataFrame) -> DataFrame:
    """Events of a kind (in, out, collision) in which any of the objects takes part."""
    members = objs.groupBy("scene").agg(F.collect_set("obj").alias("_ids"))
    return evs.where(F.col("type") == kind).join(members, "scene").where(F.arrays_overlap("objects", "_ids")).drop("_ids")


def filter_order(evs: DataFrame, which: str) -> DataFrame:
    """The first, second or last event of each scene."""
    w = Window.partitionBy("scene").orderBy("frame", "ord")
    place = {"first": F.row_number().over(w) == 1, "second": F.row_number().over(w) == 2, "last": F.lead("ord").over(w).isNull()}[which]
    return evs.withColumn("_p", place).where("_p").drop("_p")


def filter_before(evs: DataFrame, event: DataFrame) -> DataFrame:
    return evs.join(event.select("scene", F.col("frame").alias("_f")), "scene").where("frame < _f").drop("_f")


def filter_after(evs: DataFrame, event: DataFrame) -> DataFrame:
    return evs.join(event.select("scene", F.col("frame").alias("_f")), "scene").where("frame > _f").drop("_f")


def filter_ancestor(evs: DataFrame, event: DataFrame, log: DataFrame) -> DataFrame:
    """Those of ``evs`` that led to an event, by the whole log."""
    led = ancestors(log, event.select("scene", "ord", "objects")).select("scene", F.col("cause").alias("ord"))
    return evs.join(led, ["scene", "ord"], "left_semi")


def all_events(objs: DataFrame) -> DataFrame:
    """Every pair of objects as a possible collision, at no frame."""
    return objs.alias("x").join(objs.alias("y"), "scene").where("x.obj < y.obj").select("scene", F.lit("collision").alias("type"), F.lit(-1).alias("frame"), F.array("x.obj", "y.obj").alias("objects"), F.lit(0).alias("ord"))


def unique(items: DataFrame) -> DataFrame:
    """The element of scenes whose set has exactly one."""
    one = items.groupBy("scene").agg(F.count("*").alias("_n")).where("_n = 1").select("scene")
    return items.join(one, "scene", "left_semi")


def count(items: DataFrame, scenes: DataFrame) -> DataFrame:
    n = items.groupBy("scene").agg(F.count("*").alias("answer"))
    return scenes.join(n, "scene", "left").select("scene", F.coalesce("answer", F.lit(0)).alias("answer"))


def exist(items: DataFrame, scenes: DataFrame) -> DataFrame:
    return count(items, scenes).select("scene", F.when(F.col("answer") > 0, "yes").otherwise("no").alias("answer"))


def negate(answers: DataFrame) -> DataFrame:
    """Yes for no and no for yes; what is unknown or an error stays so."""
    return answers.withColumn("answer", F.when(F.col("answer") == "yes", "no").when(F.col("answer") == "no", "yes").otherwise(F.col("answer")))


def belong_to(entry: DataFrame, evs: DataFrame) -> DataFrame:
    """Whether an event (by type and set of objects) or object of a scene is among its events."""
    inside = evs.where(~F.col("type").isin("start", "end"))
    if "objects" in entry.columns:
        key = lambda d: d.select("scene", "type", F.array_sort("objects").alias("s"))
        hit = key(entry).join(key(inside), ["scene", "type", "s"], "left_semi")
    else:
        hit = entry.join(inside.select("scene", F.explode("objects").alias("obj")), ["scene", "obj"], "left_semi")
    return exist(hit, entry.select("scene").distinct())


def query_attr(objs: DataFrame, attr: str) -> DataFrame:
    return objs.select("scene", F.col(attr).alias("answer"))


def get_frame(event: DataFrame) -> DataFrame:
    return event.select("scene", "frame")


def get_object(event: DataFrame, objs: DataFrame) -> DataFrame:
    """The object of an entry or exit."""
    return event.where(F.col("type").isin("in", "out")).select("scene", F.get("objects", 0).alias("obj")).join(objs, ["scene", "obj"])


def get_col_partner(event: DataFrame, obj: DataFrame, objs: DataFrame) -> DataFrame:
    """The other object of a collision."""
    other = event.where("type = 'collision'").join(obj.select("scene", F.col("obj").alias("_o")), "scene").where(F.array_contains("objects", F.col("_o")))
    return other.select("scene", F.get(F.array_remove("objects", F.col("_o")), 0).alias("obj")).join(objs, ["scene", "obj"])


def unknown(scenes: DataFrame) -> DataFrame:
    """What cannot be told from the log: events after its end, or without an object."""
    return scenes.select("scene", F.lit("unknown").alias("answer"))


def missing(scenes: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers with ``error`` for scenes in which a step had no result."""
    return scenes.select("scene").join(answers, "scene", "left").select("scene", F.coalesce(F.col("answer").cast("string"), F.lit("error")).alias("answer"))


def causes_chain(event: DataFrame, evs: DataFrame) -> DataFrame:
    """An event with what led to it, as ordered chain steps: (scene, steps)."""
    led = filter_ancestor(evs, event, evs).unionByName(event.select(evs.columns))
    step = F.struct("frame", "ord", "type", "objects")
    return led.groupBy("scene").agg(F.array_sort(F.collect_list(step)).alias("steps"))
