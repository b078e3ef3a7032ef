"""Grounded chains from question programs: what a program finds on its way becomes steps with evidence.

Steps that find an object or event (resolve), look at a possible collision (observe) or list a set that is counted or led to
something (enumerate) are landmarks; each gets a question, an answer, a span with a box, and links to the nearest landmarks that
its program took it from. A question with its scene is one row until its landmarks are; one shuffle by question puts the chain together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pramana.functions import geometry as G
from pramana.operators import programs as P

FRAMES = 128
#: The plural heads of event sets with their singulars, and the words of order.
SINGULAR = {
    "collisions": "collision",
    "possible collisions": "possible collision",
    "entries into the scene": "entry into the scene",
    "exits from the scene": "exit from the scene",
}
ORDERS = ["first", "second", "last"]
#: Every how many frames a large view of an object and a common view of several are looked for.
LARGE, COMMON = 3, 4


def best_detections(found: DataFrame) -> DataFrame:
    """One box for each (scene, frame, color, material, shape): the highest score, of equal ones the first by ``ord``; rows without a box count for nothing."""
    best = F.min_by("box", F.struct(-F.coalesce("score", F.lit(0.0)), F.col("ord")))
    return found.where("box is not null").groupBy("scene", "frame", "color", "material", "shape").agg(best.alias("box"))


def with_detections(scenes: DataFrame, objs: DataFrame, best: DataFrame) -> DataFrame:
    """Adds d, the boxes (obj, frame, box) of a scene's objects; a detection belongs to the object with its three attributes."""
    mine = best.join(objs.select("scene", "obj", "color", "material", "shape"), ["scene", "color", "material", "shape"])
    d = mine.groupBy("scene").agg(F.collect_list(F.struct("obj", F.col("frame").cast("int").alias("frame"), "box")).alias("d"))
    return scenes.join(d, "scene", "left")


def _near(d: Column, x: Column, frame: Column, tol: int) -> Column:
    """The box of an object at the nearest frame within ``tol``, the earlier of two."""
    hit = F.filter(d, lambda r: (r["obj"] == x) & (F.abs(r["frame"] - frame) <= tol))
    return F.array_min(F.transform(hit, lambda r: F.struct(F.abs(r["frame"] - frame).alias("far"), r["frame"].alias("frame"), r["box"].alias("box"))))["box"]


def _union(boxes: Column) -> Column:
    side = lambda pick, n: pick(F.transform(boxes, lambda b: b[n])).alias(n)
    return F.struct(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))


def _evidence(d: Column, xs: Column, frame: Column, t0: Column, t1: Column, last: int, tol: int) -> Column:
    """Span and union of the objects' boxes near a frame; null if any of them is not detected there."""
    boxes = F.transform(xs, lambda x: _near(d, x, frame, tol))
    from_ = F.greatest(F.lit(0), F.least(t0, F.lit(last)))
    to = F.greatest(from_, F.least(t1, F.lit(last)))
    return F.when(F.forall(boxes, lambda b: b.isNotNull()), F.struct(from_.cast("int").alias("t0"), to.cast("int").alias("t1"), _union(boxes).alias("box")))


def _largest(d: Column, x: Column, wanted) -> Column:
    """The frame of an object's largest box among wanted frames, the first of equal ones; null without any."""
    hit = F.filter(d, lambda r: (r["obj"] == x) & wanted(r["frame"]))
    return -F.array_max(F.transform(hit, lambda r: F.struct(G.area(r["box"]).alias("size"), (-r["frame"]).alias("back"))))["back"]


def _seen(m: Column, x: Column) -> Column:
    return F.transform(F.filter(m, lambda r: r["obj"] == x), lambda r: r["frame"])


def large_view(d: Column, m: Column, x: Column, frames: int) -> Column:
    """Among every third frame at which an object is visible that of its largest box, else the first of them, else 0."""
    seen = F.filter(_seen(m, x), lambda f: (f % LARGE == 0) & (f < frames))
    return F.coalesce(_largest(d, x, lambda f: F.array_contains(seen, f)), F.array_min(seen), F.lit(0))


def common_view(d: Column, m: Column, xs: Column, frames: int) -> Column:
    """Among every fourth frame the first at which most of some objects are visible and detected."""
    each = F.flatten(F.transform(xs, lambda x: F.array_intersect(_seen(m, x), F.transform(F.filter(d, lambda r: r["obj"] == x), lambda r: r["frame"]))))
    counted = F.transform(F.sequence(F.lit(0), F.lit(frames - 1), F.lit(COMMON)), lambda f: F.struct(F.size(F.filter(each, lambda g: g == f)).alias("n"), (-f).alias("back")))
    return -F.array_max(counted)["back"]


def event_evidence(d: Column, e: Column, frames: int, tol: int) -> Column:
    """Two frames to both sides of a collision, five from an entry on, five before an exit; the start and end have none."""
    f, last, x = e["frame"], frames - 1, F.get(e["objects"], 0)
    t0 = F.when(e["type"] == "in", f).when(e["type"] == "out", F.greatest(f - 5, F.lit(0))).otherwise(F.greatest(f - 2, F.lit(0)))
    t1 = F.when(e["type"] == "in", F.least(f + 4, F.lit(last))).when(e["type"] == "out", F.greatest(f - 1, F.lit(0))).otherwise(F.least(f + 2, F.lit(last)))
    at = F.when(e["type"] == "collision", f).otherwise(F.coalesce(_largest(d, x, lambda g: g.between(t0, t1)), t0))
    return F.when(e["type"].isin("collision", "in", "out"), _evidence(d, e["objects"], at, t0, t1, last, tol))


def event_phrase(quals: Column, singular: bool) -> Column:
    """A set of events by its qualifiers, as in "first collision involving the red cube"."""
    parts = F.filter(quals, lambda q: q != "events")
    order = F.when(F.get(parts, 0).isin(*ORDERS), F.get(parts, 0))
    rest = F.when(order.isNotNull(), F.slice(parts, 2, F.size(parts))).otherwise(parts)
    head = F.coalesce(F.get(rest, 0), F.lit("event"))
    if singular:
        one = head
        for many, single in SINGULAR.items():
            one = F.when(F.startswith(head, F.lit(many)), F.concat(F.lit(single), F.substring(head, len(many) + 1, 1 << 20))).otherwise(one)
        head = one
    return F.concat_ws(" ", order, head, F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))))


def _roles(made: Column) -> Column:
    """The role of each place of a trace, null where it is no landmark."""
    used = F.transform(F.filter(made, lambda x: x["op"].isin("count", "exist")), lambda x: x["a"])

    def role(x, i):
        found = x["op"].isin("unique", "filter_order", "get_col_partner", "get_object") & x["v"]["kind"].isin("object", "event")
        possible = (x["v"]["kind"] == "event") & (F.get(x["v"]["evs"], 0)["frame"] < 0)
        listed = F.array_contains(used, i) & x["v"]["kind"].isin("objects", "events")
        led = (x["op"] == "filter_ancestor") & (x["v"]["kind"] == "events")
        return F.when(found & possible, "observe").when(found, "resolve").when(listed | led, "enumerate")

    return F.transform(made, role)


def _sources(made: Column, roles: Column) -> Column:
    """The nearest landmarks that each place of a trace was made from; what a module takes stands before it."""
    none = F.array().cast("array<int>")
    through = lambda acc, i: F.when(i.isNull(), none).when(F.get(roles, i).isNotNull(), F.array(i)).otherwise(F.get(acc, i))
    return F.aggregate(made, F.array().cast("array<array<int>>"), lambda acc, x: F.array_append(acc, F.array_union(through(acc, x["a"]), through(acc, x["b"]))))


def _motion_frame(made: Column, x: Column) -> Column:
    """The frame that a set of objects was filtered by motion at, null for any other set."""
    at = F.get(made, x["b"])["v"]
    return F.when(x["op"].isin("filter_moving", "filter_stationary") & (at["kind"] != "null"), at["text"].cast("int"))


def landmarks(traced: DataFrame, keep: list[str], tol: int = 3, frames: int = FRAMES) -> DataFrame:
    """(keep, pos, role, key, question, answer, evidence, sources) of each landmark of a trace; one row without a position for a trace that has none.

    Two landmarks with the same key tell the same. A box is looked for within ``tol`` frames, then within ten.
    """
    tol, last = max(tol, 10), frames - 1  # the nearest within ten is the nearest within tol, if there is one
    o, e, m = (F.col(c) for c in "oem")
    d = F.coalesce("d", F.array().cast(traced.schema["d"].dataType))
    marked = traced.withColumn("_roles", _roles(F.col("made")))
    marked = marked.withColumn("_from", _sources(F.col("made"), F.col("_roles")))
    at = F.transform("made", lambda x, i: F.struct(i.alias("pos"), F.get(F.col("_roles"), i).alias("role"), F.get(F.col("_from"), i).alias("sources"), x.alias("x")))
    rows = marked.withColumn("_l", F.explode_outer(F.filter(at, lambda r: r["role"].isNotNull())))
    made, x, role = F.col("made"), F.col("_l.x"), F.col("_l.role")
    v, op = x["v"], x["op"]
    first, second = F.get(made, x["a"]), F.get(made, x["b"])
    obj, ev, took = F.get(v["objs"], 0), F.get(v["evs"], 0), F.get(first["v"]["evs"], 0)
    txt = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    frame = lambda c: c["frame"].cast("string")
    case = lambda pairs: F.coalesce(*[F.when(c, w) for c, w in pairs])

    one, event = (role == "resolve") & (v["kind"] == "object"), (role == "resolve") & (v["kind"] == "event")
    watch, objs, evs = role == "observe", (role == "enumerate") & (v["kind"] == "objects"), (role == "enumerate") & (v["kind"] == "events")
    real = F.get(F.filter(e, lambda c: (c["type"] == "collision") & (F.array_sort(c["objects"]) == F.array_sort(ev["objects"]))), 0)
    listed = F.filter(v["evs"], lambda c: ~c["type"].isin("start", "end"))
    partly = F.concat_ws(" that is ", F.concat_ws(" ", F.lit("the"), first["color"], first["material"], F.coalesce(first["shape"], F.lit("object"))), F.get(first["quals"], 0))
    phrase = event_phrase(F.when(op == "unique", first["quals"]).otherwise(x["quals"]), True)
    # objects and events by name: those of the answer, but for a question about two objects
    rows = rows.withColumn("_names", F.transform(F.when(watch, ev["objects"]).when(op == "get_col_partner", F.concat(second["v"]["objs"], v["objs"])).otherwise(v["objs"]), lambda i: P.describe(o, i)))
    rows = rows.withColumn("_told", F.transform(F.when(event, v["evs"]).otherwise(listed), lambda c: P.describe_event(o, c)))
    name = lambda i: F.get("_names", i)
    # How the format words questions and answers, from here to the answers' end.
    question = case([
        (one & (op == "unique"), txt("Which object is ", partly, "?")),
        (one & (op == "get_col_partner"), txt("Which object does ", name(0), " collide with at frame ", frame(took), "?")),
        (one, txt("Which object ", F.when(took["type"] == "in", "enters").otherwise("exits"), " the scene at frame ", frame(took), "?")),
        (event, F.when(F.substring_index(phrase, " ", 1).isin(*ORDERS), txt("What is the ", phrase, "?")).otherwise(txt("Which ", phrase, " happens in the video?"))),
        (watch, txt("Do ", name(0), " and ", name(1), " collide during the video?")),
        (objs, txt("Which ", P.plural(x), " are ", F.coalesce(F.get(x["quals"], 0), F.lit("there")), "?")),
        (evs, txt("Which ", event_phrase(x["quals"], False), " are there?")),
    ])
    all_or_none = lambda names, sep: F.when(F.size(names) > 0, F.array_join(names, sep)).otherwise("none")
    answer = case([
        (one, F.try_element_at("_names", F.lit(-1))),
        (event, F.get("_told", 0)),
        (watch, F.when(real.isNotNull(), txt("yes, at frame ", frame(real))).otherwise("no")),
        (objs, all_or_none("_names", ", ")),
        (evs, all_or_none("_told", "; ")),
    ])
    found_at = F.when(op == "unique", _motion_frame(made, first)).when(op == "get_col_partner", took["frame"]).otherwise(F.when(took["type"] == "in", took["frame"]).otherwise(took["frame"] - 1))
    one_at = F.coalesce(found_at, large_view(d, m, obj, frames))
    pair_at = F.coalesce(F.array_max(F.filter(F.array_intersect(_seen(m, F.get(ev["objects"], 0)), _seen(m, F.get(ev["objects"], 1))), lambda f: f < frames)), F.lit(last))
    many_at = F.coalesce(_motion_frame(made, x), common_view(d, m, v["objs"], frames))
    around = F.when(objs & (F.size(x["quals"]) > 0), 3).otherwise(0)
    # frames, once for each row: evidence names them many times
    rows = rows.withColumn("_at", case([(one, one_at), (watch, pair_at), (objs, many_at)]))
    at_ = F.col("_at")
    told = F.when(event, v["evs"]).when(evs, listed).when(watch & real.isNotNull(), F.array(P.plain_event(real)))
    rows = rows.withColumn("_shown", F.transform(told, lambda c: event_evidence(d, c, frames, tol)))
    shown = F.col("_shown")
    over = F.struct(F.array_min(F.transform(shown, lambda s: s["t0"])).alias("t0"), F.array_max(F.transform(shown, lambda s: s["t1"])).alias("t1"), _union(F.transform(shown, lambda s: s["box"])).alias("box"))
    whole = F.struct(F.lit(0).alias("t0"), F.lit(last).alias("t1"), G.box(*[F.lit(c) for c in (0.0, 0.0, 1.0, 1.0)]).alias("box"))
    evidence = (
        F.when((objs & (F.size(v["objs"]) == 0)) | (evs & (F.size(shown) == 0)), whole)
        .when(shown.isNotNull(), F.when(F.forall(shown, lambda s: s.isNotNull()), over))
        .when(watch, _evidence(d, ev["objects"], at_, at_ - 4, at_, last, tol))
        .otherwise(_evidence(d, v["objs"], at_, at_ - around, at_ + around, last, tol))
    )
    entity = F.when(one, F.concat(F.lit("object "), obj.cast("string"))).when(event, F.concat_ws(" ", F.lit("event"), ev["type"], frame(ev), F.array_join(ev["objects"].cast("array<string>"), ",")))
    key = F.coalesce(entity, F.to_json(F.struct("_q", "_a")))
    out = rows.withColumn("_q", question).withColumn("_a", answer).withColumn("_e", evidence).withColumn("_k", key)
    return out.select(*keep, F.col("_l.pos").alias("pos"), role.alias("role"), F.col("_k").alias("key"), F.col("_q").alias("question"), F.col("_a").alias("answer"), F.col("_e").alias("evidence"), F.col("_l.sources").alias("sources"))


def build(questions: DataFrame, keys: list[str], program: str = "program", gold: str = "gold", choice: str = "is_choice", threshold: float = 0.02, tol: int = 3, frames: int = FRAMES) -> DataFrame:
    """(keys, status, final_answer, executor_answer, triplets) of each question; triplets are null unless the status is ok.

    questions: ``keys`` that tell them apart, o, e, m, d of their scene, the program (of a choice: its own, then the question's), the known
    answer (of a choice: yes or no) and whether it is a choice. Statuses: executor_error, executor_disagrees (a choice
    may be unknown), no_landmarks, no_evidence, ok. The work is by row, not by byte: spread scenes over tasks before they meet their
    questions. A null or empty program is an executor_error; repeated keys are not allowed.
    """
    asked = P.trace(questions.withColumn("_p", F.coalesce(program, F.array().cast("array<string>"))), "_p", threshold)
    end = F.get("made", F.size("made") - 1)
    said, final = F.when(end["v"]["kind"] == "unknown", "unknown").otherwise(end["v"]["text"]), F.col(gold).cast("string")
    wrong = F.when(F.col(choice), said.isin("yes", "no") & (said != final)).otherwise(~said.eqNullSafe(final))
    failed = F.when(end.isNull() | (end["v"]["kind"] == "error"), "executor_error").when(F.coalesce(wrong, F.lit(False)), "executor_disagrees")
    asked = asked.withColumn("_failed", failed).withColumn("_final", final).withColumn("_said", said)
    asked = asked.withColumn("made", F.when(F.col("_failed").isNull(), F.col("made")))  # nothing to tell of the others
    marks = landmarks(asked, [*keys, "_failed", "_final", "_said"], tol, frames)
    step = F.struct("pos", "role", "key", "question", "answer", "evidence", "sources")
    got = marks.groupBy(*keys).agg(F.first("_failed").alias("_failed"), F.first("_final").alias("final_answer"), F.first("_said").alias("executor_answer"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), step))).alias("_t"))
    got = got.withColumn("_keys", F.array_distinct(F.transform("_t", lambda t: t["key"])))
    place = lambda k: (F.array_position(F.col("_keys"), k) - 1).cast("int")
    where = F.map_from_entries(F.transform("_t", lambda t: F.struct(t["pos"], place(t["key"]))))
    got = got.withColumn("_place", where)

    def triplet(k):
        t = F.get(F.filter("_t", lambda r: r["key"] == k), 0)
        deps = F.array_sort(F.array_distinct(F.transform(t["sources"], lambda p: F.try_element_at(F.col("_place"), p))))
        return F.struct(t["question"].alias("question"), t["answer"].alias("answer"), t["evidence"].alias("evidence"), deps.alias("depends_on"), t["role"].alias("role"))

    status = F.coalesce("_failed", F.when(F.size("_t") == 0, "no_landmarks").when(F.exists("_t", lambda t: t["evidence"].isNull()), "no_evidence"), F.lit("ok"))
    return got.select(*keys, status.alias("status"), "final_answer", "executor_answer", F.when(status == "ok", F.transform("_keys", triplet)).alias("triplets"))


def status_counts(chains: DataFrame, kind: str = "question_type") -> DataFrame:
    """(kind, status, n_triplets, n): how many chains of each kind have a status and a length; the length is null without a chain."""
    return chains.groupBy(F.col(kind).alias("kind"), "status", F.when(F.col("status") == "ok", F.size("triplets")).alias("n_triplets")).agg(F.count("*").alias("n"))
