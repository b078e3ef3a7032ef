"""Question programs over scene logs: one fold over a program's tokens, for all questions and scenes at once.

A scene is one row with its objects, its ordered events and the frames of each object; a program is an array of tokens. Literals
are put on a stack, a module takes its arguments from it and puts its value there. A module without enough arguments, or with
one of a kind that it does not take, is an error and ends the program; what the log cannot tell is unknown and
passes through the modules that allow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pramana.functions import geometry as G
from pramana.functions.text import COLORS, MATERIALS, SHAPES
from pramana.operators import scenes as S

ONE = ["unique", "count", "exist", "negate", "query_color", "query_material", "query_shape", "get_frame", "get_object"]
TWO = ["belong_to", "filter_color", "filter_material", "filter_shape", "filter_moving", "filter_stationary", "filter_in", "filter_out", "filter_collision", "filter_order", "filter_before", "filter_after", "filter_ancestor", "get_col_partner", "get_counterfact"]
NONE = ["objects", "events", "all_events", "unseen_events"]
_EVENT = "struct<ord:int,type:string,frame:int,objects:array<int>>"
_TYPES = {"kind": "string", "objs": "array<int>", "evs": f"array<{_EVENT}>", "text": "string"}


def scene_rows(objs: DataFrame, frames: DataFrame, log: DataFrame) -> DataFrame:
    """(scene, o, e, m) of each scene: objects (obj, color, material, shape), events (ord, type, frame, objects), and the visible frames (obj, frame, speed).

    Each list has what one clip holds: a handful of objects and events, frames up to its length.
    """
    e = log.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("ord", "type", "frame", "objects"))).alias("e"))
    o = objs.groupBy("scene").agg(F.array_sort(F.collect_list(F.struct("obj", "color", "material", "shape"))).alias("o"))
    m = frames.groupBy("scene").agg(F.collect_list(F.struct("obj", "frame", "speed")).alias("m"))
    return o.join(e, "scene", "left").join(m, "scene", "left")


def _value(kind: str, **parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), *[parts.get(n, F.lit(None)).cast(t).alias(n) for n, t in list(_TYPES.items())[1:]])


def plain_event(event: Column) -> Column:
    return F.struct(*[event[n].alias(n) for n in ("ord", "type", "frame", "objects")])


def _literal(tok: Column) -> Column:
    end = lambda name, frame: _value("event", evs=F.array(F.struct(F.lit(None).cast("int").alias("ord"), F.lit(name).alias("type"), F.lit(frame).alias("frame"), F.array().cast("array<int>").alias("objects"))))
    attr = tok.isin(*COLORS, *MATERIALS, *SHAPES)
    return F.when(attr, _value("attr", text=tok)).when(tok.isin("first", "second", "last"), _value("order", text=tok)).when(tok == "null", _value("null")).when(tok == "start", end("start", 0)).when(tok == "end", end("end", S.LAST)).otherwise(_value("str", text=tok))


def _module(tok: Column, a: Column, b: Column, o: Column, e: Column, m: Column, threshold: Column) -> Column:
    """The value of a module. ``a``: its first argument, ``b``: its second."""
    error, unknown = _value("error"), _value("unknown")
    is_ = lambda v, *kinds: F.coalesce(v["kind"].isin(*kinds), F.lit(False))
    yes = lambda c: F.when(c, "yes").otherwise("no")
    event, object_ = F.get(a["evs"], 0), F.get(a["objs"], 0)
    size = F.when(is_(a, "objects"), F.size(a["objs"])).otherwise(F.size(a["evs"]))
    sets = is_(a, "objects", "events")
    ids = F.transform(o, lambda x: x["obj"])
    attr = lambda x, name: F.get(F.filter(o, lambda r: r["obj"] == x), 0)[name]
    inside = F.filter(b["evs"], lambda x: ~x["type"].isin("start", "end"))
    same = lambda x: (x["type"] == event["type"]) & (F.array_sort(x["objects"]) == F.array_sort(event["objects"]))
    moving = lambda r: r["speed"] > threshold
    want = tok == "filter_moving"

    def in_motion(x):
        mine = F.filter(m, lambda r: r["obj"] == x)
        at = F.filter(mine, lambda r: r["frame"] == b["text"].cast("int"))
        ever = (F.size(mine) > 0) & (F.exists(mine, moving) == want)
        return F.when(is_(b, "null"), ever).otherwise(F.exists(at, lambda r: moving(r) == want))

    pairs = F.flatten(F.transform(ids, lambda x: F.transform(F.filter(ids, lambda y: y > x), lambda y: F.struct(F.lit(0).alias("ord"), F.lit("collision").alias("type"), F.lit(-1).alias("frame"), F.array(x, y).alias("objects")))))
    place = F.when(b["text"] == "first", 0).when(b["text"] == "second", 1).otherwise(F.size(a["evs"]) - 1)
    nth = F.when(place >= 0, F.get(a["evs"], place))
    other = F.get(b["evs"], 0)
    # made where a program asks for it: the causes of every event of a log are as many as the square of its length
    before = F.reverse(F.filter(e, lambda x: x["ord"] < other["ord"]))
    led = F.aggregate(before, *S.led_to(other["objects"]), lambda acc: acc["out"])
    partner = F.get(F.filter(event["objects"], lambda x: x != F.get(b["objs"], 0)), 0)
    kind_of = F.substring_index(tok, "_", -1)
    involved = F.filter(a["evs"], lambda x: (x["type"] == kind_of) & F.arrays_overlap(x["objects"], b["objs"]))
    said = F.when(tok == "query_color", attr(object_, "color")).when(tok == "query_material", attr(object_, "material")).otherwise(attr(object_, "shape"))
    has = lambda x: F.when(tok == "filter_color", attr(x, "color")).when(tok == "filter_material", attr(x, "material")).otherwise(attr(x, "shape")) == b["text"]
    around = F.filter(a["evs"], lambda x: F.when(tok == "filter_before", x["frame"] < other["frame"]).otherwise(x["frame"] > other["frame"]))
    passing = tok.isin("unique", "count", "exist", "negate", "belong_to", "filter_in", "filter_out", "filter_collision")
    return (
        F.when(tok == "objects", _value("objects", objs=ids))
        .when(tok == "events", _value("events", evs=F.transform(e, plain_event)))
        .when(tok == "all_events", _value("events", evs=pairs))
        .when(tok == "unseen_events", unknown)
        .when(passing & (is_(a, "unknown") | ((tok == "belong_to") & is_(b, "unknown"))), unknown)
        .when(tok == "unique", F.when(~sets | (size != 1), error).when(is_(a, "objects"), _value("object", objs=a["objs"])).otherwise(_value("event", evs=a["evs"])))
        .when(tok == "count", F.when(sets, _value("int", text=size)).otherwise(error))
        .when(tok == "exist", F.when(sets, _value("bool", text=yes(size > 0))).otherwise(error))
        .when(tok == "negate", F.when(is_(a, "bool"), _value("bool", text=yes(a["text"] != "yes"))).otherwise(error))
        .when(tok == "belong_to", F.when(~is_(b, "events"), error).when(is_(a, "event"), _value("bool", text=yes(F.exists(inside, same)))).when(is_(a, "object"), _value("bool", text=yes(F.exists(inside, lambda x: F.array_contains(x["objects"], object_))))).otherwise(error))
        .when(tok.isin("filter_color", "filter_material", "filter_shape"), F.when(is_(a, "objects") & is_(b, "attr"), _value("objects", objs=F.filter(a["objs"], has))).otherwise(error))
        .when(tok.isin("filter_moving", "filter_stationary"), F.when(is_(a, "objects") & is_(b, "int", "null"), _value("objects", objs=F.filter(a["objs"], in_motion))).otherwise(error))
        .when(tok.isin("filter_in", "filter_out", "filter_collision"), F.when(is_(a, "events") & is_(b, "object", "objects"), _value("events", evs=involved)).otherwise(error))
        .when(tok == "filter_order", F.when(is_(a, "events") & is_(b, "order") & nth.isNotNull(), _value("event", evs=F.array(nth))).otherwise(error))
        .when(tok.isin("filter_before", "filter_after"), F.when(is_(a, "events") & is_(b, "event"), _value("events", evs=around)).otherwise(error))
        .when(tok == "filter_ancestor", F.when(is_(a, "events") & is_(b, "event"), _value("events", evs=G.let(led, lambda causes: F.filter(a["evs"], lambda x: F.coalesce(F.array_contains(causes, x["ord"]), F.lit(False)))))).otherwise(error))
        .when(tok.isin("query_color", "query_material", "query_shape"), F.when(is_(a, "object"), _value("str", text=said)).otherwise(error))
        .when(tok == "get_frame", F.when(is_(a, "event"), _value("int", text=event["frame"])).otherwise(error))
        .when(tok == "get_object", F.when(is_(a, "event") & event["type"].isin("in", "out"), _value("object", objs=F.slice(event["objects"], 1, 1))).otherwise(error))
        .when(tok == "get_col_partner", F.when(is_(a, "event") & is_(b, "object") & (event["type"] == "collision") & F.array_contains(event["objects"], F.get(b["objs"], 0)), _value("object", objs=F.array(partner))).otherwise(error))
        .when(tok == "get_counterfact", F.when(is_(a, "events") & is_(b, "object"), unknown).otherwise(error))
    )


def run(questions: DataFrame, program: str = "program", threshold=0.02, out: str = "answer") -> DataFrame:
    """Adds the answer of each question's program. questions: o, e, m of its scene (``scene_rows``) and the program's tokens.

    An object answers by its number, sets by their members joined with commas; an empty program is an error.
    """
    o, e, m = (F.col(c) for c in "oem")
    th = F.lit(threshold) if isinstance(threshold, float) else threshold
    start = F.array().cast(f"array<struct<{','.join(f'{n}:{t}' for n, t in _TYPES.items())}>>")

    def step(stack, tok):
        n = F.size(stack)
        x, y = F.get(stack, n - 1), F.get(stack, n - 2)
        two = tok.isin(*TWO)
        arity = F.when(two, 2).when(tok.isin(*ONE), 1).otherwise(0)
        made = _module(tok, F.when(two, y).otherwise(x), x, o, e, m, th)
        value = F.when(n < arity, _value("error")).when(tok.isin(*NONE, *ONE, *TWO), made).otherwise(_literal(tok))
        failed = F.coalesce(x["kind"] == "error", F.lit(False))
        # an error stays on top of the stack whatever comes after it
        return F.when(failed, stack).otherwise(F.concat(F.slice(stack, 1, F.greatest(n - arity, F.lit(0))), F.array(value)))

    def answer(stack):
        v = F.get(stack, F.size(stack) - 1)
        members = F.coalesce(F.array_join(F.transform(v["objs"], lambda x: x.cast("string")), ","), F.array_join(F.transform(v["evs"], lambda x: x["ord"].cast("string")), ","))
        return F.when(v.isNull() | (v["kind"] == "error"), "error").when(v["kind"] == "unknown", "unknown").otherwise(F.coalesce(v["text"], members))

    return questions.withColumn(out, F.aggregate(F.col(program), start, step, answer))


# The words by which the format names objects, events and sets, in the four functions that follow.


def describe(o: Column, x: Column) -> Column:
    """An object's full name, as in "the red metal cube". o: the scene's objects."""
    row = F.get(F.filter(o, lambda r: r["obj"] == x), 0)
    return F.concat_ws(" ", F.lit("the"), row["color"], row["material"], F.coalesce(row["shape"], F.lit("object")))


def describe_event(o: Column, e: Column, clause: bool = False) -> Column:
    """An event as a noun, or as a clause that can follow "when"."""
    who = [describe(o, F.get(e["objects"], i)) for i in (0, 1)]
    at = F.when(e["frame"] >= 0, F.concat(F.lit(" at frame "), e["frame"].cast("string"))).otherwise("")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    hit = said(who[0], " and ", who[1], " collide", at) if clause else said("the collision between ", who[0], " and ", who[1], at)
    came, left = (" enters", " exits") if clause else (" entering", " exiting")
    begun, over = ("the video begins", "the video ends") if clause else ("the start of the video", "the end of the video")
    t = e["type"]
    return F.when(t == "collision", hit).when(t == "in", said(who[0], came, " the scene", at)).when(t == "out", said(who[0], left, " the scene", at)).when(t == "start", begun).otherwise(over)


def plural(v: Column) -> Column:
    """A set of objects by the attributes that it was filtered by, as in "red spheres"."""
    return F.concat_ws(" ", v["color"], v["material"], F.coalesce(F.concat(v["shape"], F.lit("s")), F.lit("objects")))


def _told(tok: Column, a: Column, b: Column, made: Column, o: Column) -> list[Column]:
    """How a value came about, for wording: attributes that a set of objects was filtered by, and its qualifiers."""
    kept = tok.isin("unique", "count", "exist", "filter_color", "filter_material", "filter_shape", "filter_moving", "filter_stationary")
    attr = lambda n: F.when(tok == f"filter_{n}", b["v"]["text"]).when(kept, a[n]).alias(n)
    any_attr = lambda v: F.coalesce(v["color"], v["material"], v["shape"]).isNotNull()
    none = F.array().cast("array<string>")
    moved = tok.isin("filter_moving", "filter_stationary")
    event = F.get(F.when(moved, F.get(made, b["a"])["v"]["evs"]).otherwise(b["v"]["evs"]), 0)
    clause = describe_event(o, event, True)
    at = F.when(b["v"]["kind"] != "null", F.when(b["op"] == "get_frame", F.concat(F.lit("when "), clause)).otherwise(F.concat(F.lit("at frame "), b["v"]["text"])))
    motion = F.concat_ws(" ", F.substring_index(tok, "_", -1), at)
    partly = F.concat_ws(" ", F.lit("the"), b["color"], b["material"], F.coalesce(b["shape"], F.lit("object")))
    some = F.concat_ws(" ", F.lit("any"), F.get(b["quals"], 0), plural(b))
    who = F.when(b["v"]["kind"] == "object", F.when(any_attr(b), partly).otherwise(describe(o, F.get(b["v"]["objs"], 0)))).when(any_attr(b) | (F.size(b["quals"]) > 0), some)
    noun = F.when(tok == "filter_in", "entries into the scene").when(tok == "filter_out", "exits from the scene").otherwise("collisions")
    head = F.concat_ws(" ", F.when(F.array_contains(a["quals"], "possible collisions"), "possible"), noun)
    rest = F.filter(a["quals"], lambda q: ~q.isin("events", "possible collisions"))
    again = F.coalesce(F.startswith(F.get(rest, 0), F.concat(head, F.lit(" involving "))) & who.isNotNull(), F.lit(False))
    joined = F.transform(rest, lambda q, i: F.when(i == 0, F.concat(q, F.lit(" and "), who)).otherwise(q))
    involving = F.when(again, joined).otherwise(F.concat(F.array(F.concat_ws(" involving ", head, who)), rest))
    around = F.concat(F.substring_index(tok, "_", -1), F.lit(" "), clause)
    quals = (
        F.when(tok == "events", F.array(F.lit("events")))
        .when(tok == "all_events", F.array(F.lit("possible collisions")))
        .when((tok == "unique") & (a["v"]["kind"] == "objects"), none)
        .when(tok.isin("unique", "count", "exist", "get_frame", "get_object", "get_col_partner"), a["quals"])
        .when(moved, F.array(motion))
        .when(tok.isin("filter_in", "filter_out", "filter_collision"), involving)
        .when(tok == "filter_order", F.concat(F.array(b["v"]["text"]), a["quals"]))
        .when(tok.isin("filter_before", "filter_after"), F.concat(a["quals"], F.array(around)))
        .when(tok == "filter_ancestor", F.array(F.concat(F.lit("events that led to "), describe_event(o, event))))
    )
    return [attr(n) for n in ("color", "material", "shape")] + [F.coalesce(quals, none).alias("quals")]


def trace(questions: DataFrame, program: str = "program", threshold=0.02, out: str = "made") -> DataFrame:
    """Adds what each token of a program made: (op, a, b, v, color, material, shape, quals).

    ``a`` and ``b`` are the places of the tokens whose values a module took, null for a literal; ``v`` is its value, the rest how
    it is worded. The list ends at an error; the last element is the program's answer.
    """
    o, e, m = (F.col(c) for c in "oem")
    th = F.lit(threshold) if isinstance(threshold, float) else threshold
    value = f"struct<{','.join(f'{n}:{t}' for n, t in _TYPES.items())}>"
    entry = f"struct<op:string,a:int,b:int,v:{value},color:string,material:string,shape:string,quals:array<string>>"
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast(f"array<{entry}>").alias("made"))

    def step(acc, tok):
        stack, made = acc["stack"], acc["made"]
        n = F.size(stack)
        two, module = tok.isin(*TWO), tok.isin(*NONE, *ONE, *TWO)
        arity = F.when(two, 2).when(tok.isin(*ONE), 1).otherwise(0)
        at = F.when(arity == 2, F.get(stack, n - 2)).when(arity == 1, F.get(stack, n - 1)), F.when(arity == 2, F.get(stack, n - 1))
        a, b = F.get(made, at[0]), F.get(made, at[1])
        v = F.when(n < arity, _value("error")).when(module, _module(tok, a["v"], b["v"], o, e, m, th)).otherwise(_literal(tok))
        new = F.struct(tok.alias("op"), at[0].alias("a"), at[1].alias("b"), v.alias("v"), *_told(tok, a, b, made, o))
        ahead = F.struct(F.array_append(F.slice(stack, 1, F.greatest(n - arity, F.lit(0))), F.size(made)).alias("stack"), F.array_append(made, new).alias("made"))
        return F.when(F.coalesce(F.get(made, F.size(made) - 1)["v"]["kind"] == "error", F.lit(False)), acc).otherwise(ahead)

    return questions.withColumn(out, F.aggregate(F.col(program), start, step, lambda acc: acc["made"]))


def agreement(questions: DataFrame, thresholds: list[float], kind: str = "subtype", gold: str = "gold") -> DataFrame:
    """(threshold, kind, n, n_motion, agree, agree_motion): share of right answers for each motion threshold, over all and for each kind.

    Motion questions are those whose program filters by motion.
    """
    each = questions.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    asked = run(each, threshold=F.col("threshold"))
    motion = F.arrays_overlap("program", F.array(F.lit("filter_moving"), F.lit("filter_stationary")))
    right = (F.col("answer") == F.col(gold).cast("string")).cast("int")
    both = asked.select("threshold", F.explode(F.array(kind, F.lit("ALL"))).alias("kind"), right.alias("right"), motion.alias("motion"))
    return both.groupBy("threshold", "kind").agg(F.count("*").alias("n"), F.count_if("motion").alias("n_motion"), F.avg("right").alias("agree"), F.avg(F.when(F.col("motion"), F.col("right"))).alias("agree_motion"))


def best_threshold(agreed: DataFrame) -> DataFrame:
    """The threshold of the largest agreement over all, the first of equal ones."""
    return agreed.where("kind = 'ALL'").agg(F.max_by("threshold", F.struct("agree", -F.col("threshold"))).alias("threshold"), F.max("agree").alias("agree"))


def validate(questions: DataFrame, kind: str = "question_type", gold: str = "gold") -> DataFrame:
    """(kind, compared, mismatches): answers against known ones; an error is a mismatch, for a choice an unknown one too."""
    a = run(questions).select(F.col(kind).alias("kind"), ((F.col("answer") == F.col(gold).cast("string")) & (F.col("answer") != "error")).alias("ok"))
    return a.groupBy("kind").agg(F.count("*").alias("compared"), F.count_if(~F.col("ok")).alias("mismatches"))
