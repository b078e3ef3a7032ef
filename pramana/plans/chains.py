"""Chains of the scenes' question programs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pramana.functions import geometry as G
from pramana.operators import chains as C
from pramana.plans import derive as D
from pramana.plans import programs as PP
from pramana.plans.catalogue import _SCENE, query

_ASKED = {
    "unique": "objects blue filter_color metal filter_material unique query_shape",
    "collision": "events objects filter_collision first filter_order get_frame",
    "red": "objects red filter_color exist",
}


def _detections(spark, sf):
    """Detections at three of four visible frames, sides of binary fractions; a lesser one of the same object at each fifth frame, an empty one at each seventh."""
    v = D.visible(spark, sf).join(D.scene_objects(spark, sf), ["scene", "obj"]).where("(obj * frame + scene) % 4 <> 0")
    x0, y0 = (F.col("obj") * 5 + F.col("frame")) % 32 / 64, (F.col("obj") * 3 + F.col("frame")) % 16 / 32
    box = G.box(x0, y0, x0 + (F.col("frame") % 7 + 1) / 32, y0 + (F.col("scene") % 5 + 2) / 16)
    whole = G.box(*[F.lit(c) for c in (0.0, 0.0, 1.0, 1.0)])
    one = lambda score, b: F.struct(F.lit(score).alias("score"), b.alias("box"))
    sets = F.array(one(0.9, box), F.when(F.col("frame") % 5 == 0, one(0.4, whole)), F.when(F.col("frame") % 7 == 0, one(1.0, F.when(F.lit(False), whole))))
    return v.select("scene", "frame", "color", "material", "shape", F.posexplode(F.filter(sets, lambda s: s.isNotNull())).alias("ord", "s")).select("scene", "frame", "color", "material", "shape", "ord", "s.score", "s.box")


def _built(spark, sf):
    scenes = C.with_detections(PP.scenes(spark, sf), D.scene_objects(spark, sf), C.best_detections(_detections(spark, sf)))
    # a scene is few bytes and much work: by bytes alone it would stand with too many others
    spread = scenes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "scene")
    asked = PP.ask(spread, _ASKED, "d").withColumn("gold", F.lit("yes")).withColumn("is_choice", F.lit(True))
    return C.build(asked, ["scene", "name"])


_VIEWS = (
    D.VISIBLE_SQL, D.OBJECTS_SQL, *_SCENE[1:],
    "scenes AS (SELECT DISTINCT scene FROM objects)",
    "named AS (SELECT *, 'the ' || color || ' ' || material || ' ' || shape AS called FROM objects)",
    "found AS (SELECT *, x0 + (frame % 7 + 1) / 32.0::DOUBLE AS x1, y0 + (scene % 5 + 2) / 16.0::DOUBLE AS y1 FROM (SELECT scene, obj, frame, ((obj * 5 + frame) % 32) / 64.0::DOUBLE AS x0, ((obj * 3 + frame) % 16) / 32.0::DOUBLE AS y0 FROM visible WHERE (obj * frame + scene) % 4 <> 0))",
    "seen AS (SELECT scene, obj, min(frame) AS lo FROM visible WHERE frame % 3 = 0 GROUP BY 1, 2)",
    "big AS (SELECT scene, obj, frame AS hi FROM (SELECT scene, obj, frame, row_number() OVER (PARTITION BY scene, obj ORDER BY (x1 - x0) * (y1 - y0) DESC, frame) AS r FROM found WHERE frame % 3 = 0) WHERE r = 1)",
    "single AS (SELECT scene, min(obj) AS obj FROM objects WHERE color = 'blue' AND material = 'metal' GROUP BY 1 HAVING count(*) = 1)",
    "hit AS (SELECT scene, frame, objects AS pair FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY ord) AS r FROM evs WHERE type = 'collision') WHERE r = 1)",
    "red AS (SELECT scene, obj FROM objects WHERE color = 'red')",
    "common AS (SELECT scene, arg_min(frame, frame - n * 1000) AS near_to FROM (SELECT scene, frame, count(*) AS n FROM found JOIN red USING (scene, obj) WHERE frame % 4 = 0 GROUP BY 1, 2) GROUP BY 1)",
    """want AS (
  SELECT 'unique' AS name, scene, obj, coalesce(hi, lo, 0) AS near_to, coalesce(hi, lo, 0) AS t0, coalesce(hi, lo, 0) AS t1 FROM single LEFT JOIN big USING (scene, obj) LEFT JOIN seen USING (scene, obj)
  UNION ALL SELECT 'collision', scene, unnest(pair), frame, greatest(frame - 2, 0), least(frame + 2, 127) FROM hit
  UNION ALL SELECT 'red', scene, obj, coalesce(near_to, 0), coalesce(near_to, 0), coalesce(near_to, 0) FROM red LEFT JOIN common USING (scene))""",
    "near AS (SELECT w.name, w.scene, w.obj, w.t0, w.t1, arg_min({'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}, abs(frame - near_to) * 1000 + frame) AS b FROM want w JOIN found f ON f.scene = w.scene AND f.obj = w.obj AND abs(f.frame - w.near_to) <= 10 GROUP BY 1, 2, 3, 4, 5)",
    "shown AS (SELECT w.name, w.scene, min(w.t0) AS t0, max(w.t1) AS t1, count(*) = count(b) AS ok, min(b.x0) AS x0, min(b.y0) AS y0, max(b.x1) AS x1, max(b.y1) AS y1 FROM want w LEFT JOIN near n ON n.name = w.name AND n.scene = w.scene AND n.obj = w.obj GROUP BY 1, 2)",
    """said AS (
  SELECT 'unique' AS name, scene, 'Which object is the blue metal object?' AS question, called AS answer FROM single JOIN named USING (scene, obj)
  UNION ALL SELECT 'collision', scene, 'What is the first collision?', 'the collision between ' || x.called || ' and ' || y.called || ' at frame ' || frame FROM hit JOIN named x USING (scene) JOIN named y USING (scene) WHERE x.obj = pair[1] AND y.obj = pair[2]
  UNION ALL SELECT 'red', scene, 'Which red objects are there?', string_agg(called, ', ' ORDER BY obj) FROM red JOIN named USING (scene, obj) GROUP BY 1, 2)""",
    """told AS (
  SELECT a.name, a.scene, CASE WHEN s.name IS NOT NULL THEN CASE WHEN ok THEN 'ok' ELSE 'no_evidence' END WHEN a.name = 'red' THEN 'executor_disagrees' ELSE 'executor_error' END AS status, coalesce(ok, false) AS ok, question, answer, t0, t1, x0, y0, x1, y1
  FROM (SELECT unnest(['unique', 'collision', 'red']) AS name, scene FROM scenes) a LEFT JOIN shown s USING (name, scene) LEFT JOIN said q USING (name, scene))""",
)
_SIDES = ("t0", "t1", "x0", "y0", "x1", "y1")


@query("SELECT name, scene, status, " + ", ".join(f"CASE WHEN ok THEN {c} END AS {c}" for c in ("question", "answer", *_SIDES)) + ", CASE WHEN ok THEN 0 END AS n_links FROM told", _VIEWS)
def chain_build(spark, sf):
    """The chains of three programs for each scene: status, and the words, evidence and links of their one step."""
    t = F.col("t")
    rows = _built(spark, sf).select("name", "scene", "status", F.explode_outer("triplets").alias("t"))
    return rows.select("name", "scene", "status", "t.question", "t.answer", "t.evidence.t0", "t.evidence.t1", *[f"t.evidence.box.{c}" for c in _SIDES[2:]], F.when(t.isNotNull(), F.size("t.depends_on")).alias("n_links"))


@query("SELECT name AS kind, status, CASE WHEN ok THEN 1 END AS n_triplets, count(*) AS n FROM told GROUP BY 1, 2, 3", _VIEWS)
def chain_status_counts(spark, sf):
    """How many chains of each program have a status and a length."""
    return C.status_counts(_built(spark, sf), "name")


#: Programs whose chains link: a partner, an object of an entry and of an exit, one object named twice, and a choice with an unknown outcome.
_LINKED = {
    "partner": "events objects filter_collision first filter_order objects red filter_color metal filter_material unique get_col_partner query_shape",
    "entry": "events objects filter_in last filter_order get_object query_color",
    "exit": "events objects filter_out first filter_order get_object query_color",
    "twice": "objects blue filter_color metal filter_material unique events objects blue filter_color metal filter_material unique filter_out first filter_order get_frame",
    "choice": "all_events objects red filter_color metal filter_material unique filter_collision objects blue filter_color metal filter_material unique filter_collision unique unseen_events belong_to",
}


def _everywhere(spark, sf):
    """Scenes whose objects are all detected on every eighth frame."""
    objs = D.scene_objects(spark, sf)
    at = objs.select("*", F.explode(F.sequence(F.lit(0), F.lit(C.FRAMES - 1), F.lit(8))).alias("frame"))
    x = (F.col("obj") * 5 + F.col("frame")) % 32 / 64
    found = at.select("scene", "color", "material", "shape", "frame", F.lit(0).alias("ord"), F.lit(1.0).alias("score"), G.box(x, x, x + 0.25, x + 0.5).alias("box"))
    return C.with_detections(PP.scenes(spark, sf), objs, C.best_detections(found))


def _single(color):
    return f"(SELECT scene, min(obj) AS obj FROM objects WHERE color = '{color}' AND material = 'metal' GROUP BY 1 HAVING count(*) = 1)"


def _nth(kind, where):
    return f"(SELECT scene, frame, objects FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY ord) AS r, count(*) OVER (PARTITION BY scene) AS n FROM evs WHERE type = '{kind}') WHERE {where})"


_TOLD = (
    D.VISIBLE_SQL, D.OBJECTS_SQL, *_SCENE[1:],
    "scenes AS (SELECT DISTINCT scene FROM objects)",
    "named AS (SELECT scene, obj, 'the ' || color || ' ' || material || ' ' || shape AS called FROM objects)",
    f"first_hit AS {_nth('collision', 'r = 1')}",
    f"partner AS (SELECT f.scene, f.frame, 'the collision between ' || x.called || ' and ' || y.called || ' at frame ' || f.frame AS hit, r.called AS red, p.called AS other FROM first_hit f JOIN {_single('red')} s USING (scene) JOIN named x ON x.scene = f.scene AND x.obj = f.objects[1] JOIN named y ON y.scene = f.scene AND y.obj = f.objects[2] JOIN named r ON r.scene = f.scene AND r.obj = s.obj JOIN named p ON p.scene = f.scene AND p.obj = CASE WHEN f.objects[1] = s.obj THEN f.objects[2] ELSE f.objects[1] END WHERE list_contains(f.objects, s.obj))",
    f"moved AS (SELECT 'entry' AS name, e.scene, frame, called, 'What is the last entry into the scene?' AS asked, ' entering' AS did, 'enters' AS does FROM {_nth('in', 'r = n')} e JOIN named n ON n.scene = e.scene AND n.obj = e.objects[1] UNION ALL SELECT 'exit', e.scene, frame, called, 'What is the first exit from the scene?', ' exiting', 'exits' FROM {_nth('out', 'r = 1')} e JOIN named n ON n.scene = e.scene AND n.obj = e.objects[1])",
    f"blue AS (SELECT s.scene, s.obj, called FROM {_single('blue')} s JOIN named USING (scene, obj))",
    f"red AS (SELECT s.scene, s.obj, called FROM {_single('red')} s JOIN named USING (scene, obj))",
    "gone AS (SELECT b.scene, b.called, min({'ord': e.ord, 'frame': e.frame}).frame AS frame FROM blue b JOIN evs e ON e.scene = b.scene AND e.type = 'out' AND e.objects[1] = b.obj GROUP BY ALL)",
    "met AS (SELECT r.scene, r.obj AS a, b.obj AS b, r.called AS red, b.called AS blue, min({'ord': e.ord, 'frame': e.frame}).frame AS frame FROM red r JOIN blue b ON b.scene = r.scene LEFT JOIN evs e ON e.scene = r.scene AND e.type = 'collision' AND list_contains(e.objects, r.obj) AND list_contains(e.objects, b.obj) GROUP BY ALL)",
    """told AS (
  SELECT 'partner' AS name, scene, unnest([{'step': 0, 'role': 'resolve', 'question': 'What is the first collision?', 'answer': hit, 'links': ''}, {'step': 1, 'role': 'resolve', 'question': 'Which object is the red metal object?', 'answer': red, 'links': ''}, {'step': 2, 'role': 'resolve', 'question': 'Which object does ' || red || ' collide with at frame ' || frame || '?', 'answer': other, 'links': '0,1'}]) AS t FROM partner
  UNION ALL SELECT name, scene, unnest([{'step': 0, 'role': 'resolve', 'question': asked, 'answer': called || did || ' the scene at frame ' || frame, 'links': ''}, {'step': 1, 'role': 'resolve', 'question': 'Which object ' || does || ' the scene at frame ' || frame || '?', 'answer': called, 'links': '0'}]) FROM moved
  UNION ALL SELECT 'twice', scene, unnest([{'step': 0, 'role': 'resolve', 'question': 'Which object is the blue metal object?', 'answer': called, 'links': ''}, {'step': 1, 'role': 'resolve', 'question': 'What is the first exit from the scene involving the blue metal object?', 'answer': called || ' exiting the scene at frame ' || frame, 'links': '0'}]) FROM gone
  UNION ALL SELECT 'choice', scene, unnest([{'step': 0, 'role': 'resolve', 'question': 'Which object is the red metal object?', 'answer': red, 'links': ''}, {'step': 1, 'role': 'resolve', 'question': 'Which object is the blue metal object?', 'answer': blue, 'links': ''}, {'step': 2, 'role': 'observe', 'question': 'Do ' || (SELECT n.called FROM named n WHERE n.scene = met.scene AND n.obj = least(a, b)) || ' and ' || (SELECT n.called FROM named n WHERE n.scene = met.scene AND n.obj = greatest(a, b)) || ' collide during the video?', 'answer': coalesce('yes, at frame ' || frame, 'no'), 'links': '0,1'}]) FROM met)""",
)


@query("SELECT p.name, s.scene, CASE WHEN t.name IS NULL THEN 'executor_error' ELSE 'ok' END AS status, t.t.step AS step, t.t.role AS role, t.t.question AS question, t.t.answer AS answer, t.t.links AS links FROM (SELECT unnest(['partner', 'entry', 'exit', 'twice', 'choice']) AS name) p, scenes s LEFT JOIN told t ON t.name = p.name AND t.scene = s.scene", _TOLD)
def chain_links(spark, sf):
    """Chains with links, an entry, an exit, an object named twice and told once, and a choice whose outcome is unknown: every step."""
    spread = _everywhere(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "scene")
    asked = PP.ask(spread, _LINKED, "d").withColumn("gold", F.lit("yes")).withColumn("is_choice", F.lit(True))
    rows = C.build(asked, ["scene", "name"]).select("name", "scene", "status", F.posexplode_outer("triplets").alias("step", "t"))
    return rows.select("name", "scene", "status", "step", "t.role", "t.question", "t.answer", F.array_join(F.col("t.depends_on").cast("array<string>"), ",").alias("links"))
