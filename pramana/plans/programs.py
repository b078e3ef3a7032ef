"""Question programs of every module over the scene logs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pramana.functions import geometry as G
from pramana.operators import programs as P
from pramana.plans import derive as D
from pramana.plans.catalogue import _SCENE, _events, query, r6

_VIEWS = (D.VISIBLE_SQL, D.OBJECTS_SQL, *_SCENE[1:], "scenes AS (SELECT DISTINCT scene FROM objects)", "moves AS (SELECT scene, obj, frame, obj * frame % 3 = 1 AS moving FROM visible)")
_SET = "SELECT s.scene, CAST(count(x.scene) AS VARCHAR) AS answer FROM scenes s LEFT JOIN ({}) x USING (scene) GROUP BY 1"
_SOME = "SELECT s.scene, CASE WHEN count(x.scene) > 0 THEN '{yes}' ELSE '{no}' END AS answer FROM scenes s LEFT JOIN ({}) x USING (scene) GROUP BY 1"
_ONE = "SELECT s.scene, coalesce(x.answer, 'error') AS answer FROM scenes s LEFT JOIN ({}) x USING (scene)"
_FIRST = "(SELECT scene, type, frame, ord, objects, row_number() OVER (PARTITION BY scene ORDER BY ord) AS r, count(*) OVER (PARTITION BY scene) AS n FROM evs WHERE type = '{}')"


def _only(where, what):
    """The value of the only object of a scene for which something holds."""
    return f"SELECT scene, CAST(min({what}) AS VARCHAR) AS answer FROM objects WHERE {where} GROUP BY 1 HAVING count(*) = 1"


def _fixed(answer):
    return f"SELECT scene, '{answer}' AS answer FROM scenes"


_RED = "(SELECT scene, min(obj) AS obj FROM objects WHERE color = 'red' GROUP BY 1 HAVING count(*) = 1)"
#: Name: the program's tokens, and SQL for its answers (scene, answer).
PROGRAMS = {
    "objects": {
        "count_red": ("objects red filter_color count", _SET.format("SELECT scene FROM objects WHERE color = 'red'")),
        "metal_cube": ("objects metal filter_material cube filter_shape exist", _SOME.format("SELECT scene FROM objects WHERE material = 'metal' AND shape = 'cube'", yes="yes", no="no")),
        "no_sphere": ("objects sphere filter_shape exist negate", _SOME.format("SELECT scene FROM objects WHERE shape = 'sphere'", yes="no", no="yes")),
        "shape": ("objects blue filter_color metal filter_material unique query_shape", _ONE.format(_only("color = 'blue' AND material = 'metal'", "shape"))),
        "color": ("objects cylinder filter_shape unique query_color", _ONE.format(_only("shape = 'cylinder'", "color"))),
        "material": ("objects green filter_color unique query_material", _ONE.format(_only("color = 'green'", "material"))),
        "number": ("objects green filter_color unique", _ONE.format(_only("color = 'green'", "obj"))),
    },
    "motion": {
        "moving": ("objects null filter_moving count", _SET.format("SELECT scene, obj FROM moves GROUP BY 1, 2 HAVING bool_or(moving)")),
        "stationary": ("objects null filter_stationary count", _SET.format("SELECT scene, obj FROM moves GROUP BY 1, 2 HAVING NOT bool_or(moving)")),
        "at_start": ("objects start get_frame filter_moving count", _SET.format("SELECT scene FROM moves WHERE frame = 0 AND moving")),
        "at_end": ("objects end get_frame filter_stationary count", _SET.format("SELECT scene FROM moves WHERE frame = 127 AND NOT moving")),
        "at_first_entry": ("objects events objects filter_in first filter_order get_frame filter_moving count", _ONE.format("SELECT f.scene, CAST(count(m.obj) AS VARCHAR) AS answer FROM " + _FIRST.format("in") + " f LEFT JOIN moves m ON m.scene = f.scene AND m.frame = f.frame AND m.moving WHERE r = 1 GROUP BY 1")),
    },
    "events": {
        "all": ("events count", _SET.format("SELECT scene FROM evs")),
        "entries": ("events objects filter_in count", _SET.format("SELECT scene FROM evs WHERE type = 'in'")),
        "red_exits": ("events objects red filter_color filter_out count", _SET.format("SELECT e.scene FROM evs e WHERE type = 'out' AND EXISTS (SELECT 1 FROM objects o WHERE o.scene = e.scene AND color = 'red' AND list_contains(e.objects, o.obj))")),
        "red_collisions": ("events objects red filter_color unique filter_collision count", _ONE.format("SELECT r.scene, CAST(count(e.ord) AS VARCHAR) AS answer FROM " + _RED + " r LEFT JOIN evs e ON e.scene = r.scene AND e.type = 'collision' AND list_contains(e.objects, r.obj) GROUP BY 1")),
        "after_exit": ("events objects filter_collision events objects filter_out first filter_order filter_after count", _ONE.format("SELECT f.scene, CAST(count(e.ord) AS VARCHAR) AS answer FROM " + _FIRST.format("out") + " f LEFT JOIN evs e ON e.scene = f.scene AND e.type = 'collision' AND e.frame > f.frame WHERE r = 1 GROUP BY 1")),
        "before_last": ("events events objects filter_collision last filter_order filter_before count", _ONE.format("SELECT f.scene, CAST(count(e.ord) AS VARCHAR) AS answer FROM " + _FIRST.format("collision") + " f LEFT JOIN evs e ON e.scene = f.scene AND e.frame < f.frame WHERE r = n GROUP BY 1")),
        "before_end": ("events end filter_before count", _SET.format("SELECT scene FROM evs WHERE frame < 127")),
    },
    "order": {
        "second_frame": ("events objects filter_collision second filter_order get_frame", _ONE.format("SELECT scene, CAST(frame AS VARCHAR) AS answer FROM " + _FIRST.format("collision") + " WHERE r = 2")),
        "last_entry": ("events objects filter_in last filter_order get_object query_color", _ONE.format("SELECT f.scene, o.color AS answer FROM " + _FIRST.format("in") + " f JOIN objects o ON o.scene = f.scene AND o.obj = f.objects[1] WHERE r = n")),
        "partner": ("events objects filter_collision first filter_order objects red filter_color unique get_col_partner query_shape", _ONE.format("SELECT f.scene, o.shape AS answer FROM " + _FIRST.format("collision") + " f JOIN " + _RED + " r ON r.scene = f.scene AND list_contains(f.objects, r.obj) JOIN objects o ON o.scene = f.scene AND o.obj <> r.obj AND list_contains(f.objects, o.obj) WHERE f.r = 1")),
        "only_exit": ("events objects filter_out unique get_frame", _ONE.format("SELECT scene, CAST(frame AS VARCHAR) AS answer FROM " + _FIRST.format("out") + " WHERE n = 1")),
        "not_of_a_collision": ("events objects filter_collision first filter_order get_object", _fixed("error")),
    },
    "members": {
        "red_collides": ("objects red filter_color unique events objects filter_collision belong_to", _ONE.format("SELECT r.scene, CASE WHEN EXISTS (SELECT 1 FROM evs e WHERE e.scene = r.scene AND type = 'collision' AND list_contains(e.objects, r.obj)) THEN 'yes' ELSE 'no' END AS answer FROM " + _RED + " r")),
        "possible": ("events objects filter_collision first filter_order all_events belong_to", _ONE.format("SELECT scene, 'yes' AS answer FROM evs WHERE type = 'collision' GROUP BY 1")),
        "pairs": ("all_events count", "SELECT scene, CAST(count(*) * (count(*) - 1) // 2 AS VARCHAR) AS answer FROM objects GROUP BY 1"),
        "entry_among_exits": ("events objects filter_in first filter_order events objects filter_out belong_to", _ONE.format("SELECT scene, 'no' AS answer FROM evs WHERE type = 'in' GROUP BY 1")),
    },
    "unknown": {
        "unseen": ("unseen_events count", _fixed("unknown")),
        "unseen_red": ("unseen_events objects filter_collision exist negate", _fixed("unknown")),
        "belongs": ("objects red filter_color unseen_events belong_to", _fixed("unknown")),
        "removed": ("events objects red filter_color unique get_counterfact exist", _ONE.format("SELECT scene, 'unknown' AS answer FROM " + _RED)),
        "ordered": ("unseen_events first filter_order get_frame", _fixed("error")),
        "too_few": ("red filter_color", _fixed("error")),
        "wrong_kind": ("objects negate events count", _fixed("error")),
        "nothing": ("", _fixed("error")),
    },
}


def _moves(spark, sf):
    big = F.col("obj") * F.col("frame") % 3 == 1
    return D.visible(spark, sf).withColumn("speed", G.speed(F.when(big, 0.03).otherwise(0.006), F.when(big, 0.04).otherwise(0.008)))


def scenes(spark, sf):
    return P.scene_rows(D.scene_objects(spark, sf), _moves(spark, sf), _events(spark, sf))


def ask(rows, programs, *more):
    """Scenes with each of some programs: name -> tokens, and more of their columns."""
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, t.split())).cast("array<string>").alias("program")) for n, t in programs.items()])
    return rows.select("*", F.explode(named).alias("q")).select("scene", "o", "e", "m", *more, "q.name", "q.program")


def _asked(spark, sf, programs):
    return ask(scenes(spark, sf), programs)


def _register(group, members):
    sql = " UNION ALL ".join(f"SELECT '{name}' AS name, scene, answer FROM ({text})" for name, (_, text) in members.items())

    def asked(spark, sf):
        return P.run(_asked(spark, sf, {n: t for n, (t, _) in members.items()})).select("name", "scene", "answer")

    asked.__name__ = f"program_{group}"
    query(sql, _VIEWS)(asked)


for _group, _members in PROGRAMS.items():
    _register(_group, _members)


@query("SELECT scene, CAST(count(*) AS BIGINT) AS n FROM (WITH RECURSIVE step AS (SELECT DISTINCT scene, ord, lag(ord) OVER (PARTITION BY scene, obj ORDER BY frame, ord) AS cause FROM (SELECT scene, ord, frame, unnest(objects) AS obj FROM evs)), up(scene, ord, cause) AS (SELECT * FROM (SELECT s.scene, s.ord, s.cause FROM step s JOIN (SELECT scene, max(ord) AS m FROM evs WHERE type = 'collision' GROUP BY 1) l ON s.scene = l.scene AND s.ord = l.m WHERE cause IS NOT NULL) UNION SELECT u.scene, u.ord, s.cause FROM up u JOIN step s ON s.scene = u.scene AND s.ord = u.cause WHERE s.cause IS NOT NULL) SELECT DISTINCT scene, cause FROM up) GROUP BY 1", _VIEWS)
def program_ancestors(spark, sf):
    """How many events led to the last collision, by the program's module; scenes without any are left out."""
    a = P.run(_asked(spark, sf, {"led": "events events objects filter_collision last filter_order filter_ancestor count"})).where("answer not in ('error', '0')")
    return a.select("scene", F.col("answer").cast("long").alias("n"))


_THRESHOLDS = [0.005, 0.02, 0.04, 0.06]
_MOTION = {n: PROGRAMS["motion"][n][0] for n in ("moving", "stationary", "at_start")} | {"count_red": PROGRAMS["objects"]["count_red"][0]}


def _agree_sql():
    seen = "(SELECT scene, obj, bool_or({m}) AS ever, bool_or(frame = 0 AND {m}) AS first FROM moves GROUP BY 1, 2)"
    by = [seen.format(m=m) for m in ("true", "moving", "moving", "false")]
    parts = []
    for t, sub in zip(_THRESHOLDS, by):
        parts.append(f"SELECT {t} AS threshold, g.scene, g.moving, g.at_start, coalesce(t.moving, 0) AS t_moving, coalesce(t.at_start, 0) AS t_start, g.objs FROM gold g LEFT JOIN (SELECT scene, count(*) FILTER (ever) AS moving, count(*) FILTER (first) AS at_start FROM {sub} GROUP BY 1) t USING (scene)")
    return " UNION ALL ".join(parts)


_RATED = (*_VIEWS, "gold AS (SELECT scene, count(*) FILTER (ever) AS moving, count(*) FILTER (first) AS at_start, count(*) AS objs FROM (SELECT scene, obj, bool_or(moving) AS ever, bool_or(frame = 0 AND moving) AS first FROM moves GROUP BY 1, 2) GROUP BY 1)", "rated AS (" + _agree_sql() + ")", "answered AS (SELECT threshold, unnest(['moving', 'stationary', 'at_start', 'count_red']) AS asked, unnest([CASE WHEN moving = t_moving THEN 1 ELSE 0 END, CASE WHEN moving = t_moving THEN 1 ELSE 0 END, CASE WHEN at_start = t_start THEN 1 ELSE 0 END, 1]) AS ok FROM rated)")


@query("SELECT threshold, kind, count(*) AS n, count(*) FILTER (asked <> 'count_red') AS n_motion, round(avg(ok), 6) AS agree, round(avg(CASE WHEN asked <> 'count_red' THEN ok END), 6) AS agree_motion FROM (SELECT threshold, asked, unnest([asked, 'ALL']) AS kind, ok FROM answered) GROUP BY 1, 2", _RATED)
def threshold_agreement(spark, sf):
    """How far answers at each motion threshold agree with those at 0.02."""
    return P.agreement(_gold(spark, sf), _THRESHOLDS, "name").select("threshold", "kind", "n", "n_motion", r6(F.col("agree")).alias("agree"), r6(F.col("agree_motion")).alias("agree_motion"))


def _gold(spark, sf):
    return P.run(_asked(spark, sf, _MOTION), out="gold")


@query("SELECT threshold, round(agree, 6) AS agree FROM (SELECT threshold, avg(ok) AS agree FROM answered GROUP BY 1) ORDER BY 2 DESC, 1 LIMIT 1", _RATED)
def motion_threshold(spark, sf):
    """The first threshold of the best agreement."""
    b = P.best_threshold(P.agreement(_gold(spark, sf), _THRESHOLDS, "name"))
    return b.select("threshold", r6(F.col("agree")).alias("agree"))


@query("SELECT name AS kind, count(*) AS compared, count(*) FILTER (scene % 5 = 0 OR answer = 'error') AS mismatches FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, scene, answer FROM ({PROGRAMS['objects'][n][1]})" for n in ("count_red", "metal_cube", "shape")) + ") GROUP BY 1", _VIEWS)
def validate_answers(spark, sf):
    """Answers against known ones of which a fifth is wrong."""
    asked = P.run(_asked(spark, sf, {n: PROGRAMS["objects"][n][0] for n in ("count_red", "metal_cube", "shape")}), out="gold")
    wrong = F.when(F.col("scene") % 5 == 0, F.concat(F.col("gold"), F.lit("?"))).otherwise(F.col("gold"))
    return P.validate(asked.withColumn("gold", wrong), "name")
