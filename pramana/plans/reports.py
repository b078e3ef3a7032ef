"""Reports with intervals by stratum and grounding summaries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pramana.functions import codec as C
from pramana.functions import geometry as G
from pramana.functions import text as T
from pramana.functions.joins import dealt
from pramana.operators import regions as R
from pramana.operators import rewards as W
from pramana.operators import stats as A
from pramana.operators import strata as X
from pramana.plans import derive as D
from pramana.plans.catalogue import _WIDE, query, r6, weights_sql
from pramana.sources.shared import kept

_MAIN = "plain IS NOT NULL AND blind IS NOT NULL AND mask_evidence IS NOT NULL AND mask_random IS NOT NULL"
_STEPS = (D.STEPS_SQL, "cited AS (SELECT k AS id, k % 100 AS video, j, entity, t0, t1, x0, y0, x1, y1, CAST(least(15, greatest(0, round_even((t0 + t1) / 2.0 * 15 / 127, 0))) AS INTEGER) AS frame FROM steps WHERE k % 10 NOT IN (8, 9))")
_GRID = "grid AS (SELECT unnest(range(16)) AS f, unnest([" + ", ".join(map(str, G.grid())) + "]) AS p)"


def _iou(a: str, b: str) -> str:
    """Overlap of two boxes whose columns have these prefixes."""
    i = f"(greatest(0.0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * greatest(0.0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0)))"
    return f"coalesce({i} / nullif(({a}x1 - {a}x0) * ({a}y1 - {a}y0) + ({b}x1 - {b}x0) * ({b}y1 - {b}y0) - {i}, 0), 0)"


def _share(a: str, b: str) -> str:
    """Share of the first box that the second covers."""
    return f"(greatest(0.0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * greatest(0.0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0)) / (({a}x1 - {a}x0) * ({a}y1 - {a}y0)))"


_ENDS = ", ".join(f"round({v}[least(len({v}), CAST(floor({s} * len({v})) AS INTEGER) + 1)], 6) AS {n}" for v, s, n in (("f", 0.025, "flip_lo"), ("f", 0.975, "flip_hi"), ("g", 0.025, "gap_lo"), ("g", 0.975, "gap_hi")))
_DRAWN = ",\n".join(
    (
        "csum AS (SELECT stratum, cluster, sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy FROM picked WHERE stratum IS NOT NULL GROUP BY stratum, cluster)",
        "msum AS (SELECT stratum, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy FROM csum GROUP BY 1)",
        *weights_sql("(SELECT DISTINCT cluster FROM csum)", X.REPLICATES),
        "reps AS (SELECT stratum, rep, sum(w * sx)::DOUBLE / sum(w * n) AS f, sum(w * sx)::DOUBLE / sum(w * n) - sum(w * sy)::DOUBLE / sum(w * n) AS g FROM csum JOIN wt USING (cluster) GROUP BY 1, 2 HAVING sum(w * n) > 0)",
        "ends AS (SELECT stratum, list_sort(list(f)) AS f, list_sort(list(g)) AS g FROM reps GROUP BY 1)",
    )
)
_INTERVALS = f"""SELECT s.stratum, CAST(s.n AS BIGINT) AS n, round(sx::DOUBLE / n, 6) AS flip, round(sy::DOUBLE / n, 6) AS flip_control, round(sx::DOUBLE / n - sy::DOUBLE / n, 6) AS gap, {_ENDS} FROM msum s JOIN ends e ON s.stratum = e.stratum WHERE n > 0"""


def _picked(stratum: str, pair: str, source: str = "wide") -> str:
    a, b = A.PAIRS[pair]
    return f"picked AS (SELECT {stratum} AS stratum, qset AS cluster, plain AS w, 1 - {a} AS x, 1 - {b} AS y FROM {source} WHERE plain IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL)"


def _rounded(df):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes])


def _intervals(items):
    return _rounded(X.clustered(items))


def _wide(spark, sf):
    return A.wide(D.runs(spark, sf), D.CONDITIONS)


def _cites(spark, sf):
    """(id, video, j, entity, t0, t1, box, frame) of every step that is not about the whole frame; texts are made and parsed once, however often it is read."""
    p = C.parse(D.chain_texts(spark, sf)).select(F.col("k").alias("id"), F.posexplode("parsed.chain").alias("j", "s"))
    p = p.where(~G.whole_frame(F.col("s.box")))
    return kept(p.select("id", (F.col("id") % 100).alias("video"), (F.col("j") + 1).alias("j"), F.lower(T.entity_of("s.question")).alias("entity"), "s.t0", "s.t1", "s.box", G.frame_of("s.t0", "s.t1").alias("frame")), "cites")


def _stratified(spark, sf, strata, pair, column="stratum"):
    """Intervals of a pair over the items of each stratum. strata: (id, column)."""
    return _intervals(X.right_under_plain(_wide(spark, sf).join(dealt(strata), "id"), *A.PAIRS[pair], column))


# ---- the report and its splits


def _report_sql():
    out = []
    for name, (a, b) in A.PAIRS.items():
        out.append(f"SELECT '{name}:' || unnest([question_type, 'ALL']) AS stratum, qset AS cluster, plain AS w, 1 - {a} AS x, 1 - {b} AS y FROM wide WHERE {_MAIN} AND {a} IS NOT NULL AND {b} IS NOT NULL")
    out.append(f"SELECT 'blind:' || unnest([question_type, 'ALL']), qset, 1, plain, blind FROM wide WHERE {_MAIN}")
    return "picked AS (" + " UNION ALL ".join(out) + ")"


@query(_INTERVALS, (D.RUNS_SQL, _WIDE, _report_sql(), _DRAWN))
def report_intervals(spark, sf):
    """Every gap of the report with its interval, over all items and by type; the blind gap is a difference of accuracies."""
    w = _wide(spark, sf).where("plain is not null and blind is not null and mask_evidence is not null and mask_random is not null")
    kinds = lambda name: F.explode(F.array(*[F.concat(F.lit(f"{name}:"), k) for k in (F.col("question_type"), F.lit("ALL"))]))
    items = w.select(kinds("blind").alias("stratum"), F.col("qset").alias("cluster"), F.lit(1).alias("w"), F.col("plain").alias("x"), F.col("blind").alias("y"))
    for name, pair in A.PAIRS.items():
        items = items.unionByName(X.right_under_plain(w.withColumn("stratum", kinds(name)), *pair))
    return _intervals(items)


@query(_INTERVALS, (D.RUNS_SQL, _WIDE, _picked("gold", "cite"), _DRAWN))
def gold_intervals(spark, sf):
    return _intervals(X.right_under_plain(_wide(spark, sf), *A.PAIRS["cite"], "gold"))


@query("SELECT gold, count(*) AS n, round(avg(1 - blind), 6) AS blind_flip FROM wide WHERE plain = 1 AND blind IS NOT NULL AND mask_cite IS NOT NULL AND mask_cite_random IS NOT NULL GROUP BY 1", (D.RUNS_SQL, _WIDE))
def blind_flip_by_gold(spark, sf):
    w = _wide(spark, sf).where("plain = 1 and blind is not null and mask_cite is not null and mask_cite_random is not null")
    return w.groupBy("gold").agg(F.count("*").alias("n"), r6(F.avg(1 - F.col("blind"))).alias("blind_flip"))


_BY_BLIND = "unnest(CASE WHEN blind IS NULL THEN [] WHEN plain = 1 AND blind = 0 THEN CASE WHEN gold = 'yes' THEN ['video_dependent', 'video_dependent_yes'] ELSE ['video_dependent'] END WHEN plain = 1 THEN ['not_video_dependent'] ELSE [] END)"


@query(_INTERVALS, (D.RUNS_SQL, _WIDE, _picked(_BY_BLIND, "es"), _DRAWN))
def blind_intervals(spark, sf):
    dependent = (F.col("plain") == 1) & (F.col("blind") == 0)
    strata = F.array_compact(F.array(F.when(dependent, "video_dependent"), F.when(dependent & (F.col("gold") == "yes"), "video_dependent_yes"), F.when((F.col("plain") == 1) & (F.col("blind") == 1), "not_video_dependent")))
    return _intervals(X.right_under_plain(_wide(spark, sf).withColumn("stratum", F.explode(strata)), *A.PAIRS["es"]))


@query(_INTERVALS, (D.RUNS_SQL, _WIDE, _picked("unnest(list_distinct([tag, 'pool']))", "es", "(SELECT *, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS tag FROM wide)"), _DRAWN))
def pooled_intervals(spark, sf):
    """Items of two runs and of both together; clusters are questions, whichever run their items are from."""
    tag = F.when(F.col("id") % 2 == 0, "a").otherwise("b")
    return _intervals(X.right_under_plain(_wide(spark, sf).withColumn("stratum", F.explode(F.array(tag, F.lit("pool")))), *A.PAIRS["es"]))


def _credit_sql(c):
    return f"CASE WHEN count(*) FILTER (condition = '{c}' AND said = 'yes') = 0 THEN 1.0 / nullif(count(*) FILTER (condition = '{c}'), 0) WHEN count(*) FILTER (condition = '{c}' AND said = 'yes' AND gold = 'yes') > 0 THEN 1.0 / count(*) FILTER (condition = '{c}' AND said = 'yes') ELSE 0 END AS c_{c}, count(*) FILTER (condition = '{c}') AS n_{c}"


@query(f"SELECT count(*) AS n_questions, round(avg(CASE WHEN c_mask_evidence < 1 THEN 1 ELSE 0 END), 6) AS flip, round(avg(CASE WHEN c_mask_random < 1 THEN 1 ELSE 0 END), 6) AS flip_control FROM (SELECT qset, {', '.join(map(_credit_sql, ('plain', 'mask_evidence', 'mask_random')))} FROM (SELECT *, CASE WHEN correct = 1 THEN gold WHEN gold = 'yes' THEN 'no' ELSE 'yes' END AS said FROM runs) GROUP BY 1) WHERE n_plain = n_mask_evidence AND n_plain = n_mask_random AND c_plain = 1", (D.RUNS_SQL,))
def full_credit_flips(spark, sf):
    return _rounded(X.full_credit_flips(D.runs(spark, sf), *A.PAIRS["es"]))


@query("SELECT round(avg(n), 6) AS frames FROM (SELECT id, j, count(f) AS n FROM cited LEFT JOIN grid ON p BETWEEN t0 - 4 AND t1 + 4 GROUP BY 1, 2)", (*_STEPS, _GRID))
def frames_per_span(spark, sf):
    return _cites(spark, sf).agg(r6(F.avg(F.size(G.frames_hit("t0", "t1")))).alias("frames"))


def _unit(axis):
    return f"CAST('0x' || substr(md5('0:' || id || ':' || j || ':{axis}'), 1, 12) AS BIGINT) / 281474976710656.0"


_COVERED = ("placed AS (SELECT *, cx0 + (x1 - x0) AS cx1, cy0 + (y1 - y0) AS cy1 FROM (SELECT *, " + _unit("x") + " * greatest(0.0, 1 - (x1 - x0)) AS cx0, " + _unit("y") + " * greatest(0.0, 1 - (y1 - y0)) AS cy0 FROM cited))",
            "covered AS (SELECT id, avg(best) AS covered FROM (SELECT a.id, a.j, max(" + _share("a.", "b.c") + ") AS best FROM placed a JOIN placed b ON a.id = b.id AND EXISTS (SELECT 1 FROM grid WHERE p BETWEEN a.t0 - 4 AND a.t1 + 4 AND p BETWEEN b.t0 - 4 AND b.t1 + 4) GROUP BY 1, 2) GROUP BY 1)")


def _covered(spark, sf):
    return X.control_coverage(R.random_controls(_cites(spark, sf), ["id", "j"]))


@query("SELECT count(*) AS n, round(avg(covered), 6) AS mean_covered, round(avg(CASE WHEN covered = 0 THEN 1 ELSE 0 END), 6) AS share_untouched, round(avg(CASE WHEN covered >= 0.5 THEN 1 ELSE 0 END), 6) AS share_half_covered FROM covered", (*_STEPS, _GRID, *_COVERED))
def control_coverage(spark, sf):
    return _rounded(X.coverage_summary(_covered(spark, sf)))


@query(_INTERVALS, (D.RUNS_SQL, _WIDE, *_STEPS, _GRID, *_COVERED, _picked("unnest(CASE WHEN gold = 'yes' THEN ['untouched', 'untouched_yes'] ELSE ['untouched'] END)", "cite", "(SELECT w.* FROM wide w JOIN covered c ON w.id = c.id AND c.covered = 0)"), _DRAWN))
def untouched_intervals(spark, sf):
    """The gap on items no cited box of which the control covers."""
    w = _wide(spark, sf).join(dealt(_covered(spark, sf).where("covered = 0")), "id")
    strata = F.array_compact(F.array(F.lit("untouched"), F.when(F.col("gold") == "yes", "untouched_yes")))
    return _intervals(X.right_under_plain(w.withColumn("stratum", F.explode(strata)), *A.PAIRS["cite"]))


_NAMES = ["the red ball", "the white dog", "man in blue", "a tall tree"]
_STOP = ", ".join(f"'{w}'" for w in T.ENTITY_STOP)


def _content(x):
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '' AND NOT w IN ({_STOP}))"


_PROMPTS = "prompts AS (SELECT DISTINCT k AS id, 'Does ' || " + repr(_NAMES) + "[k % 4 + 1] || ' meet ' || " + repr(_NAMES) + "[k // 4 % 4 + 1] AS prompt FROM steps)"
_BY_TEXT = f"texts AS (SELECT id, unnest(CASE WHEN none THEN ['not_in_text', 'no_overlap'] WHEN every THEN ['in_text'] ELSE ['not_in_text'] END) AS stratum FROM (SELECT id, bool_and(len(list_intersect(e, p)) = len(e)) AS every, bool_and(len(list_intersect(e, p)) = 0) AS none FROM (SELECT c.id, {_content('entity')} AS e, {_content('prompt')} AS p FROM cited c JOIN prompts USING (id)) GROUP BY 1))"


def _prompts(cites):
    names = F.array(*map(F.lit, _NAMES))
    k = F.col("id")
    text = F.concat(F.lit("Does "), F.get(names, (k % 4).cast("int")), F.lit(" meet "), F.get(names, (F.expr("id div 4") % 4).cast("int")), F.lit("? Is this option correct? a red ball, a dog, a man, a tree"))
    return cites.select("id").distinct().select("id", text.alias("prompt"))


@query(_INTERVALS, (D.RUNS_SQL, _WIDE, *_STEPS, _PROMPTS, _BY_TEXT, _picked("stratum", "cite", "(SELECT w.*, t.stratum FROM wide w JOIN texts t ON w.id = t.id)"), _DRAWN))
def text_intervals(spark, sf):
    """Items whose prompt names all the entities of the chain, not all, or none of their words."""
    c = _cites(spark, sf)
    s = X.by_text(c, _prompts(c))
    return _stratified(spark, sf, s.select("id", F.explode("strata").alias("stratum")), "cite")


@query(
    f"""SELECT (SELECT count(*) FROM sets WHERE now IS NOT NULL) AS items, (SELECT round(avg(CASE WHEN now IS NOT NULL THEN CASE WHEN was = now THEN 1 ELSE 0 END END), 6) FROM sets) AS same_entities, (SELECT count(*) FROM sets WHERE now IS NULL) AS items_without_citation,
  count(*) AS steps, round(avg(CASE WHEN best >= 0.5 THEN 1 ELSE 0 END), 6) AS same_box, round(avg(CASE WHEN best < 0.5 THEN 1 ELSE 0 END), 6) AS same_frame_other_place, round(avg(CASE WHEN best IS NULL THEN 1 ELSE 0 END), 6) AS other_frame FROM (
  SELECT n.id, n.j, max(CASE WHEN o.id IS NOT NULL THEN {_iou('n.', 'o.')} END) AS best FROM masked n LEFT JOIN (SELECT c.*, f FROM cited c JOIN grid ON p BETWEEN t0 - 4 AND t1 + 4) o ON o.id = n.id AND o.f = n.frame WHERE n.id IN (SELECT id FROM cited) GROUP BY 1, 2)""",
    (*_STEPS, _GRID, "masked AS (SELECT * REPLACE (id - 12 AS id) FROM cited)", "sets AS (SELECT o.id, was, now FROM (SELECT id, list_sort(list(DISTINCT entity)) AS was FROM cited GROUP BY 1) o LEFT JOIN (SELECT id, list_sort(list(DISTINCT entity)) AS now FROM masked GROUP BY 1) n USING (id))"),
)
def recite_report(spark, sf):
    """Where chains cite under a mask, against the plain run: the chain of the key twelve on stands for the masked one."""
    c = _cites(spark, sf)
    old, new = c.select("id", "entity", "t0", "t1", "box"), c.select((F.col("id") - 12).alias("id"), "entity", "t0", "t1", "box")
    return _rounded(X.recite(old, new))


_DOSE = (
    "found AS (SELECT DISTINCT c.id, c.entity, t.frame FROM cited c JOIN tracks t ON t.video = c.video AND t.phrase = c.entity)",
    "doses AS (SELECT f.id, f.frames, (SELECT count(DISTINCT g.f) FROM cited c JOIN grid g ON g.p BETWEEN c.t0 - 4 AND c.t1 + 4 JOIN found x ON x.id = c.id AND x.frame = g.f WHERE c.id = f.id)::DOUBLE / (SELECT count(DISTINCT frame) FROM found x WHERE x.id = f.id) AS cover FROM (SELECT id, avg(n) AS frames FROM (SELECT id, entity, count(*) AS n FROM found GROUP BY 1, 2) GROUP BY 1) f)",
)


def _case(value, cuts):
    return "CASE " + " ".join(f"WHEN {value} < {end} THEN '{name}'" for name, end in cuts) + " END"


@query(_INTERVALS, (D.RUNS_SQL, _WIDE, *_STEPS, D.BOXES_SQL, D.TRACKS_SQL, _GRID, *_DOSE, _picked("unnest(['frames ' || " + _case("frames", X.FRAME_BUCKETS) + ", 'cover ' || " + _case("cover", X.COVER_BUCKETS) + "])", "cite", "(SELECT w.*, d.frames, d.cover FROM wide w JOIN doses d ON w.id = d.id)"), _DRAWN))
def dose_intervals(spark, sf):
    """By how many frames an item's entities were detected on, and by how much of them it cites."""
    d = X.dose(_cites(spark, sf), D.tracks(spark, sf))
    strata = F.array(F.concat(F.lit("frames "), X.buckets("frames", X.FRAME_BUCKETS)), F.concat(F.lit("cover "), X.buckets("cover", X.COVER_BUCKETS)))
    return _stratified(spark, sf, d.select("id", F.explode(strata).alias("stratum")), "cite")


_HITS = ("hits AS (SELECT c.id, CASE WHEN bool_and(t.x0 IS NOT NULL AND " + _iou("c.", "t.") + " >= 0.5) THEN 'all' ELSE 'not_all' END AS status FROM cited c LEFT JOIN tracks t ON t.video = c.video AND t.phrase = c.entity AND t.frame = c.frame GROUP BY 1)",)


@query(_INTERVALS, (D.RUNS_SQL, _WIDE, *_STEPS, D.BOXES_SQL, D.TRACKS_SQL, *_HITS, _picked("status", "cite", "(SELECT w.*, h.status FROM wide w JOIN hits h ON w.id = h.id)"), _DRAWN))
def hit_intervals(spark, sf):
    """Items all of whose named steps overlap the detection of their entity, and the others."""
    s = R.hit_status(_cites(spark, sf), D.tracks(spark, sf))
    return _stratified(spark, sf, s.withColumnRenamed("status", "stratum"), "cite")


def _entity_control(spark, sf):
    c, t = _cites(spark, sf), D.tracks(spark, sf)
    return X.entity_control_share(X.avoiding_regions(X.entity_regions(c, t)), c, t)


@query()
def entity_control(spark, sf):
    """How far the control of each item falls on other entities: its share and stratum."""
    s = _entity_control(spark, sf)
    return s.select("id", r6(F.col("share")).alias("share"), X.control_stratum("share").alias("stratum"))


_FALLS_ON = "(greatest(0.0, least(f.x1, 1.0::DOUBLE - s.x0) - greatest(f.x0, 1.0::DOUBLE - s.x1)) * greatest(0.0, least(f.y1, 1.0::DOUBLE - s.y0) - greatest(f.y0, 1.0::DOUBLE - s.y1))) / ((f.x1 - f.x0) * (f.y1 - f.y0)) >= 0.3"
_MIRRORED = (
    "regs AS (SELECT DISTINCT id, video, t0, t1, x0, y0, x1, y1 FROM (SELECT c.id, c.video, g.p AS t0, g.p AS t1, t.x0, t.y0, t.x1, t.y1 FROM (SELECT DISTINCT id, video, entity FROM cited) c JOIN tracks t ON t.video = c.video AND t.phrase = c.entity JOIN grid g ON g.f = t.frame UNION ALL SELECT id, video, t0, t1, x0, y0, x1, y1 FROM cited WHERE id IN (SELECT c.id FROM cited c JOIN tracks t ON t.video = c.video AND t.phrase = c.entity)))",
    "spots AS (SELECT r.*, g.f AS frame FROM regs r JOIN grid g ON g.p BETWEEN r.t0 - 4 AND r.t1 + 4)",
    f"free AS (SELECT s.id, s.frame, t.x0, t.y0, t.x1, t.y1 FROM (SELECT DISTINCT id, video, frame FROM spots) s JOIN tracks t ON t.video = s.video AND t.frame = s.frame ANTI JOIN cited c ON c.id = s.id AND c.entity = t.phrase ANTI JOIN spots m ON m.id = s.id AND m.frame = s.frame AND {_iou('t.', 'm.')} >= 0.3 WHERE (t.x1 - t.x0) * (t.y1 - t.y0) < 0.4)",
    f"shares AS (SELECT id, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS share FROM (SELECT s.id, s.t0, s.t1, s.x0, s.y0, s.x1, s.y1, s.frame, bool_or(f.id IS NOT NULL) AS hit FROM spots s LEFT JOIN free f ON f.id = s.id AND f.frame = s.frame AND {_FALLS_ON} GROUP BY ALL) GROUP BY 1)",
    "placed AS (SELECT id, share, CASE WHEN share >= 0.5 THEN 'on_other_entity' WHEN share > 0.1 THEN 'mixed' ELSE 'on_background' END AS stratum FROM shares)",
)


def _mirrored(spark, sf):
    """(id, share, stratum) of controls that are an item's regions turned about the middle of the frame."""
    c, t = _cites(spark, sf), D.tracks(spark, sf)
    turned = lambda b: G.box(*[F.lit(1.0) - b[k] for k in ("x1", "y1", "x0", "y0")])
    controls = F.transform("regions", lambda r: F.struct(r["t0"].alias("t0"), r["t1"].alias("t1"), turned(r["box"]).alias("box")))
    s = X.entity_control_share(X.entity_regions(c, t).withColumn("controls", controls), c, t)
    return s.select("id", "share", X.control_stratum("share").alias("stratum"))


@query("SELECT id, round(share, 6) AS share, stratum FROM placed", (*_STEPS, D.BOXES_SQL, D.TRACKS_SQL, _GRID, *_MIRRORED))
def mirrored_control(spark, sf):
    """How far controls at the opposite places fall on other entities."""
    return _rounded(_mirrored(spark, sf))


@query(_INTERVALS, (D.RUNS_SQL, _WIDE, *_STEPS, D.BOXES_SQL, D.TRACKS_SQL, _GRID, *_MIRRORED, _picked("stratum", "cite", "(SELECT w.*, p.stratum FROM wide w JOIN placed p ON w.id = p.id)"), _DRAWN))
def mirrored_control_intervals(spark, sf):
    """Gaps of the items whose controls fall on other entities, on background, and between."""
    return _stratified(spark, sf, _mirrored(spark, sf).drop("share"), "cite")


# ---- grounding

#: A chain's question type, and the regions that its question asks for: the partner boxes of the order's lines.
_KIND = "['what', 'why', 'how'][k % 3 + 1]"


def _graded(spark, sf):
    """(id, question_type, chain, has_tags, n_steps, regions) of every chain."""
    p = C.parse(D.chain_texts(spark, sf))
    kind = F.get(F.array(*map(F.lit, ("what", "why", "how"))), (F.col("k") % 3).cast("int"))
    regions = D.boxes(spark, sf).groupBy(F.col("item").alias("k")).agg(F.collect_list(F.struct("t0", "t1", F.col("a").alias("box"))).alias("regions"))
    return p.join(dealt(regions), "k", "left").select(F.col("k").alias("id"), kind.alias("question_type"), "parsed", F.coalesce("regions", F.array().cast(regions.schema["regions"].dataType)).alias("regions"))


_PAIRED = f"""pairs AS (SELECT s.id, s.j, b.item, b.line, b.l_partkey, b.l_suppkey, b.q, {_iou('s.', 'b.a')} AS iou, greatest(0, b.t0 - s.t1, s.t0 - b.t1) AS off, greatest(0, least(s.t1, b.t1) - greatest(s.t0, b.t0) + 1)::DOUBLE AS ti, (s.t1 - s.t0 + 1) + (b.t1 - b.t0 + 1) AS tt FROM cited s JOIN boxes b ON b.item = s.id)"""
_METRICS = """metrics AS (SELECT id, avg(st) AS ground_st, avg(sp) AS ground_spatial, avg(off) AS t_offset FROM (SELECT id, j, max(iou * ti / (tt - ti)) AS st, coalesce(max(iou) FILTER (off <= 8), 0) AS sp, min(off) AS off FROM pairs GROUP BY 1, 2) GROUP BY 1)"""
_RECALL = """recalls AS (SELECT id, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS ground_recall FROM (SELECT id, item, line, l_partkey, l_suppkey, q, bool_or(iou >= 0.5 AND off <= 8) AS hit FROM pairs GROUP BY ALL) GROUP BY 1)"""


@query(
    f"SELECT kind, count(*) AS n, round(avg(ok), 6) AS format_rate, round(avg(steps), 6) AS mean_steps, round(avg(ground_st), 6) AS ground_st, round(avg(ground_spatial), 6) AS ground_spatial, round(avg(ground_recall), 6) AS ground_recall, round(avg(t_offset), 6) AS t_offset FROM (SELECT k, unnest([{_KIND}, 'ALL']) AS kind, CASE WHEN k % 10 IN (8, 9) THEN 0 ELSE 1 END AS ok, CASE WHEN k % 10 = 8 THEN 1 ELSE k % 3 + 1 END AS steps FROM (SELECT o_orderkey AS k FROM orders)) o LEFT JOIN metrics m ON m.id = o.k LEFT JOIN recalls r ON r.id = o.k GROUP BY 1",
    (*_STEPS, D.BOXES_SQL, _PAIRED, _METRICS, _RECALL),
)
def chain_summary(spark, sf):
    """By type and over all: share of valid chains, steps, and the means of four grounding measures over valid chains."""
    g = _graded(spark, sf).select("id", "parsed", "question_type", W.chain_metrics("parsed.chain", "regions").alias("m")).withColumn("kind", F.explode(F.array("question_type", F.lit("ALL"))))
    ok = F.col("parsed.chain").isNotNull()
    return g.groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg(ok.cast("int"))).alias("format_rate"), r6(F.avg("parsed.n_steps")).alias("mean_steps"), *[r6(F.avg(f"m.{c}")).alias(c) for c in ("ground_st", "ground_spatial", "ground_recall", "t_offset")])


_OBJECT = "(id * 7 + j) % 48"
_PROPOSALS = "proposals AS (SELECT scene, o, frame, s.ax0 AS x0, s.ay0 AS y0, s.ax1 AS x1, s.ay1 AS y1 FROM (SELECT item % 100 AS scene, l_partkey % 48 AS o, l_suppkey % 100 AS frame, min({'q': -q, 'i': item, 'l': line, 'p': l_partkey, 's': l_suppkey, 'ax0': ax0, 'ay0': ay0, 'ax1': ax1, 'ay1': ay1}) AS s FROM boxes GROUP BY ALL))"


def _triple(n):
    """Colour, material and shape of object number n."""
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    return pick(T.COLORS, n % 8), pick(T.MATERIALS, F.floor(n / 8) % 2), pick(T.SHAPES, F.floor(n / 16))


def proposals(spark, sf):
    """(scene, color, material, shape, frame, box): the best detection of each object on each frame."""
    b = D.boxes(spark, sf, once=False)
    c, m, s = _triple(F.col("l_partkey") % 48)
    p = b.select((F.col("item") % 100).alias("scene"), c.alias("color"), m.alias("material"), s.alias("shape"), (F.col("l_suppkey") % 100).alias("frame"), F.col("a").alias("box"), F.col("q").alias("score"), "item", "line", "l_partkey", "l_suppkey")
    return R.best_detections(p, ["scene", "color", "material", "shape", "frame"], "score", ["item", "line", "l_partkey", "l_suppkey"]).select("scene", "color", "material", "shape", "frame", "box")


def _object_scores(spark, sf):
    names = ["color", "material", "shape"]
    one = lambda n: F.concat_ws(" ", *_triple(n))
    n = (F.col("id") * 7 + F.col("j")) % 48
    answer = F.concat(F.lit("The "), one(n), F.when(F.col("j") % 2 == 0, F.concat(F.lit(" and the "), one((n + 5) % 48))).otherwise(""))
    # what an answer names is read once too: the scores take the steps in three places
    steps = kept(_cites(spark, sf).withColumn("scene", F.col("video")).withColumn("objects", T.named_objects(answer)), "named")
    return R.step_scores(steps, proposals(spark, sf), ["id", "j"], names)


_SCORES = (
    f"wanted AS (SELECT id, j, video AS scene, (t0 + t1) // 2 AS mid, (t1 - t0) // 2 + 3 AS half, x0, y0, x1, y1, unnest(CASE WHEN j % 2 = 0 THEN [{_OBJECT}, ({_OBJECT} + 5) % 48] ELSE [{_OBJECT}] END) AS o FROM cited)",
    "nearest AS (SELECT w.id, w.j, w.o, w.x0, w.y0, w.x1, w.y1, min({'d': abs(p.frame - w.mid), 'f': p.frame, 'x0': p.x0, 'y0': p.y0, 'x1': p.x1, 'y1': p.y1}) AS s FROM wanted w LEFT JOIN proposals p ON p.scene = w.scene AND p.o = w.o AND p.frame BETWEEN w.mid - w.half AND w.mid + w.half GROUP BY ALL)",
    "unions AS (SELECT id, j, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1, min(s.x0) AS ux0, min(s.y0) AS uy0, max(s.x1) AS ux1, max(s.y1) AS uy1, count(s.f) AS n_found, count(*) AS n_objects FROM nearest GROUP BY 1, 2)",
    f"scores AS (SELECT id, j, CASE WHEN n_found > 0 THEN {_iou('', 'u')} ELSE 0 END AS iou, n_found = n_objects AS visible FROM unions)",
)


@query(
    "SELECT kind, count(*) AS obj_steps, round(avg(iou), 6) AS obj_iou, round(avg(CASE WHEN iou >= 0.5 THEN 1 ELSE 0 END), 6) AS obj_iou_half, round(avg(CASE WHEN visible THEN 1 ELSE 0 END), 6) AS obj_visible FROM (SELECT unnest([['what', 'why', 'how'][id % 3 + 1], 'ALL']) AS kind, iou, visible FROM scores) GROUP BY 1",
    (*_STEPS, D.BOXES_SQL, _PROPOSALS, *_SCORES),
)
def object_grounding(spark, sf):
    """By type and over all, over steps that name objects: overlap with where those are near the cited frames, and whether all were detected."""
    kind = F.get(F.array(*map(F.lit, ("what", "why", "how"))), (F.col("id") % 3).cast("int"))
    s = _object_scores(spark, sf).select("iou", "visible", F.explode(F.array(kind, F.lit("ALL"))).alias("kind"))
    return s.groupBy("kind").agg(F.count("*").alias("obj_steps"), r6(F.avg("iou")).alias("obj_iou"), r6(F.avg((F.col("iou") >= 0.5).cast("int"))).alias("obj_iou_half"), r6(F.avg(F.col("visible").cast("int"))).alias("obj_visible"))


@query(_INTERVALS, (D.RUNS_SQL, _WIDE, *_STEPS, D.BOXES_SQL, _PROPOSALS, *_SCORES, _picked("status", "cite", "(SELECT w.*, s.status FROM wide w JOIN (SELECT id, CASE WHEN bool_and(iou >= 0.5) THEN 'hit_all' ELSE 'hit_not_all' END AS status FROM scores GROUP BY 1) s ON w.id = s.id)"), _DRAWN))
def object_hit_intervals(spark, sf):
    """Items all of whose steps are on the objects that they name, and the others."""
    s = _object_scores(spark, sf).groupBy("id").agg(F.when(F.bool_and(F.col("iou") >= 0.5), "hit_all").otherwise("hit_not_all").alias("stratum"))
    return _stratified(spark, sf, s, "cite")


@query(_INTERVALS, (D.RUNS_SQL, _WIDE, *_STEPS, D.BOXES_SQL, _PROPOSALS, _GRID, _COVERED[0], "onto AS (SELECT DISTINCT c.id FROM placed c JOIN grid ON p BETWEEN c.t0 - 4 AND c.t1 + 4 JOIN proposals o ON o.scene = c.video AND o.frame = p WHERE " + _share("o.", "c.c") + " >= 0.3)", _picked("CASE WHEN onto.id IS NULL THEN 'control_on_background' ELSE 'control_on_object' END", "cite", "wide LEFT JOIN onto ON onto.id = wide.id").replace("plain IS NOT NULL AND", "plain IS NOT NULL AND wide.id IN (SELECT id FROM cited) AND"), _DRAWN))
def control_object_intervals(spark, sf):
    """Items whose control covers three tenths of an object, and those whose control falls on the background."""
    c = R.random_controls(_cites(spark, sf), ["id", "j"])
    points = F.array(*[F.lit(p) for p in G.grid()])
    at = c.select("id", F.col("video").alias("scene"), "control", F.explode(G.frames_hit("t0", "t1")).alias("f")).withColumn("frame", F.get(points, F.col("f")).cast("long"))
    onto = at.join(dealt(proposals(spark, sf)), ["scene", "frame"]).where(G.overlap_share("box", "control") >= 0.3).select("id", F.lit("control_on_object").alias("s")).distinct()
    strata = c.select("id").distinct().join(dealt(onto), "id", "left").select("id", F.coalesce("s", F.lit("control_on_background")).alias("stratum"))
    return _stratified(spark, sf, strata, "cite")


@query(
    f"""SELECT kind, count(DISTINCT id) AS n_items, count(entity) AS n_steps, round(count(own)::DOUBLE / nullif(count(entity), 0), 6) AS detected_rate, round(avg(own), 6) AS mean_iou, round(avg(CASE WHEN own >= 0.5 THEN 1 WHEN own < 0.5 THEN 0 END), 6) AS hit50, round(avg(twin), 6) AS random_mean_iou, round(avg(CASE WHEN twin >= 0.5 THEN 1 WHEN twin < 0.5 THEN 0 END), 6) AS random_hit50, count(DISTINCT CASE WHEN entity IS NOT NULL THEN {{'v': video, 'f': frame, 'e': entity}} END) AS detector_calls FROM (
  SELECT o.k AS id, unnest([{_KIND}, 'ALL']) AS kind, c.video, c.frame, c.entity, CASE WHEN t.x0 IS NOT NULL THEN {_iou('c.', 't.')} END AS own, CASE WHEN t.x0 IS NOT NULL THEN {_iou('c.c', 't.')} END AS twin FROM (SELECT o_orderkey AS k FROM orders) o LEFT JOIN placed c ON c.id = o.k LEFT JOIN tracks t ON t.video = c.video AND t.phrase = c.entity AND t.frame = c.frame) GROUP BY 1""",
    (*_STEPS, D.BOXES_SQL, D.TRACKS_SQL, _COVERED[0]),
)
def citation_twins(spark, sf):
    k = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    kinds = k.select("id", F.get(F.array(*map(F.lit, ("what", "why", "how"))), (F.col("id") % 3).cast("int")).alias("question_type"))
    return _rounded(R.citation_twins(_cites(spark, sf).withColumn("n", F.col("j")), D.tracks(spark, sf), kinds))


@query("SELECT coalesce(n, 0) AS frames, count(*) AS phrases FROM (SELECT DISTINCT video, entity AS phrase FROM cited UNION SELECT video, 'a ghost' FROM cited) LEFT JOIN (SELECT video, phrase, count(DISTINCT frame) AS n FROM tracks GROUP BY 1, 2) USING (video, phrase) GROUP BY 1", (*_STEPS, D.BOXES_SQL, D.TRACKS_SQL))
def track_histogram(spark, sf):
    c = _cites(spark, sf)
    wanted = c.select("video", F.col("entity").alias("phrase")).union(c.select("video", F.lit("a ghost")))
    return R.track_histogram(wanted, D.tracks(spark, sf))


@query("SELECT video, array_to_string(list_sort(list(DISTINCT entity)), '|') AS phrases FROM cited GROUP BY 1", _STEPS)
def phrases_by_video(spark, sf):
    return R.phrases_by_video(_cites(spark, sf)).select("video", F.array_join("phrases", "|").alias("phrases"))
