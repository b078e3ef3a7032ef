"""Queries over the derived views, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pramana.functions import codec as C
from pramana.functions import geometry as G
from pramana.functions import rle
from pramana.functions import text as T
from pramana.functions.joins import dealt
from pramana.operators import curate as U
from pramana.operators import regions as R
from pramana.operators import rewards as W
from pramana.operators import scenes as S
from pramana.operators import stats as A
from pramana.operators import resample as B
from pramana.plans import derive as D
from pramana.sources.shared import kept
from pramana.streaming.running import running_accuracy

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: tuple = ()):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = "WITH " + ", ".join(views) + "\n" if views else ""
            SQL[f.__name__] = head + sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# ---- paired runs

_WIDE = """wide AS (SELECT id, max(question_type) FILTER (condition = 'plain') AS question_type, max(qset) FILTER (condition = 'plain') AS qset, max(gold) FILTER (condition = 'plain') AS gold,
  """ + ", ".join(f"max(correct) FILTER (condition = '{c}') AS {c}" for c in D.CONDITIONS) + " FROM runs GROUP BY id)"
_RIGHT = "plain = 1 AND {a} IS NOT NULL AND {b} IS NOT NULL"


def _flip(c, among="true"):
    return f"CAST(count(*) FILTER (plain = 1 AND {among} AND {c} = 0) AS DOUBLE) / nullif(count(*) FILTER (plain = 1 AND {among}), 0)"


def _pair_sql():
    out = []
    for name, (a, b) in A.PAIRS.items():
        am = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        x, y = _flip(a, am), _flip(b, am)
        out.append(f"count(*) FILTER ({am}) AS n_{name}, round({x}, 6) AS flip_{a[5:]}, round({y}, 6) AS flip_{b[5:]}, round({x} - {y}, 6) AS {name}_gap")
    return ", ".join(out)


@query(
    "SELECT coalesce(question_type, 'ALL') AS question_type, count(*) AS n, round(avg(plain), 6) AS acc_plain, round(avg(blind), 6) AS acc_blind, round(avg(plain - blind), 6) AS blind_gap, "
    + _pair_sql() + " FROM wide WHERE plain IS NOT NULL AND blind IS NOT NULL AND mask_evidence IS NOT NULL AND mask_random IS NOT NULL GROUP BY GROUPING SETS ((question_type), ())",
    (D.RUNS_SQL, _WIDE),
)
def paired_flip_gap(spark, sf):
    r = A.paired_report(D.runs(spark, sf))
    return r.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


@query("SELECT user_id, event_type, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY 1, 2")
def latest_row_per_id(spark, sf):
    e = D.table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return A.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT condition, count(*) AS n, count(DISTINCT video) AS videos FROM runs WHERE id IN (SELECT id FROM runs WHERE condition = 'mask_track') AND id IN (SELECT id FROM runs WHERE condition = 'mask_cite') GROUP BY 1", (D.RUNS_SQL,))
def condition_intersection_counts(spark, sf):
    r = D.runs(spark, sf)
    ids = r.where("condition = 'mask_track'").select("id").intersect(r.where("condition = 'mask_cite'").select("id"))
    return r.join(ids, "id", "left_semi").groupBy("condition").agg(F.count("*").alias("n"), F.countDistinct("video").alias("videos"))


_BOOT = 2000
_BOOT_VIEWS = (D.RUNS_SQL, _WIDE, "sums AS (SELECT qset AS cluster, count(*) FILTER (plain = 1) AS n, count(*) FILTER (plain = 1 AND mask_cite = 0) AS fa, count(*) FILTER (plain = 1 AND mask_cite_random = 0) AS fb FROM wide WHERE mask_cite IS NOT NULL AND mask_cite_random IS NOT NULL GROUP BY 1)")
_ENDS = "SELECT round(v[CAST(floor(0.025 * len(v)) AS INTEGER) + 1], 6) AS lo, round(v[least(len(v), CAST(floor(0.975 * len(v)) AS INTEGER) + 1)], 6) AS hi, CAST(len(v) AS INTEGER) AS n_reps FROM (SELECT list_sort(list(gap)) AS v FROM ({gaps}))"


def hash_sql(text: str) -> str:
    """The 60 bits that a key is hashed to."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS UBIGINT)"


def mixed_sql(name: str, source: str, keys: str) -> tuple[str, ...]:
    """Views that end in ``name``: the rows of ``source`` with 53 random bits ``t`` from the two columns ``keys``."""
    times = lambda x, c: f"CAST((CAST({x} AS UHUGEINT) * CAST({c} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"
    return (
        f"{name}_1 AS (SELECT *, {times(f'xor({keys})', B.MIX_1)} AS t FROM {source})",
        f"{name}_2 AS (SELECT * REPLACE ({times('xor(t, t >> 32)', B.MIX_2)} AS t) FROM {name}_1)",
        f"{name} AS (SELECT * REPLACE (xor(t, t >> 32) >> 11 AS t) FROM {name}_2)",
    )


def weights_sql(clusters: str, replicates: int = _BOOT) -> tuple[str, ...]:
    """Views that end in wt (cluster, rep, w): the Poisson weight of each of ``clusters`` (cluster) in each replicate."""
    keyed = f"keyed AS (SELECT cluster, rep, {hash_sql("'0:' || cluster")} AS ck, rk FROM {clusters}, (SELECT rep, {hash_sql("'0:rep:' || rep")} AS rk FROM range({replicates}) r(rep)))"
    cuts = ", ".join(map(repr, B.poisson_cuts()))
    return keyed, *mixed_sql("bits", "keyed", "ck, rk"), f"wt AS (SELECT cluster, rep, len(list_filter([{cuts}], lambda c: t / 9007199254740992.0 >= c)) AS w FROM bits)"


def _boot(spark, sf, method):
    w = A.wide(D.runs(spark, sf), ["plain", *A.PAIRS["cite"]])
    i = A.interval(A.bootstrap(A.sums_by_cluster(w, *A.PAIRS["cite"]), _BOOT, method=method))
    return i.select(r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n_reps")


_PLACES = f"places AS (SELECT rep, CAST(pos AS UBIGINT) AS pos, {hash_sql("'0:rep:' || rep")} AS rk FROM range({_BOOT}) a(rep), range((SELECT count(*) FROM sums)) b(pos))"
_DREW = "SELECT rep, sum(fa)::DOUBLE / sum(n) - sum(fb)::DOUBLE / sum(n) AS gap FROM (SELECT rep, t % (SELECT count(*) FROM sums) AS place FROM drew) d JOIN (SELECT row_number() OVER (ORDER BY cluster) - 1 AS place, * FROM sums) s USING (place) GROUP BY rep HAVING sum(n) > 0"


@query(_ENDS.format(gaps=_DREW), (*_BOOT_VIEWS, _PLACES, *mixed_sql("drew", "places", "pos, rk")))
def bootstrap_gap_ci(spark, sf):
    """Draws with replacement, as many as there are clusters."""
    return _boot(spark, sf, "places")


@query(_ENDS.format(gaps=_DREW), (*_BOOT_VIEWS, _PLACES, *mixed_sql("drew", "places", "pos, rk")))
def bootstrap_gap_ci_whole(spark, sf):
    return _boot(spark, sf, "places")


@query(_ENDS.format(gaps="SELECT rep, sum(w * fa)::DOUBLE / sum(w * n) - sum(w * fb)::DOUBLE / sum(w * n) AS gap FROM sums JOIN wt USING (cluster) GROUP BY rep HAVING sum(w * n) > 0"), (*_BOOT_VIEWS, *weights_sql("sums")))
def bootstrap_gap_poisson(spark, sf):
    return _boot(spark, sf, "poisson")


def _gap_sql(stratum):
    a, b = A.PAIRS["es"]
    return f"SELECT {stratum} AS stratum, count(*) AS n_correct, round(avg(1 - {a}), 6) AS flip, round(avg(1 - {b}), 6) AS flip_control, round(avg(1 - {a}) - avg(1 - {b}), 6) AS gap FROM wide WHERE {_RIGHT.format(a=a, b=b)} GROUP BY 1"


def _gap(spark, sf, stratum):
    w = A.wide(D.runs(spark, sf), ["plain", "blind", *A.PAIRS["es"]]).withColumn("stratum", stratum)
    g = A.gap(w, *A.PAIRS["es"], ["stratum"])
    return g.select("stratum", "n_correct", *[r6(F.col(c)).alias(c) for c in ("flip", "flip_control", "gap")])


@query(_gap_sql("gold"), (D.RUNS_SQL, _WIDE))
def gap_by_gold(spark, sf):
    return _gap(spark, sf, F.col("gold"))


@query(_gap_sql("CASE WHEN blind = 0 THEN CASE WHEN gold = 'yes' THEN 'video_dependent_yes' ELSE 'video_dependent' END ELSE 'not_video_dependent' END"), (D.RUNS_SQL, _WIDE))
def gap_by_blind(spark, sf):
    dependent = F.when(F.col("gold") == "yes", "video_dependent_yes").otherwise("video_dependent")
    return _gap(spark, sf, F.when(F.col("blind") == 0, dependent).otherwise("not_video_dependent"))


@query("SELECT round(CAST(count(*) FILTER (plain = 0 AND mask_evidence = 1) AS DOUBLE) / count(*) FILTER (plain = 0), 6) AS wrong_to_right, round(CAST(count(*) FILTER (plain = 1 AND mask_evidence = 0) AS DOUBLE) / count(*) FILTER (plain = 1), 6) AS right_to_wrong, round(avg(mask_evidence - plain), 6) AS net FROM wide WHERE plain IS NOT NULL AND mask_evidence IS NOT NULL", (D.RUNS_SQL, _WIDE))
def symmetric_flips(spark, sf):
    w = A.wide(D.runs(spark, sf), ["plain", "mask_evidence"]).where("plain is not null and mask_evidence is not null")
    share = lambda p, q: r6(F.count_if((F.col("plain") == p) & (F.col("mask_evidence") == q)) / F.nullif(F.count_if(F.col("plain") == p), F.lit(0)))
    return w.agg(share(0, 1).alias("wrong_to_right"), share(1, 0).alias("right_to_wrong"), r6(F.avg(F.col("mask_evidence") - F.col("plain"))).alias("net"))


@query("SELECT round(credit, 6) AS credit, count(*) AS questions FROM (SELECT qset, CASE WHEN count(*) FILTER (said = 'yes') = 0 THEN 1.0 / count(*) WHEN count(*) FILTER (said = 'yes' AND gold = 'yes') > 0 THEN 1.0 / count(*) FILTER (said = 'yes') ELSE 0 END AS credit FROM (SELECT *, CASE WHEN correct = 1 THEN gold WHEN gold = 'yes' THEN 'no' ELSE 'yes' END AS said FROM runs WHERE condition = 'plain') GROUP BY 1) GROUP BY 1", (D.RUNS_SQL,))
def question_selection(spark, sf):
    return A.question_selection(D.runs(spark, sf), "plain").groupBy(r6(F.col("credit")).alias("credit")).agg(F.count("*").alias("questions"))


_POOL_SQL = _gap_sql("tag").replace("FROM wide", "FROM (SELECT unnest([CASE WHEN id % 2 = 0 THEN 'a' END, CASE WHEN id % 3 = 0 THEN 'b' END, CASE WHEN id % 2 <> 0 AND id % 3 <> 0 THEN 'c' END]) AS own, * FROM wide), (VALUES (0), (1)) p(pool), LATERAL (SELECT CASE WHEN pool = 1 THEN 'pool' ELSE own END AS tag)").replace(" GROUP BY 1", " AND own IS NOT NULL GROUP BY 1")


@query(_POOL_SQL, (D.RUNS_SQL, _WIDE))
def pooled_gap(spark, sf):
    """Ids in tags by two and by three, those in neither in a third, and the pool of all."""
    w = A.wide(D.runs(spark, sf), ["plain", *A.PAIRS["es"]])
    in_a, in_b = F.col("id") % 2 == 0, F.col("id") % 3 == 0
    tags = F.array_compact(F.array(F.when(in_a, "a"), F.when(in_b, "b"), F.when(~in_a & ~in_b, "c")))
    both = w.withColumn("tag", F.explode(tags)).withColumn("stratum", F.explode(F.array("tag", F.lit("pool"))))
    g = A.gap(both, *A.PAIRS["es"], ["stratum"])
    return g.select("stratum", "n_correct", *[r6(F.col(c)).alias(c) for c in ("flip", "flip_control", "gap")])


@query(_POOL_SQL, (D.RUNS_SQL, _WIDE))
def pooled_gap_whole(spark, sf):
    return pooled_gap(spark, sf)


@query("SELECT condition, round(avg(fraction), 6) AS area, list_sort(list(fraction))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS upper_median FROM runs WHERE condition LIKE 'mask%' GROUP BY 1", (D.RUNS_SQL,))
def mean_masked_area(spark, sf):
    r = D.runs(spark, sf).where("condition like 'mask%'").select("condition", "fraction")
    mean = r.groupBy("condition").agg(r6(F.avg("fraction")).alias("area"))
    return mean.join(A.upper_median_by(r, ["condition"], "fraction"), "condition").withColumnRenamed("median", "upper_median")


@query("SELECT coalesce(question_type, 'ALL') AS question_type, count(*) AS questions, round(avg(all_right), 6) AS per_question, round(sum(r)::DOUBLE / sum(n), 6) AS per_option FROM (SELECT qset, min(question_type) AS question_type, min(correct) AS all_right, sum(correct) AS r, count(*) AS n FROM runs WHERE condition = 'plain' GROUP BY 1) GROUP BY GROUPING SETS ((question_type), ())", (D.RUNS_SQL,))
def per_question_accuracy(spark, sf):
    q = U.per_question(D.runs(spark, sf).where("condition = 'plain'"))
    return q.select("question_type", "questions", r6(F.col("per_question")).alias("per_question"), r6(F.col("per_option")).alias("per_option"))


@query("SELECT question_type, count(*) AS n, round(avg(one * two), 6) AS paired FROM (SELECT qset, min(question_type) AS question_type, max(CASE WHEN option % 2 = 0 THEN correct ELSE 0 END) AS one, max(CASE WHEN option % 2 = 1 THEN correct ELSE 0 END) AS two FROM runs WHERE condition = 'plain' GROUP BY 1) GROUP BY 1", (D.RUNS_SQL,))
def paired_set_accuracy(spark, sf):
    items = D.runs(spark, sf).where("condition = 'plain'").withColumn("set", F.col("option") % 2 + 1)
    return U.paired_sets(items, "qset", "set", "question_type").withColumn("paired", r6(F.col("paired")))


# ---- geometry

@query(
    """SELECT count(*) AS n, round(sum(CASE WHEN u > 0 THEN i / u ELSE 0 END), 4) AS iou, round(sum(i / aa), 4) AS overlap, round(sum(CASE WHEN tu > 0 THEN ti::DOUBLE / tu ELSE 0 END), 4) AS span_iou, round(sum(CASE WHEN u > 0 AND tu > 0 THEN i / u * ti / tu ELSE 0 END), 4) AS st_iou, sum(greatest(0, u0 - t1, t0 - u1)) AS offset_sum FROM (
  SELECT *, aa + ba - i AS u, (t1 - t0 + 1) + (u1 - u0 + 1) - ti AS tu FROM (SELECT *, (ax1 - ax0) * (ay1 - ay0) AS aa, (bx1 - bx0) * (by1 - by0) AS ba,
    greatest(0.0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0.0, least(ay1, by1) - greatest(ay0, by0)) AS i, greatest(0, least(t1, u1) - greatest(t0, u0) + 1) AS ti FROM boxes))""",
    (D.BOXES_SQL,),
)
def box_and_span_overlap(spark, sf):
    b = D.boxes(spark, sf)
    i, s = G.iou("a", "b"), G.span_iou("t0", "t1", "u0", "u1")
    return b.agg(F.count("*").alias("n"), F.round(F.sum(i), 4).alias("iou"), F.round(F.sum(G.overlap_share("a", "b")), 4).alias("overlap"), F.round(F.sum(s), 4).alias("span_iou"), F.round(F.sum(i * s), 4).alias("st_iou"), F.sum(G.span_offset("t0", "t1", "u0", "u1")).alias("offset_sum"))


@query("SELECT item, round(min(ax0), 6) AS x0, round(min(ay0), 6) AS y0, round(max(ax1), 6) AS x1, round(max(ay1), 6) AS y1 FROM boxes GROUP BY 1", (D.BOXES_SQL,))
def union_box(spark, sf):
    u = D.boxes(spark, sf).groupBy("item").agg(R.union_box("a").alias("u"))
    return u.select("item", *[r6(F.col(f"u.{k}")).alias(k) for k in ("x0", "y0", "x1", "y1")])


_GRID = "[" + ", ".join(map(str, G.grid())) + "]"


@query(f"SELECT n, count(*) AS spans FROM (SELECT len(list_filter({_GRID}, lambda p: p BETWEEN t0 - 4 AND t1 + 4)) AS n FROM boxes) GROUP BY 1", (D.BOXES_SQL,))
def span_to_frames(spark, sf):
    n = F.size(G.frames_hit("t0", "t1")).cast("long").alias("n")
    return D.boxes(spark, sf).select(n).groupBy("n").agg(F.count("*").alias("spans"))


@query("SELECT f, count(*) AS spans FROM (SELECT CAST(least(15, greatest(0, round_even((t0 + t1) / 2.0 * 15 / 127, 0))) AS INTEGER) AS f FROM boxes) GROUP BY 1", (D.BOXES_SQL,))
def frame_of_span(spark, sf):
    return D.boxes(spark, sf).select(G.frame_of("t0", "t1").alias("f")).groupBy("f").agg(F.count("*").alias("spans"))


@query("SELECT item, round(sum(least(1.0, a)) / 128, 11) AS fraction FROM (SELECT item, f, sum(CASE WHEN f BETWEEN t0 AND t1 THEN (ax1 - ax0) * (ay1 - ay0) ELSE 0 END) AS a FROM boxes, range(128) r(f) GROUP BY 1, 2) GROUP BY 1", (D.BOXES_SQL,))
def masked_fraction(spark, sf):
    g = D.boxes(spark, sf).groupBy("item").agg(F.collect_list(F.struct("t0", "t1", F.col("a").alias("box"))).alias("regions"))
    # areas are ten-thousandths, of which 128ths have at most eleven decimals: there are no ties there
    return g.select("item", F.round(G.masked_fraction("regions"), 11).alias("fraction"))


@query(
    """SELECT item, line, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT item, line,
  CAST('0x' || substr(md5('0:' || item || ':' || line || ':' || l_partkey || ':' || l_suppkey || ':' || q || ':x'), 1, 12) AS BIGINT) / 281474976710656.0 * greatest(0.0, 1 - (ax1 - ax0)) AS x,
  CAST('0x' || substr(md5('0:' || item || ':' || line || ':' || l_partkey || ':' || l_suppkey || ':' || q || ':y'), 1, 12) AS BIGINT) / 281474976710656.0 * greatest(0.0, 1 - (ay1 - ay0)) AS y FROM boxes)""",
    (D.BOXES_SQL,),
)
def random_control(spark, sf):
    c = R.random_controls(D.boxes(spark, sf), ["item", "line", "l_partkey", "l_suppkey", "q"], "a")
    return c.select("item", "line", r6(F.col("control.x0")).alias("x"), r6(F.col("control.y0")).alias("y"))


def _draw(axis):
    return f"CAST('0x' || substr(md5('0:' || item || ':' || line || ':' || l_partkey || ':' || t || ':{axis}'), 1, 12) AS BIGINT) / 281474976710656.0"


@query(
    f"""SELECT item, line, round(s.met, 6) AS met, round(greatest(0.0, least(ax1, s.x + w) - greatest(ax0, s.x)) * greatest(0.0, least(ay1, s.y + h) - greatest(ay0, s.y)) / ((ax1 - ax0) * (ay1 - ay0)), 6) AS coverage FROM (
  SELECT item, line, l_partkey, l_suppkey, q, ax0, ay0, ax1, ay1, w, h, min({{'met': greatest(0.0, least(x + w, bx1) - greatest(x, bx0)) * greatest(0.0, least(y + h, by1) - greatest(y, by0)) / ((x + w - x) * (y + h - y)), 't': t, 'x': x, 'y': y}}) AS s FROM (
    SELECT *, {_draw('x')} * greatest(0.0, 1 - w) AS x, {_draw('y')} * greatest(0.0, 1 - h) AS y FROM (SELECT *, ax1 - ax0 AS w, ay1 - ay0 AS h FROM boxes), range(30) r(t)) GROUP BY ALL)""",
    (D.BOXES_SQL,),
)
def avoiding_control(spark, sf):
    b = D.boxes(spark, sf).withColumn("avoid", F.array("b"))
    c = R.avoiding_controls(b, ["item", "line", "l_partkey"], "avoid", "a")
    return c.select("item", "line", r6(G.overlap_share("control", "b")).alias("met"), r6(R.control_coverage(F.col("a"), F.array("control"))).alias("coverage"))


@query("SELECT video, phrase, frame, round(x0, 6) AS x0, round(x1, 6) AS x1 FROM tracks", (D.BOXES_SQL, D.TRACKS_SQL))
def entity_tracks(spark, sf):
    return D.tracks(spark, sf).select("video", "phrase", "frame", r6(F.col("box.x0")).alias("x0"), r6(F.col("box.x1")).alias("x1"))


@query("SELECT count(*) AS phrases, round(avg(n), 6) AS mean_frames, round(CAST(count(*) FILTER (n >= 8) AS DOUBLE) / count(*), 6) AS share_8 FROM (SELECT video, phrase, count(*) AS n FROM tracks GROUP BY 1, 2)", (D.BOXES_SQL, D.TRACKS_SQL))
def track_summary(spark, sf):
    s = R.track_summary(D.tracks(spark, sf))
    return s.select("phrases", r6(F.col("mean_frames")).alias("mean_frames"), r6(F.col("share_8")).alias("share_8"))


@query(
    """SELECT video, phrase, frame, found_frame, round(x0, 6) AS x0 FROM (SELECT w.*, t.frame AS found_frame, t.x0, row_number() OVER (PARTITION BY w.video, w.phrase, w.frame ORDER BY abs(t.frame - w.frame), t.frame) AS r
  FROM (SELECT video, phrase, f AS frame FROM (SELECT DISTINCT video, phrase FROM tracks), (VALUES (1), (6), (11), (14)) v(f)) w JOIN tracks t ON t.video = w.video AND t.phrase = w.phrase AND abs(t.frame - w.frame) <= 3) WHERE r = 1""",
    (D.BOXES_SQL, D.TRACKS_SQL),
)
def nearest_detection(spark, sf):
    t = D.tracks(spark, sf)
    wanted = t.select("video", "phrase").distinct().select("*", F.explode(F.array(*[F.lit(f) for f in (1, 6, 11, 14)])).alias("frame"))
    return R.nearest_detection(wanted, t, ["video", "phrase"]).select("video", "phrase", "frame", "found_frame", r6(F.col("box.x0")).alias("x0"))


@query(
    """SELECT item, count(*) AS n, round(sum(iou), 4) AS iou FROM (SELECT b.item, CASE WHEN u > 0 THEN i / u ELSE 0 END AS iou, i, u, b.* EXCLUDE item, t.* EXCLUDE (video, frame) FROM (SELECT *, item % 100 AS video, l_suppkey % 16 AS frame FROM boxes) b JOIN tracks t USING (video, frame),
  LATERAL (SELECT greatest(0.0, least(ax1, x1) - greatest(ax0, x0)) * greatest(0.0, least(ay1, y1) - greatest(ay0, y0)) AS i), LATERAL (SELECT (ax1 - ax0) * (ay1 - ay0) + (x1 - x0) * (y1 - y0) - i AS u))
  WHERE iou >= 0.3 OR (x0 >= ax0 - 0.01 AND y0 >= ay0 - 0.01 AND x1 <= ax1 + 0.01 AND y1 <= ay1 + 0.01) OR (ax0 >= x0 - 0.01 AND ay0 >= y0 - 0.01 AND ax1 <= x1 + 0.01 AND ay1 <= y1 + 0.01) GROUP BY 1""",
    (D.BOXES_SQL, D.TRACKS_SQL),
)
def evidence_object_match(spark, sf):
    e = D.boxes(spark, sf).select("item", (F.col("item") % 100).alias("video"), (F.col("l_suppkey") % 16).cast("int").alias("frame"), F.col("a").alias("box"))
    m = R.matched_objects(e, D.tracks(spark, sf), ["video", "frame"])
    return m.groupBy("item").agg(F.count("*").alias("n"), F.round(F.sum(G.iou("box", "found_box")), 4).alias("iou"))


# ---- chains

def _parsed(spark, sf):
    return C.parse(D.chain_texts(spark, sf))


def _kept_chains(spark, sf):
    """(k, chain) of every text that holds one, for both sides of a join: texts are made and parsed once."""
    return kept(_parsed(spark, sf).where("parsed.chain is not null").select("k", F.col("parsed.chain").alias("chain")), "chains")


_OK = "k % 10 NOT IN (8, 9)"


@query(f"SELECT k, count(*) AS n, sum(t0) AS t0, sum(t1) AS t1, round(sum(x0 + y0 * 2 + x1 * 3 + y1 * 5), 6) AS boxes, string_agg(answer, ',' ORDER BY j) AS answers, string_agg(coalesce(CAST(dep AS VARCHAR), ''), ';' ORDER BY j) AS deps FROM steps WHERE {_OK} GROUP BY 1", (D.STEPS_SQL,))
def chain_parse(spark, sf):
    p = _parsed(spark, sf).where("parsed.chain is not null").select("k", F.posexplode("parsed.chain").alias("j", "s"))
    b = F.col("s.box")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("j", c.alias("v")))), lambda x: x["v"])
    return p.groupBy("k").agg(F.count("*").alias("n"), F.sum("s.t0").alias("t0"), F.sum("s.t1").alias("t1"), r6(F.sum(b["x0"] + b["y0"] * 2 + b["x1"] * 3 + b["y1"] * 5)).alias("boxes"), F.array_join(ordered(F.col("s.answer")), ",").alias("answers"), F.array_join(ordered(F.array_join(F.transform("s.deps", lambda d: d.cast("string")), ",")), ";").alias("deps"))


@query("SELECT CASE WHEN o_orderkey % 10 NOT IN (8, 9) THEN 1.0 ELSE CASE WHEN o_orderkey % 10 = 9 THEN 0.0 ELSE 0.2 END END AS score, count(*) AS n, sum(o_orderkey % 3 + 2) AS lines, sum(CASE WHEN o_orderkey % 10 = 8 THEN 1 ELSE o_orderkey % 3 + 1 END) AS steps FROM orders GROUP BY 1")
def chain_format_rate(spark, sf):
    p = _parsed(spark, sf)
    return p.groupBy(W.format_chain("parsed").alias("score")).agg(F.count("*").alias("n"), F.sum("parsed.n_lines").alias("lines"), F.sum("parsed.n_steps").alias("steps"))


@query("SELECT o_orderkey AS k, true AS same FROM orders WHERE o_orderkey % 10 NOT IN (8, 9)")
def chain_render(spark, sf):
    again = _parsed(spark, sf).where("parsed.chain is not null").select("k", F.col("parsed").alias("one"), C.render("parsed.chain", "parsed.answer").alias("raw"))
    return C.parse(again).select("k", (F.col("parsed.chain") == F.col("one.chain")).alias("same"))


@query(f"SELECT entity, count(*) AS n, count(DISTINCT k) AS chains FROM steps WHERE {_OK} GROUP BY 1", (D.STEPS_SQL,))
def entity_extract(spark, sf):
    s = _parsed(spark, sf).select("k", F.explode("parsed.chain").alias("s")).select("k", F.lower(T.entity_of("s.question")).alias("entity"))
    return s.groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("k").alias("chains"))


@query(f"SELECT k, CASE WHEN k % 2 = 0 THEN n - 1 ELSE 0 END AS after_first, CASE WHEN k % 2 = 0 THEN n - 1 ELSE 0 END AS before_last, CASE WHEN k % 2 = 0 THEN 0 ELSE n - 1 END AS left_over FROM (SELECT k, count(*) AS n FROM steps WHERE {_OK} GROUP BY 1)", (D.STEPS_SQL,))
def dag_closure(spark, sf):
    p = _parsed(spark, sf).where("parsed.chain is not null").select("k", F.col("parsed.chain").alias("chain")).withColumn("deps", F.transform("chain", lambda s: s["deps"]))
    last = F.size("deps") - 1
    return p.select("k", F.size(C.closure("deps", 0)).cast("long").alias("after_first"), F.size(C.ancestors("deps", last)).cast("long").alias("before_last"), F.size(C.without_step("chain", "deps", 0)).cast("long").alias("left_over"))


@query(f"SELECT c, count(DISTINCT {{'a': t0, 'b': t1, 'c': x0, 'd': y0, 'e': x1, 'f': y1}}) AS n, min(t0) AS first_t0 FROM steps WHERE {_OK} GROUP BY 1", (D.STEPS_SQL,))
def cited_regions(spark, sf):
    r = _parsed(spark, sf).select("c", F.explode(C.regions("parsed.chain")).alias("r"))
    return r.groupBy("c").agg(F.countDistinct("r").alias("n"), F.min("r.t0").alias("first_t0"))


@query(f"SELECT k, count(*) AS n FROM steps WHERE {_OK} AND j = k % 3 + 1 GROUP BY 1", (D.STEPS_SQL,))
def decisive_steps(spark, sf):
    return _parsed(spark, sf).where("parsed.chain is not null").select("k", F.size(C.decisive("parsed.chain", F.lit("descriptive"))).cast("long").alias("n"))


@query(
    f"""SELECT s.k, round(avg(best), 6) AS grounding FROM (SELECT s.k, s.j, max(CASE WHEN u > 0 THEN i / u ELSE 0 END * CASE WHEN tu > 0 THEN ti::DOUBLE / tu ELSE 0 END) AS best FROM (SELECT * FROM steps WHERE {_OK}) s JOIN boxes b ON b.item = s.k,
  LATERAL (SELECT greatest(0.0, least(s.x1, ax1) - greatest(s.x0, ax0)) * greatest(0.0, least(s.y1, ay1) - greatest(s.y0, ay0)) AS i, greatest(0, least(s.t1, b.t1) - greatest(s.t0, b.t0) + 1) AS ti),
  LATERAL (SELECT (s.x1 - s.x0) * (s.y1 - s.y0) + (ax1 - ax0) * (ay1 - ay0) - i AS u, (s.t1 - s.t0 + 1) + (b.t1 - b.t0 + 1) - ti AS tu) GROUP BY 1, 2) s GROUP BY 1""",
    (D.STEPS_SQL, D.BOXES_SQL),
)
def best_iou_per_step(spark, sf):
    chains = _parsed(spark, sf).where("parsed.chain is not null").select("k", F.col("parsed.chain").alias("chain"))
    regions = D.boxes(spark, sf).groupBy(F.col("item").alias("k")).agg(F.collect_list(F.struct(F.col("t0"), F.col("t1"), F.col("a").alias("box"))).alias("regions"))
    return chains.join(dealt(regions), "k").select("k", r6(W.grounding("chain", "regions")).alias("grounding"))


@query()
def process_reward(spark, sf):
    p = _kept_chains(spark, sf)
    pairs = p.join(dealt(p.select((F.col("k") + 12).alias("k"), F.col("chain").alias("ref"))), "k")
    return W.process(pairs, "chain", "ref").select("k", r6(F.col("process")).alias("process"))


@query(
    f"""SELECT s.k AS id, CASE WHEN bool_and(coalesce(CASE WHEN u > 0 THEN i / u ELSE 0 END >= 0.5, false)) THEN 'all' ELSE 'not_all' END AS status FROM (SELECT *, k % 100 AS video, CAST(least(15, greatest(0, round_even((t0 + t1) / 2.0 * 15 / 127, 0))) AS INTEGER) AS frame FROM steps WHERE {_OK}) s
  LEFT JOIN tracks t ON t.video = s.video AND t.phrase = s.entity AND t.frame = s.frame, LATERAL (SELECT greatest(0.0, least(s.x1, t.x1) - greatest(s.x0, t.x0)) * greatest(0.0, least(s.y1, t.y1) - greatest(s.y0, t.y0)) AS i), LATERAL (SELECT (s.x1 - s.x0) * (s.y1 - s.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - i AS u) GROUP BY 1""",
    (D.STEPS_SQL, D.BOXES_SQL, D.TRACKS_SQL),
)
def hit_status(spark, sf):
    return R.hit_status(_cited(spark, sf), D.tracks(spark, sf))


def _cited(spark, sf):
    s = _parsed(spark, sf).select(F.col("k").alias("id"), F.explode("parsed.chain").alias("s"))
    return s.select("id", (F.col("id") % 100).alias("video"), F.lower(T.entity_of("s.question")).alias("entity"), G.frame_of("s.t0", "s.t1").alias("frame"), F.col("s.box").alias("box"))


@query(
    f"""SELECT count(*) AS steps, round(CAST(count(t.x0) AS DOUBLE) / count(*), 6) AS detected_rate, count(DISTINCT {{'v': s.video, 'f': s.frame, 'e': s.entity}}) AS detector_calls FROM (SELECT *, k % 100 AS video, CAST(least(15, greatest(0, round_even((t0 + t1) / 2.0 * 15 / 127, 0))) AS INTEGER) AS frame FROM steps WHERE {_OK}) s
  LEFT JOIN tracks t ON t.video = s.video AND t.phrase = s.entity AND t.frame = s.frame""",
    (D.STEPS_SQL, D.BOXES_SQL, D.TRACKS_SQL),
)
def citation_grounding_report(spark, sf):
    r = R.citation_report(_cited(spark, sf), D.tracks(spark, sf))
    return r.select("steps", r6(F.col("detected_rate")).alias("detected_rate"), "detector_calls")


# ---- text

_NORM = "trim(regexp_replace(regexp_replace(lower(trim(text)), '^(answer|the answer is|it is|it''s|there are|there is)[:\\s]+', ''), '[^a-z0-9 ]+', ' ', 'g'))"


@query(f"SELECT token, count(*) AS n FROM (SELECT CASE split_part({_NORM}, ' ', 1) " + " ".join(f"WHEN '{w}' THEN '{i}'" for i, w in enumerate(T.NUMBER_WORDS)) + f" ELSE split_part({_NORM}, ' ', 1) END AS token FROM conversations) GROUP BY 1")
def normalize_answer(spark, sf):
    return D.table(spark, sf, "conversations").select(T.normalize_short("text").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


#: Letters that stand alone, where nothing follows a letter of them; else those of a text of letters, commas and blanks; none if it says so and no capital stands alone as a word.
_LETTERS = """SELECT letters, count(*) AS n FROM (SELECT CASE WHEN none THEN '' WHEN alone <> '' THEN alone WHEN regexp_full_match(packed, '[A-H]+') THEN coalesce(array_to_string(list_sort(list_filter(list_distinct(string_split(packed, '')), lambda c: c BETWEEN 'A' AND 'E')), ''), '') ELSE '' END AS letters FROM (
  SELECT regexp_matches(t, '(?i)(^|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}])none($|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}])') AND NOT regexp_matches(t, '(^|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}])[A-H]($|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}])') AS none,
         array_to_string(list_sort(list_filter(list_distinct(string_split(regexp_replace(upper(t), '[^A-Z]+', ' ', 'g'), ' ')), lambda w: w IN ('A', 'B', 'C', 'D', 'E'))), '') AS alone, replace(replace(upper(t), ',', ''), ' ', '') AS packed
  FROM (SELECT trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents WHERE text IS NOT NULL))) GROUP BY 1"""


def _letters(spark, sf):
    d = D.table(spark, sf, "documents").where("text is not null")
    return d.select(T.parse_letters("text", 5).alias("letters")).groupBy("letters").agg(F.count("*").alias("n"))


@query(_LETTERS)
def parse_option_letters(spark, sf):
    """Letters of every whole text, those of the none and compact branches too."""
    return _letters(spark, sf)


@query(_LETTERS)
def parse_option_letters_whole(spark, sf):
    return _letters(spark, sf)


@query(
    """SELECT role, count(*) AS n, round(sum(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0 END), 6) AS total FROM (
  SELECT x.role, list_distinct(list_filter(regexp_extract_all(lower(x.text), '[a-z0-9]+'), lambda w: NOT w IN ('the', 'a', 'an', 'at', 'of', 'and', 'frame'))) AS a, list_distinct(list_filter(regexp_extract_all(lower(y.text), '[a-z0-9]+'), lambda w: NOT w IN ('the', 'a', 'an', 'at', 'of', 'and', 'frame'))) AS b
  FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1) GROUP BY 1"""
)
def answer_jaccard(spark, sf):
    c = D.table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(nxt, ["conv_id", "turn"]).groupBy("role").agg(F.count("*").alias("n"), r6(F.sum(T.jaccard("text", "other"))).alias("total"))


@query("SELECT quality, count(*) AS n, round(avg(CASE WHEN lower(trim(CASE WHEN n_chars > 500 THEN ' Yes' ELSE 'no ' END)) = CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END THEN 1.0 ELSE 0.0 END), 6) AS outcome FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def outcome_scores(spark, sf):
    d = D.table(spark, sf, "labels").join(D.table(spark, sf, "documents"), "doc_id")
    d = d.select("quality", F.concat(F.lit("<think>x</think><answer>"), F.when(F.col("n_chars") > 500, " Yes").otherwise("no "), F.lit("</answer>")).alias("raw"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("gold"))
    score = W.outcome("raw", F.lit("open"), F.lit("exist"), "gold", 0)
    return d.groupBy("quality").agg(F.count("*").alias("n"), r6(F.avg(score)).alias("outcome"))


@query("SELECT user_id, round(CASE WHEN n > 0 THEN CAST(hi AS DOUBLE) / n - 0.5 * lo / n ELSE 0 END, 6) AS necessity FROM (SELECT user_id, count(*) AS n, count(*) FILTER (value > 60) AS hi, count(*) FILTER (value <= 5) AS lo FROM events GROUP BY 1)")
def necessity_score(spark, sf):
    return W.necessity_by(D.table(spark, sf, "events"), ["user_id"], "value", 60.0, 5.0, 0.5).withColumn("necessity", r6(F.col("necessity")))


@query("SELECT event_id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def group_advantage(spark, sf):
    return W.group_advantage(D.table(spark, sf, "events"), "user_id", "value").select("event_id", r6(F.col("advantage")).alias("advantage"))


# ---- scenes

def _collisions(spark, sf):
    v = D.visible(spark, sf)
    pairs = v.alias("x").join(v.alias("y"), ["scene", "frame"]).where("x.obj < y.obj").select("scene", F.col("x.obj").alias("a"), F.col("y.obj").alias("b"), "frame")
    # recorded a few frames before: most have to be moved
    return pairs.select("scene", "a", "b", (F.col("frame") - F.col("a") % 2 * 3).alias("frame")).where("frame >= 0").distinct(), v


_CHANGES = """changes AS (SELECT scene, 'in' AS type, frame, obj FROM v WHERE frame > 0 AND (p IS NULL OR p < frame - 1) UNION ALL SELECT scene, 'out', frame + 1, obj FROM v WHERE frame < 127 AND (n IS NULL OR n > frame + 1))"""
_V = "v AS (SELECT *, lag(frame) OVER w AS p, lead(frame) OVER w AS n FROM visible WINDOW w AS (PARTITION BY scene, obj ORDER BY frame))"
_HITS = """pairs AS (SELECT DISTINCT x.scene, x.obj AS a, y.obj AS b, x.frame - x.obj % 2 * 3 AS frame FROM visible x JOIN visible y ON x.scene = y.scene AND x.frame = y.frame AND x.obj < y.obj WHERE x.frame - x.obj % 2 * 3 >= 0),
hits AS (SELECT p.scene, p.a, p.b, p.frame, min(x.frame) AS moved FROM pairs p JOIN visible x ON x.scene = p.scene AND x.obj = p.a AND x.frame >= p.frame JOIN visible y ON y.scene = p.scene AND y.obj = p.b AND y.frame = x.frame
  WHERE EXISTS (SELECT 1 FROM visible z WHERE z.scene = p.scene AND z.frame = p.frame AND z.obj IN (p.a, p.b)) GROUP BY 1, 2, 3, 4)"""


@query("SELECT scene, type, frame, obj FROM changes", (D.VISIBLE_SQL, _V, _CHANGES))
def visibility_events(spark, sf):
    return S.changes(D.visible(spark, sf)).select("scene", "type", "frame", F.get("objects", 0).alias("obj"))


@query("SELECT scene, a, b, CAST(frame AS INTEGER) AS frame, moved FROM hits", (D.VISIBLE_SQL, _HITS))
def collision_retiming(spark, sf):
    return S.retimed_collisions(*_collisions(spark, sf)).select("scene", "a", "b", F.col("frame").cast("int").alias("frame"), "moved")


@query("SELECT scene, obj, min(frame) AS first_frame, max(frame) AS last_frame FROM visible GROUP BY 1, 2", (D.VISIBLE_SQL,))
def first_last_visible(spark, sf):
    return D.visible(spark, sf).groupBy("scene", "obj").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


_EVENTS = """evs AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY frame, kind, objects, type) AS ord FROM (
  SELECT scene, type, frame, [obj] AS objects, 1 AS kind FROM changes WHERE frame <= 127 UNION ALL SELECT scene, 'collision', moved, [a, b], 2 FROM hits
  UNION ALL SELECT scene, 'start', 0, CAST([] AS INTEGER[]), 0 FROM (SELECT DISTINCT scene FROM visible) UNION ALL SELECT scene, 'end', 127, CAST([] AS INTEGER[]), 0 FROM (SELECT DISTINCT scene FROM visible)))"""


def _events(spark, sf):
    pairs, v = _collisions(spark, sf)
    return S.events(v, S.retimed_collisions(pairs, v))


_SCENE = (D.VISIBLE_SQL, _V, _CHANGES, _HITS, _EVENTS)


@query("SELECT scene, type, CAST(count(*) AS BIGINT) AS n, sum(ord * frame) AS sig FROM evs GROUP BY 1, 2", _SCENE)
def scene_events(spark, sf):
    return _events(spark, sf).groupBy("scene", "type").agg(F.count("*").alias("n"), F.sum(F.col("ord").cast("long") * F.col("frame")).alias("sig"))


@query("SELECT scene, frame, list_aggregate(objects, 'string_agg', ',') AS objects, ord FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY frame, ord) AS r FROM evs WHERE type = 'collision') WHERE r = 2", _SCENE)
def program_filter_order(spark, sf):
    e = _events(spark, sf)
    return S.filter_order(e.where("type = 'collision'"), "second").select("scene", "frame", F.array_join(F.transform("objects", lambda o: o.cast("string")), ",").alias("objects"), "ord")


@query("SELECT s.scene, count(e.ord) AS answer FROM (SELECT DISTINCT scene FROM visible) s LEFT JOIN (SELECT e.scene, e.ord FROM evs e JOIN (SELECT scene, min(frame) AS f FROM evs WHERE type = 'out' GROUP BY 1) o ON e.scene = o.scene AND e.frame > o.f WHERE e.type = 'collision' AND EXISTS (SELECT 1 FROM objects b WHERE b.scene = e.scene AND b.color = 'red' AND list_contains(e.objects, b.obj))) e USING (scene) GROUP BY 1", (D.VISIBLE_SQL, D.OBJECTS_SQL, *_SCENE[1:]))
def program_count_after(spark, sf):
    """How many collisions with a red object come after the first exit?"""
    e, objs = _events(spark, sf), D.scene_objects(spark, sf)
    scenes = objs.select("scene").distinct()
    first = S.filter_order(e.where("type = 'out'"), "first")
    return S.count(S.filter_after(S.filter_event(e, "collision", S.filter_attr(objs, color="red")), first), scenes)


@query("SELECT s.scene, coalesce(CAST(a.shape AS VARCHAR), 'error') AS answer FROM (SELECT DISTINCT scene FROM objects) s LEFT JOIN (SELECT scene, min(shape) AS shape FROM objects WHERE color = 'blue' AND material = 'metal' GROUP BY 1 HAVING count(*) = 1) a USING (scene)", (D.VISIBLE_SQL, D.OBJECTS_SQL))
def program_query_unique(spark, sf):
    """What is the shape of the blue metal object?"""
    objs = D.scene_objects(spark, sf)
    answer = S.query_attr(S.unique(S.filter_attr(objs, color="blue", material="metal")), "shape")
    return S.missing(objs.select("scene").distinct(), answer)


@query("SELECT s.scene, CASE WHEN count(o.obj) > 0 THEN 'no' ELSE 'yes' END AS answer FROM (SELECT DISTINCT scene FROM objects) s LEFT JOIN (SELECT * FROM objects WHERE shape = 'sphere') o USING (scene) GROUP BY 1", (D.VISIBLE_SQL, D.OBJECTS_SQL))
def program_exist_negate(spark, sf):
    objs = D.scene_objects(spark, sf)
    return S.negate(S.exist(S.filter_attr(objs, shape="sphere"), objs.select("scene").distinct()))


@query(
    """SELECT scene, count(*) AS n FROM (WITH RECURSIVE step AS (SELECT DISTINCT scene, ord, lag(ord) OVER (PARTITION BY scene, obj ORDER BY frame, ord) AS cause FROM (SELECT scene, ord, frame, unnest(objects) AS obj FROM evs)),
  up(scene, ord, cause) AS (SELECT * FROM (SELECT s.scene, s.ord, s.cause FROM step s JOIN (SELECT scene, max(ord) AS m FROM evs WHERE type = 'collision' GROUP BY 1) l ON s.scene = l.scene AND s.ord = l.m WHERE cause IS NOT NULL) UNION SELECT u.scene, u.ord, s.cause FROM up u JOIN step s ON s.scene = u.scene AND s.ord = u.cause WHERE s.cause IS NOT NULL) SELECT * FROM up) GROUP BY 1""",
    _SCENE,
)
def causal_ancestors(spark, sf):
    """Number of events that led to the last collision of each scene."""
    e = _events(spark, sf)
    w = e.where("type = 'collision'")
    return S.filter_ancestor(e, S.filter_order(w, "last"), e).groupBy("scene").agg(F.count("*").alias("n"))


# ---- curation

@query("SELECT question_type, count(*) AS items, count(DISTINCT qset) AS questions, sum(id) AS ids FROM (SELECT * FROM runs WHERE condition = 'plain' AND qset IN (SELECT qset FROM (SELECT qset, row_number() OVER (PARTITION BY kind ORDER BY md5('0:' || qset), qset) AS r FROM (SELECT qset, min(question_type) AS kind FROM runs WHERE condition = 'plain' GROUP BY 1)) WHERE r <= 20)) GROUP BY 1", (D.RUNS_SQL,))
def stratified_questions(spark, sf):
    s = U.stratified_questions(D.runs(spark, sf).where("condition = 'plain'"), 20)
    return s.groupBy("question_type").agg(F.count("*").alias("items"), F.countDistinct("qset").alias("questions"), F.sum("id").alias("ids"))


@query("SELECT question_type, gold, count(*) AS n, sum(id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY question_type, gold ORDER BY md5('3:' || id), id) AS r FROM runs WHERE condition = 'plain') WHERE r <= CASE gold WHEN 'yes' THEN 50 ELSE 70 END GROUP BY 1, 2", (D.RUNS_SQL,))
def balanced_options(spark, sf):
    b = U.balanced_options(D.runs(spark, sf).where("condition = 'plain'"), {"yes": 50, "no": 70}, "question_type", "gold", "id", seed=3)
    return b.groupBy("question_type", "gold").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT p_partkey, d + CASE WHEN d >= p_partkey % 5 THEN 1 ELSE 0 END AS wrong FROM (SELECT p_partkey, CAST('0x' || substr(md5('0:' || p_partkey), 1, 12) AS BIGINT) % 4 AS d FROM part)")
def one_wrong_option(spark, sf):
    return D.table(spark, sf, "part").select("p_partkey", U.one_wrong_option(5, F.col("p_partkey") % 5, "p_partkey").alias("wrong"))


@query("SELECT origin, count(*) AS n, min(place_key) AS first_key FROM (SELECT 'c' AS origin, md5('1:c:' || c_custkey) AS place_key FROM customer UNION ALL SELECT 's', md5('1:s:' || s_suppkey) FROM supplier) GROUP BY 1")
def mix_sources(spark, sf):
    c, s = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return U.mix({"c": c, "s": s}, seed=1).groupBy("origin").agg(F.count("*").alias("n"), F.min("place_key").alias("first_key"))


@query("SELECT p_partkey || '_' || o AS item_id, CASE WHEN o = p_partkey % 3 THEN 'yes' ELSE 'no' END AS gold, ['a', 'b', 'c'][o + 1] AS option_text FROM part, (VALUES (0), (1), (2)) v(o)")
def option_explode(spark, sf):
    q = D.table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), F.array(*map(F.lit, "abc")).alias("options"), (F.col("p_partkey") % 3).alias("right"))
    return U.explode_options(q).select("item_id", "gold", "option_text")


@query("SELECT o_custkey AS k, count(*) AS n, min(o_orderkey) AS first_chain FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 0, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def attach_chains(spark, sf):
    records = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).union(D.table(spark, sf, "orders").select("o_custkey")).distinct()
    chains = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), "o_orderstatus")
    a = U.attach_chains(records, chains, "k", "at")
    return a.select("k", F.size("chains").cast("long").alias("n"), F.get("chains", 0)["at"].alias("first_chain"))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def resume_remaining(spark, sf):
    e = D.table(spark, sf, "events").select("event_id")
    return U.remaining(e, e.where("event_id % 3 = 0"), "event_id")


@query("SELECT key, count(*) AS n, round(avg(CASE WHEN value = 'yes' THEN 1.0 ELSE 0 END), 6) AS yes, round(avg(CASE WHEN value = 'unsure' THEN 1.0 ELSE 0 END), 6) AS unsure FROM (SELECT unnest(['visible', 'onbox']) AS key, unnest([CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END, CASE WHEN toxic = 1 THEN 'unsure' ELSE 'yes' END]) AS value FROM labels) GROUP BY 1")
def audit_rates(spark, sf):
    la = D.table(spark, sf, "labels")
    names = la.select(F.explode(F.array(F.struct(F.concat(F.lit("c"), "doc_id", F.lit("_s1_visible")).alias("name"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("value")), F.struct(F.concat(F.lit("c"), "doc_id", F.lit("_s1_onbox")).alias("name"), F.when(F.col("toxic") == 1, "unsure").otherwise("yes").alias("value")))).alias("j")).select("j.*")
    return U.audit_rates(names).select("key", "n", r6(F.col("yes")).alias("yes"), r6(F.col("unsure")).alias("unsure"))


@query("SELECT event_id // 100 AS \"window\", count(*) AS n, round(avg(value), 6) AS reward, round(coalesce(avg(value / 2) FILTER (event_id % 7 <> 0), 0), 6) AS kl, round((max(event_id) - min(event_id)) * 1.5 / (count(*) - 1), 6) AS sec_per_step FROM events GROUP BY 1")
def train_log_windows(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("event_id").alias("step"), (F.col("event_id") * 1.5).alias("sec"), F.col("value").alias("reward"), (F.col("value") / 2).alias("kl"), (F.col("event_id") % 7 == 0).alias("skipped"))
    return U.log_windows(e, 100).select("window", "n", *[r6(F.col(c)).alias(c) for c in ("reward", "kl", "sec_per_step")])


@query("SELECT 'k' AS key, count(*) AS n, count(*) AS n_number, min(v) AS low, max(v) AS high, count(DISTINCT v) AS kinds FROM (SELECT CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events)")
def json_profile(spark, sf):
    return U.profile_json(D.table(spark, sf, "events"), "props")


@query("SELECT p_partkey, CAST(p_partkey % 40 // 10 AS BIGINT) AS x0, CAST((p_partkey % 40 + p_partkey % 13) // 10 + 1 AS BIGINT) AS x1 FROM part")
def rle_boxes(spark, sf):
    k = F.col("p_partkey")
    p = D.table(spark, sf, "part").select("p_partkey", F.array(k % 40, k % 13 + 1, F.lit(60).cast("long")).alias("counts"))
    b = p.select("p_partkey", rle.runs_to_box("counts", F.lit(10)).alias("b"))
    return b.select("p_partkey", "b.x0", "b.x1")


@query("SELECT CAST(ts AS DATE) AS day, event_type AS question_type, count(*) AS n, round(avg(event_id % 3 % 2), 6) AS accuracy FROM events GROUP BY 1, 2")
def stream_running_accuracy(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("question_type"), (F.col("event_id") % 3 % 2).alias("correct"))
    r = running_accuracy(e.withColumn("ts", F.col("ts").cast("timestamp")))
    return r.select(F.to_date("start").alias("day"), "question_type", "n", r6(F.col("accuracy")).alias("accuracy"))
