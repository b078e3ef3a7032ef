"""Views over the star-schema tables in the shapes the operators read: runs, boxes, chains, scenes, tracks, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.functions.geometry import box

CONDITIONS = ["plain", "blind", "mask_evidence", "mask_random", "mask_track", "mask_track_random", "mask_cite", "mask_cite_random", "mask_cite_track", "mask_cite_track_random"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each condition and item: id, qset, option, question_type, video, gold, correct, fraction."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    conditions = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(k).alias("k")) for k, c in enumerate(CONDITIONS)])
    r = e.select("*", F.explode(conditions).alias("c")).select("event_id", "event_type", "user_id", "value", "c.condition", "c.k")
    q = F.expr("event_id div 5")
    r = r.select(F.col("event_id").alias("id"), q.alias("qset"), (F.col("event_id") % 5).alias("option"), F.col("event_type").alias("question_type"), F.col("user_id").alias("video"), "condition", "k", F.when(F.col("event_id") % 5 == q % 5, "yes").otherwise("no").alias("gold"))
    r = r.withColumn("correct", ((F.col("id") * (7 + F.col("k")) + F.col("qset") * (3 + F.col("k"))) % 11 < 8 - F.col("k") % 4).cast("int"))
    r = r.withColumn("fraction", (F.col("id") % 17) / F.lit(20.0))
    absent = (F.col("condition").startswith("mask_track") & (F.col("id") % 7 == 0)) | (F.col("condition").isin("mask_cite", "mask_cite_random") & (F.col("id") % 3 == 0)) | (F.col("condition").startswith("mask_cite_track") & (F.col("id") % 5 == 1))
    return r.where(~absent).drop("k")


RUNS_SQL = """runs AS (
  SELECT id, qset, option, question_type, video, condition, gold,
         CASE WHEN (id * (7 + k) + qset * (3 + k)) % 11 < 8 - k % 4 THEN 1 ELSE 0 END AS correct, (id % 17) / 20.0 AS fraction
  FROM (SELECT event_id AS id, event_id // 5 AS qset, event_id % 5 AS option, event_type AS question_type, user_id AS video,
               CASE WHEN event_id % 5 = (event_id // 5) % 5 THEN 'yes' ELSE 'no' END AS gold, c.condition, c.k
        FROM events, (VALUES """ + ", ".join(f"('{c}', {k})" for k, c in enumerate(CONDITIONS)) + """) c(condition, k))
  WHERE NOT ((condition LIKE 'mask_track%' AND id % 7 = 0) OR (condition IN ('mask_cite', 'mask_cite_random') AND id % 3 = 0)
          OR (condition LIKE 'mask_cite_track%' AND id % 5 = 1)))"""


def boxes(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """A region for each distinct line: item, partner box, spans; not ``once``: for each line, for what equal lines do not change."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    li = li.distinct() if once else li
    x, y = (F.col("l_partkey") % 60) / F.lit(100.0), (F.col("l_suppkey") % 60) / F.lit(100.0)
    w, h = (F.col("q") % 19 + 20) / F.lit(100.0), (F.col("l_linenumber") * 5 + 4) / F.lit(100.0)
    x2, y2 = (F.col("l_suppkey") * 7 % 60) / F.lit(100.0), (F.col("l_partkey") * 3 % 60) / F.lit(100.0)
    t0, u0 = F.col("l_suppkey") % 100, F.col("l_partkey") % 100
    return li.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", "q", t0.alias("t0"), (t0 + F.col("q") % 28).alias("t1"), u0.alias("u0"), (u0 + F.col("q") % 20).alias("u1"), box(x, y, x + w, y + h).alias("a"), box(x2, y2, x2 + F.lit(0.25), y2 + F.lit(0.3)).alias("b"))


BOXES_SQL = """boxes AS (
  SELECT l_orderkey AS item, l_linenumber AS line, l_partkey, l_suppkey, q, l_suppkey % 100 AS t0, l_suppkey % 100 + q % 28 AS t1,
         l_partkey % 100 AS u0, l_partkey % 100 + q % 20 AS u1,
         (l_partkey % 60) / 100.0 AS ax0, (l_suppkey % 60) / 100.0 AS ay0,
         (l_partkey % 60) / 100.0 + (q % 19 + 20) / 100.0 AS ax1, (l_suppkey % 60) / 100.0 + (l_linenumber * 5 + 4) / 100.0 AS ay1,
         (l_suppkey * 7 % 60) / 100.0 AS bx0, (l_partkey * 3 % 60) / 100.0 AS by0,
         (l_suppkey * 7 % 60) / 100.0 + 0.25 AS bx1, (l_partkey * 3 % 60) / 100.0 + 0.3 AS by1
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem))"""

_ENTITIES = ["the red ball", "2: white dog: the white dog", "Man in blue", "a tall tree"]


def chain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain's text for each order, one in ten without an answer, one in ten with an unreadable number."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    # a key is a small row and a lot of work: a stated number of parts, so that a small file is no single task
    o = o.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k")
    k = F.col("k")
    number = lambda v: F.concat(F.lit("0."), F.lpad(v.cast("string"), 2, "0"), F.lit("0"))
    names = F.array(*[F.lit(e) for e in _ENTITIES])

    def step(j):
        t0 = (k * 7 + j * 13) % 100
        x0, y0 = (k * 3 + j * 11) % 50, (k * 5 + j * 3) % 50
        x1, y1 = x0 + k % 40 + 5, y0 + j * 7 + 6
        x1 = F.when(k % 10 == 8, F.lit("1.2.3")).otherwise(number(x1)) if j == 1 else number(x1)
        deps = F.when(k % 2 == 0, str(j - 1)).otherwise("") if j > 1 else F.lit("")
        return F.concat(F.lit(f"[{j}] Q: Where is "), F.get(names, ((k + j) % 4).cast("int")), F.lit("? | A: a"), (k * j % 7).cast("string"), F.lit(" | E: t="), t0.cast("string"), F.lit("-"), (t0 + k % 9).cast("string"), F.lit(" box=("), F.concat_ws(",", number(x0), number(y0), x1, number(y1)), F.lit(") | deps="), deps)

    # one to three steps, each a plain expression: a function over a list of numbers would not be compiled
    lines = F.when(k.isNotNull(), F.concat_ws("\n", step(1), F.when(k % 3 >= 1, step(2)), F.when(k % 3 >= 2, step(3))))
    answer = F.when(k % 10 == 9, "").otherwise(F.concat(F.lit("\n<answer> "), F.when(k % 2 == 0, "Yes").otherwise("no"), F.lit("</answer>")))
    return o.select("k", "c", F.concat(F.lit("<think>\nplan\n"), lines, F.lit("\n</think>"), answer).alias("raw"))


#: The same chains as rows of steps, from the integers that the text is made of.
STEPS_SQL = """steps AS (
  SELECT o_orderkey AS k, o_custkey AS c, j, (o_orderkey * 7 + j * 13) % 100 AS t0, (o_orderkey * 7 + j * 13) % 100 + o_orderkey % 9 AS t1,
         ((o_orderkey * 3 + j * 11) % 50) / 100.0 AS x0, ((o_orderkey * 5 + j * 3) % 50) / 100.0 AS y0,
         ((o_orderkey * 3 + j * 11) % 50 + o_orderkey % 40 + 5) / 100.0 AS x1, ((o_orderkey * 5 + j * 3) % 50 + j * 7 + 6) / 100.0 AS y1,
         CASE WHEN j > 1 AND o_orderkey % 2 = 0 THEN j - 2 END AS dep, 'a' || (o_orderkey * j % 7) AS answer,
         ['the red ball', 'the white dog', 'man in blue', 'a tall tree'][(o_orderkey + j) % 4 + 1] AS entity
  FROM orders, (VALUES (1), (2), (3)) v(j) WHERE j <= o_orderkey % 3 + 1)"""


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at which an object of a scene is visible: (scene, obj, frame), distinct."""
    e = table(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    return e.select(F.col("user_id").alias("scene"), F.array_position(kinds, F.col("event_type")).cast("int").alias("obj"), (F.col("event_id") % 128).cast("int").alias("frame")).where("obj > 0").distinct()


VISIBLE_SQL = """visible AS (
  SELECT DISTINCT user_id AS scene, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS INTEGER) AS obj, CAST(event_id % 128 AS INTEGER) AS frame
  FROM events WHERE list_contains(['click', 'error', 'purchase', 'signup', 'view'], event_type))"""


def scene_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, obj, color, material, shape) of every object that is ever visible."""
    v = visible(spark, sf_dir).select("scene", "obj").distinct()
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n)
    s = F.col("scene").cast("int") + F.col("obj")
    return v.select("scene", "obj", pick(["red", "blue", "green"], s % 3).alias("color"), pick(["metal", "rubber"], s % 2).alias("material"), pick(["cube", "sphere", "cylinder"], (s * 2 + F.col("obj")) % 3).alias("shape"))


OBJECTS_SQL = """objects AS (
  SELECT scene, obj, ['red', 'blue', 'green'][(scene + obj) % 3 + 1] AS color, ['metal', 'rubber'][(scene + obj) % 2 + 1] AS material,
         ['cube', 'sphere', 'cylinder'][((scene + obj) * 2 + obj) % 3 + 1] AS shape FROM (SELECT DISTINCT scene, obj FROM visible))"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections (video, phrase, frame, box), the best of each."""
    b = boxes(spark, sf_dir, once=False)
    names = F.array(*[F.lit(x) for x in ("the red ball", "the white dog", "man in blue", "a tall tree")])
    t = b.select((F.col("item") % 100).alias("video"), F.get(names, (F.col("l_partkey") % 4).cast("int")).alias("phrase"), (F.col("l_suppkey") % 16).cast("int").alias("frame"), F.col("a").alias("box"), "item", "line")
    return t.groupBy("video", "phrase", "frame").agg(F.min_by("box", F.struct("item", "line", "box")).alias("box"))


TRACKS_SQL = """tracks AS (
  SELECT video, phrase, frame, s.ax0 AS x0, s.ay0 AS y0, s.ax1 AS x1, s.ay1 AS y1 FROM (
    SELECT item % 100 AS video, ['the red ball', 'the white dog', 'man in blue', 'a tall tree'][l_partkey % 4 + 1] AS phrase, CAST(l_suppkey % 16 AS INTEGER) AS frame,
           min({'item': item, 'line': line, 'ax0': ax0, 'ay0': ay0, 'ax1': ax1, 'ay1': ay1}) AS s FROM boxes GROUP BY ALL))"""
