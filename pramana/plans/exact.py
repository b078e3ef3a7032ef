"""Whole results of operators that other queries only count: texts, sets, boxes, draws, matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pramana.functions import codec as C
from pramana.functions import rle
from pramana.functions.joins import dealt
from pramana.operators import resample as S
from pramana.operators import rewards as W
from pramana.plans import derive as D
from pramana.plans.catalogue import _kept_chains, _parsed, query, r6, weights_sql

_OK = "k % 10 NOT IN (8, 9)"
_ASKED = "['the red ball', '2: white dog: the white dog', 'Man in blue', 'a tall tree'][(k + j) % 4 + 1]"
_LINE = f"'[' || j || '] Q: Where is ' || {_ASKED} || '? | A: ' || answer || ' | E: t=' || t0 || '-' || t1 || ' box=(' || printf('%.3f,%.3f,%.3f,%.3f', x0, y0, x1, y1) || ') | deps=' || coalesce(CAST(dep + 1 AS VARCHAR), '')"


@query(f"SELECT k, '<think>' || chr(10) || string_agg({_LINE}, chr(10) ORDER BY j) || chr(10) || '</think>' || chr(10) || '<answer>' || CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'no' END || '</answer>' AS text FROM steps WHERE {_OK} GROUP BY 1", (D.STEPS_SQL,))
def rendered_chains(spark, sf):
    return _parsed(spark, sf).where("parsed.chain is not null").select("k", C.render("parsed.chain", "parsed.answer").alias("text"))


_CLOSED = f"""edges AS (SELECT k, j - 1 AS i, dep FROM steps WHERE {_OK}), sizes AS (SELECT k, max(i) AS last FROM edges GROUP BY 1)"""
_REACHED = "(WITH RECURSIVE r(k, i) AS (SELECT k, {start} FROM sizes UNION SELECT r.k, {next} FROM r JOIN edges e ON {on} WHERE {next} IS NOT NULL) SELECT k, list_sort(list(i)) AS s FROM r WHERE i <> (SELECT {start} FROM sizes z WHERE z.k = r.k) GROUP BY 1)"


@query(
    "SELECT k, coalesce(array_to_string(a.s, ','), '') AS after_first, coalesce(array_to_string(b.s, ','), '') AS before_last, coalesce((SELECT string_agg(e.i, ',' ORDER BY e.i) FROM edges e WHERE e.k = z.k AND e.i <> 0 AND NOT coalesce(list_contains(a.s, e.i), false)), '') AS left_over FROM sizes z LEFT JOIN "
    + _REACHED.format(start="0", next="e.i", on="e.k = r.k AND e.dep = r.i") + " a USING (k) LEFT JOIN " + _REACHED.format(start="last", next="e.dep", on="e.k = r.k AND e.i = r.i") + " b USING (k)",
    (D.STEPS_SQL, _CLOSED),
)
def dependency_sets(spark, sf):
    """The steps that rest on the first, those that the last rests on, and those left without the first and what rests on it."""
    p = _parsed(spark, sf).where("parsed.chain is not null").select("k", F.col("parsed.chain").alias("chain")).withColumn("deps", F.transform("chain", lambda s: s["deps"]))
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x.cast("string")), ",")
    # a step is known by its place: what is left keeps its question
    kept = C.without_step("chain", "deps", 0)
    place = F.transform(kept, lambda s: F.array_position(F.transform("chain", lambda t: F.struct(t["question"], t["t0"])), F.struct(s["question"], s["t0"])) - 1)
    return p.select("k", text(C.closure("deps", 0)).alias("after_first"), text(C.ancestors("deps", F.size("deps") - 1)).alias("before_last"), text(place).alias("left_over"))


@query(f"SELECT k, string_agg(j - 1, ',' ORDER BY j) AS steps FROM steps s WHERE {_OK} AND (CASE WHEN k % 3 = 0 OR k % 4 = 1 THEN j = (SELECT max(j) FROM steps t WHERE t.k = s.k) ELSE true END) GROUP BY 1", (D.STEPS_SQL,))
def decisive_places(spark, sf):
    """Places of the deciding steps: all observations where the question is predictive, else the last."""
    k = F.col("k")
    p = _parsed(spark, sf).where("parsed.chain is not null").select("k", F.transform("parsed.chain", lambda s, i: s.withField("question", F.when(k % 4 == 1, s["question"]).otherwise("Do they meet?")).withField("t0", i)).alias("chain"))
    found = C.decisive("chain", F.when(k % 3 == 0, "descriptive").otherwise("predictive"))
    return p.select("k", F.array_join(F.transform(found, lambda s: s["t0"].cast("string")), ",").alias("steps"))


@query("SELECT p_partkey, a // 10 AS x0, CASE WHEN b // 10 > a // 10 THEN 0 ELSE a % 10 END AS y0, b // 10 + 1 AS x1, CASE WHEN b // 10 > a // 10 THEN 10 ELSE b % 10 + 1 END AS y1 FROM (SELECT p_partkey, p_partkey % 40 AS a, p_partkey % 40 + p_partkey % 13 AS b FROM part)")
def rle_whole_boxes(spark, sf):
    k = F.col("p_partkey")
    b = D.table(spark, sf, "part").select("p_partkey", rle.runs_to_box(F.array(k % 40, k % 13 + 1, F.lit(60).cast("long")), F.lit(10)).alias("b"))
    return b.select("p_partkey", *[F.col(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: NOT w IN ('the', 'a', 'an', 'at', 'of', 'and', 'frame')))"


@query(
    f"""SELECT k, round(greatest(0, score - CASE WHEN edges > 0 THEN 0.5 * bad / edges ELSE 0 END), 6) AS process FROM (SELECT z.k, coalesce(m.total, 0) / z.n AS score, (SELECT count(*) FROM refs r WHERE r.k = z.k AND r.dep IS NOT NULL) AS edges,
  (SELECT count(*) FROM refs r LEFT JOIN matched a ON a.k = r.k AND a.j = r.dep LEFT JOIN matched b ON b.k = r.k AND b.j = r.i LEFT JOIN preds p ON p.k = r.k AND p.i = b.i WHERE r.k = z.k AND r.dep IS NOT NULL AND NOT coalesce(a.i < b.i AND p.dep = a.i, false)) AS bad
  FROM (SELECT k, count(*) AS n FROM refs WHERE k IN (SELECT k FROM preds) GROUP BY 1) z LEFT JOIN (SELECT k, sum(sim) AS total FROM matched GROUP BY 1) m USING (k))""",
    (
        D.STEPS_SQL,
        f"preds AS (SELECT k, j - 1 AS i, t0, t1, x0, y0, x1, y1, answer, dep FROM steps WHERE {_OK})",
        "refs AS (SELECT * REPLACE (k - 12 AS k) FROM preds)",
        f"""sims AS (SELECT p.k, p.i, r.i AS j, CASE WHEN p.answer = r.answer THEN 1.0 ELSE 0.0 END * (0.5 + 0.5 * (ix / nullif(ax + bx - ix, 0)) * tx / (tt - tx)) AS sim FROM preds p JOIN refs r USING (k),
  LATERAL (SELECT greatest(0.0, least(p.x1, r.x1) - greatest(p.x0, r.x0)) * greatest(0.0, least(p.y1, r.y1) - greatest(p.y0, r.y0)) AS ix, (p.x1 - p.x0) * (p.y1 - p.y0) AS ax, (r.x1 - r.x0) * (r.y1 - r.y0) AS bx, greatest(0, least(p.t1, r.t1) - greatest(p.t0, r.t0) + 1) AS tx, (p.t1 - p.t0 + 1) + (r.t1 - r.t0 + 1) AS tt))""",
        """ordered AS (SELECT k, i, j, sim, row_number() OVER (PARTITION BY k ORDER BY sim DESC, j DESC, i DESC) AS r FROM sims WHERE sim > 0)""",
        """taken AS (WITH RECURSIVE t(k, r, got, now, sim) AS (SELECT DISTINCT k, CAST(0 AS BIGINT), CAST([] AS STRUCT(i BIGINT, j BIGINT)[]), CAST(NULL AS STRUCT(i BIGINT, j BIGINT)), CAST(NULL AS DOUBLE) FROM ordered UNION ALL
  SELECT t.k, o.r, CASE WHEN free THEN list_append(got, {'i': o.i, 'j': o.j}) ELSE got END, CASE WHEN free THEN {'i': o.i, 'j': o.j} END, o.sim FROM t JOIN ordered o ON o.k = t.k AND o.r = t.r + 1, LATERAL (SELECT len(list_filter(got, lambda q: q.i = o.i OR q.j = o.j)) = 0 AS free)) SELECT * FROM t)""",
        "matched AS (SELECT k, now.i AS i, now.j AS j, sim FROM taken WHERE now IS NOT NULL)",
    ),
)
def process_scores(spark, sf):
    """Chains against the one of the key twelve on: greedy one to one matches less a penalty for broken order."""
    p = _kept_chains(spark, sf)
    pairs = p.join(dealt(p.select((F.col("k") - 12).alias("k"), F.col("chain").alias("ref"))), "k")
    return W.process(pairs, "chain", "ref").select("k", r6(F.col("process")).alias("process"))


@query("SELECT k, max(process) AS process FROM (SELECT k, 1.0 AS process FROM steps WHERE k % 10 NOT IN (8, 9)) GROUP BY 1", (D.STEPS_SQL,))
def process_best(spark, sf):
    """The best score over several references, one of which is the chain itself."""
    p = _parsed(spark, sf).where("parsed.chain is not null").select("k", F.col("parsed.chain").alias("chain"))
    return W.process_best(p.withColumn("refs", F.array(F.slice("chain", 1, 1), F.col("chain"))), "chain", "refs").select("k", r6(F.col("process")).alias("process"))


# ---- order statistics over weighted clusters

_CUSTOMERS = "items AS (SELECT c_mktsegment AS stratum, c_nationkey AS cluster, CAST(c_acctbal AS DOUBLE) AS v, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS label FROM customer)"
_CUMULATED = "run AS (SELECT i.stratum, rep, v, label, w, sum(w) OVER (PARTITION BY i.stratum, rep ORDER BY v, cluster, label ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY i.stratum, rep) AS whole FROM items i JOIN wt USING (cluster))"
_BY_STRATUM = "SELECT stratum, round(v[CAST(floor(0.025 * len(v)) AS INTEGER) + 1], 6) AS lo, round(v[least(len(v), CAST(floor(0.975 * len(v)) AS INTEGER) + 1)], 6) AS hi, CAST(len(v) AS INTEGER) AS n_reps FROM (SELECT stratum, list_sort(list(value)) AS v FROM ({reps}) GROUP BY 1)"
_OF_NATIONS = weights_sql("(SELECT DISTINCT cluster FROM items)")


def _balances(spark, sf):
    c = D.table(spark, sf, "customer")
    return c.select(F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("cluster"), F.col("c_acctbal").cast("double").alias("v"), (F.col("c_custkey") % 3 == 0).cast("int").alias("label"))


def _ended(reps):
    return S.intervals(reps).select("stratum", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), "n_reps")


@query(_BY_STRATUM.format(reps="SELECT stratum, rep, min(v) AS value FROM run WHERE 2 * upto >= whole AND w > 0 AND whole > 0 GROUP BY 1, 2"), (_CUSTOMERS, *_OF_NATIONS, _CUMULATED))
def clustered_median(spark, sf):
    """Interval of the median balance of each segment, nations resampled."""
    return _ended(S.quantiles(_balances(spark, sf).drop("label"), "v"))


@query(
    _BY_STRATUM.format(reps="SELECT stratum, rep, sum(v * held) / sum(held) AS value FROM (SELECT *, greatest(0, least(upto, 0.9::DOUBLE * whole) - greatest(upto - w, 0.1::DOUBLE * whole)) AS held FROM run) GROUP BY 1, 2 HAVING sum(held) > 0"),
    (_CUSTOMERS, *_OF_NATIONS, _CUMULATED),
)
def clustered_trimmed_mean(spark, sf):
    """Interval of the mean balance of each segment without a tenth at either end, nations resampled."""
    return _ended(S.trimmed_means(_balances(spark, sf).drop("label"), "v", 0.1))


@query(
    _BY_STRATUM.format(reps="SELECT stratum, rep, sum(ones * (below + 0.5 * zeros)) / (sum(ones)::DOUBLE * sum(zeros)) AS value FROM (SELECT stratum, rep, ones, zeros, sum(zeros) OVER (PARTITION BY stratum, rep ORDER BY v ROWS UNBOUNDED PRECEDING) - zeros AS below FROM (SELECT stratum, rep, v, sum(w) FILTER (label = 1) AS o, coalesce(sum(w) FILTER (label = 1), 0) AS ones, coalesce(sum(w) FILTER (label = 0), 0) AS zeros FROM items JOIN wt USING (cluster) GROUP BY 1, 2, 3)) GROUP BY 1, 2 HAVING sum(ones) > 0 AND sum(zeros) > 0"),
    (_CUSTOMERS, *_OF_NATIONS),
)
def clustered_auc(spark, sf):
    """Interval of how well the balance tells every third customer from the others in each segment, nations resampled."""
    return _ended(S.aucs(_balances(spark, sf), "v"))
