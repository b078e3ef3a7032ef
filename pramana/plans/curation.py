"""Item builders, exports, samples and masks over the derived views, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pramana.functions import codec as C
from pramana.functions import geometry as G
from pramana.functions import text as T
from pramana.functions.joins import dealt
from pramana.operators import items as I
from pramana.operators import regions as R
from pramana.operators import strata as X
from pramana.plans import derive as D
from pramana.plans.catalogue import query, r6
from pramana.plans.reports import _GRID, _PROPOSALS, _STEPS, _cites, _iou, proposals

_SUBTYPES = ["exist", "count", "query_color", "query_material", "query_shape"]
_ANSWERS = ["Yes", "Three", "the red one", "metal", "cube"]
_CODES = ["CW", "CH", "TN", "TC", "TP", "DC", "DL", "DO", "ZZ"]


def _pick(names, n):
    return F.get(F.array(*map(F.lit, names)), n.cast("int"))


def questions(spark, sf):
    """A question for each part, a third of them open, others with three choices."""
    k = F.col("p_partkey")
    choices = F.transform(F.array(*map(F.lit, range(3))), lambda i: F.struct(F.concat(F.lit("choice "), i.cast("string")).alias("choice"), F.when((k + i) % 2 == 0, "correct").otherwise("wrong").alias("answer")))
    return D.table(spark, sf, "part").select((k % 50).alias("scene_index"), k.alias("question_id"), F.concat(F.lit("What about "), k.cast("string")).alias("question"), _pick(["descriptive", "explanatory", "predictive"], k % 3).alias("question_type"), F.when(k % 3 == 0, _pick(_SUBTYPES, k % 5)).alias("question_subtype"), _pick(_ANSWERS, k % 5).alias("answer"), F.when(k % 3 != 0, choices).alias("choices"))


def _array(names):
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


_ASK = "['descriptive', 'explanatory', 'predictive'][p_partkey % 3 + 1]"
_QID = "p_partkey % 50 || '_' || p_partkey"
_TEXT = "'What about ' || p_partkey"
_OPEN = f"{_TEXT} || {_array(I.DESCRIPTIVE[s] for s in _SUBTYPES)}[p_partkey % 5 + 1]"
_WORD = "['yes', '3', 'the', 'metal', 'cube'][p_partkey % 5 + 1]"
_LISTED = f"{_TEXT} || chr(10) || 'A. choice 0' || chr(10) || 'B. choice 1' || chr(10) || 'C. choice 2' || {_quoted(I.ANY_CORRECT)}"
_GOLD = "CASE WHEN p_partkey % 2 = 0 THEN 'AC' ELSE 'B' END"


@query(f"SELECT {_QID} AS id, {_ASK} AS question_type, CASE WHEN p_partkey % 3 = 0 THEN {_OPEN} ELSE {_LISTED} END AS prompt, CASE WHEN p_partkey % 3 = 0 THEN {_WORD} ELSE {_GOLD} END AS gold FROM part")
def question_items(spark, sf):
    return I.clevrer_items(questions(spark, sf)).select("id", "question_type", "prompt", "gold")


@query(f"SELECT {_QID} || CASE WHEN o IS NULL THEN '' ELSE '_' || o END AS id, {_ASK} AS question_type, CASE WHEN o IS NULL THEN {_OPEN} ELSE {_TEXT} || chr(10) || 'Option ' || ['A', 'B', 'C'][o + 1] || ': choice ' || o || {_quoted(I.IS_CORRECT)} END AS prompt, CASE WHEN o IS NULL THEN {_WORD} WHEN (p_partkey + o) % 2 = 0 THEN 'yes' ELSE 'no' END AS gold FROM (SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN [NULL] ELSE [0, 1, 2] END) AS o FROM part)")
def option_items(spark, sf):
    return I.clevrer_items(questions(spark, sf), "option").select("id", "question_type", "prompt", "gold")


def _coded(spark, sf):
    """A five-option question for each part, with a code and a video."""
    k = F.col("p_partkey")
    options = F.transform(F.array(*map(F.lit, range(5))), lambda i: F.concat(F.lit("o"), (i + k % 7).cast("string")))
    return D.table(spark, sf, "part").select((k % 40).alias("video"), k.alias("qid"), _pick(_CODES, k % 9).alias("type"), F.concat(F.lit("why "), k.cast("string")).alias("question"), (k % 5).cast("int").alias("right"), options.alias("options"))


_CODED = f"coded AS (SELECT p_partkey % 40 AS video, p_partkey AS qid, p_partkey % 40 || '_' || p_partkey AS qset, p_partkey % 5 AS gold_at, p_partkey % 7 AS shift, ['causal', 'causal', 'temporal', 'temporal', 'temporal', 'descriptive', 'descriptive', 'descriptive', 'zz'][p_partkey % 9 + 1] AS family FROM part)"


@query("SELECT qset AS id, family AS question_type, CAST(video AS VARCHAR) AS frames_key, 'why ' || qid || '?' || chr(10) || 'A. o' || shift || chr(10) || 'B. o' || (shift + 1) || chr(10) || 'C. o' || (shift + 2) || chr(10) || 'D. o' || (shift + 3) || chr(10) || 'E. o' || (shift + 4) || " + _quoted(I.ONE_CORRECT) + " AS prompt, ['A', 'B', 'C', 'D', 'E'][gold_at + 1] AS gold FROM coded WHERE qid % 2 = 0", (_CODED,))
def coded_items(spark, sf):
    """Five-option items of the listed questions only."""
    ids = D.table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat_ws("_", (F.col("p_partkey") % 40).cast("string"), F.col("p_partkey").cast("string")).alias("id"))
    return I.nextqa_items(_coded(spark, sf), ids=ids).select("id", "question_type", "frames_key", "prompt", "gold")


@query("SELECT qset || '_' || o AS id, family AS question_type, 'why ' || qid || '?' || chr(10) || 'Option ' || ['A', 'B', 'C', 'D', 'E'][o + 1] || ': o' || (shift + o) || " + _quoted(I.IS_CORRECT) + " AS prompt, CASE WHEN o = gold_at THEN 'yes' ELSE 'no' END AS gold FROM coded, range(5) r(o)", (_CODED,))
def coded_option_items(spark, sf):
    return I.nextqa_items(_coded(spark, sf), "option").select("id", "question_type", "prompt", "gold")


@query(f"SELECT {_QID} AS id, pred, CASE WHEN pred = gold THEN 1 ELSE 0 END AS correct, CASE WHEN p_partkey % 3 <> 0 THEN (SELECT count(*) FROM (SELECT unnest(['A', 'B', 'C']) AS l) WHERE contains(pred, l) = contains(gold, l)) END AS option_correct, CASE WHEN p_partkey % 3 <> 0 THEN 3 END AS option_total FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN {_WORD} ELSE {_GOLD} END AS gold, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'yes' ELSE '3' END WHEN p_partkey % 4 < 2 THEN 'AC' ELSE 'B' END AS pred FROM part)")
def score_items(spark, sf):
    """Replies scored: a number counts as yes where that is asked, letters by the option too."""
    i = I.clevrer_items(questions(spark, sf)).join(questions(spark, sf).select(F.concat_ws("_", F.col("scene_index").cast("string"), F.col("question_id").cast("string")).alias("id"), "question_id", "question_subtype"), "id")
    said = F.when(F.col("options").isNull(), "Three of them").when(F.col("question_id") % 4 < 2, "C and A").otherwise("b")
    s = I.score_items(i.withColumn("prediction", said).withColumn("yes_no", F.coalesce(F.col("question_subtype") == "exist", F.lit(False))))
    return s.select("id", "pred", "correct", F.col("option_correct").cast("long").alias("option_correct"), "option_total")


@query(f"SELECT {_QID} AS problem_id, CASE WHEN p_partkey % 3 <> 0 THEN 'multiple choice' WHEN p_partkey % 5 = 1 THEN 'numerical' ELSE 'free-form' END AS problem_type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'A. choice 0|B. choice 1|C. choice 2' END AS options, '<answer>' || CASE WHEN p_partkey % 3 = 0 THEN {_WORD} ELSE {_GOLD} END || '</answer>' AS solution FROM part")
def question_records(spark, sf):
    return I.question_records(questions(spark, sf)).select("problem_id", "problem_type", F.array_join("options", "|").alias("options"), "solution")


@query(f"SELECT {_QID} || CASE WHEN o IS NULL THEN '' ELSE '_' || o END AS problem_id, CASE WHEN o IS NULL THEN {_WORD} WHEN (p_partkey + o) % 2 = 0 THEN 'yes' ELSE 'no' END AS gold, CASE WHEN o IS NULL THEN 3 WHEN o = p_partkey % 3 THEN 1 ELSE 0 END AS n_chains, CASE WHEN o IS NOT NULL THEN {_TEXT} || chr(10) || 'Option ' || ['A', 'B', 'C'][o + 1] || ': choice ' || o || {_quoted(I.IS_CORRECT)} END AS problem FROM (SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN [NULL] ELSE [0, 1, 2] END) AS o FROM part)")
def option_records(spark, sf):
    """A record for each option, with the chains of that option."""
    n = F.substring_index("problem_id", "_", -1).cast("int")
    one = F.array(F.struct((n % 3).alias("choice_id")))
    r = I.question_records(questions(spark, sf)).withColumn("chains", F.when(F.col("question_type") == "descriptive", F.concat(one, one, one)).otherwise(one))
    return I.option_records(r).select("problem_id", "gold", F.size("chains").alias("n_chains"), F.when(F.col("question_type") != "descriptive", F.col("problem")).alias("problem"))


@query(f"SELECT {_QID.replace('p_partkey', 'k')} || CASE WHEN k % 3 = 0 THEN '' ELSE '_' || k % 3 END AS problem_id, CASE WHEN k % 3 = 0 THEN {_OPEN.replace('p_partkey', 'k')} ELSE {_TEXT.replace('p_partkey', 'k')} || chr(10) || 'Option ' || ['A', 'B', 'C'][k % 3 + 1] || ': choice ' || k % 3 || {_quoted(I.IS_CORRECT)} END AS problem, CASE WHEN k % 2 = 0 THEN 'Yes' ELSE 'no' END AS gold, lines FROM (SELECT k, CAST(count(*) + 3 AS BIGINT) AS lines FROM steps WHERE k % 10 NOT IN (8, 9) AND k IN (SELECT p_partkey FROM part) GROUP BY 1)", (D.STEPS_SQL,))
def sft_records(spark, sf):
    """Chains joined with their questions; those of an option ask about it alone."""
    asked = questions(spark, sf)
    # keys meet the questions before a text is read: those without one are most of a large file
    texts = D.chain_texts(spark, sf).join(dealt(asked.select(F.col("question_id").alias("k"))), "k", "left_semi")
    c = C.parse(texts).where("parsed.chain is not null")
    chains = c.select((F.col("k") % 50).alias("scene_index"), F.col("k").alias("question_id"), (F.col("k") % 3).cast("int").alias("choice_id"), _pick(["descriptive", "explanatory", "predictive"], F.col("k") % 3).alias("question_type"), F.col("parsed.chain").alias("chain"), F.col("parsed.answer").alias("final_answer"))
    s = I.sft_records(chains, asked)
    return s.select("problem_id", "problem", "gold", F.size(F.split("response", "\n")).cast("long").alias("lines"))


# ---- filters, samples


@query("SELECT id, r FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM runs WHERE condition = 'plain' AND id % 3 <> 1 AND id IN (SELECT item FROM boxes)) WHERE r <= 500", (D.RUNS_SQL, D.BOXES_SQL))
def item_filters(spark, sf):
    """Items that have regions and are on a list, the first five hundred (a limit that the harness offers), numbered."""
    from pramana.operators.stats import numbered

    r = D.runs(spark, sf).where("condition = 'plain'").select("id", "video")
    ids = r.where("id % 3 <> 1").select(F.col("id").alias("listed"))
    regions = D.boxes(spark, sf).groupBy(F.col("item").alias("id")).agg(F.collect_list("a").alias("regions"))
    kept = I.first_items(I.keep_with_regions(I.keep_ids(r, ids, "id"), regions, "id"), 500, "id")
    return numbered(I.by_video(kept), "id", "r").select("id", (F.col("r") + 1).alias("r"))


@query("SELECT family, count(*) AS n, sum(qid) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY md5('0:nq_' || qset), 'nq_' || qset) AS r FROM coded WHERE video IN (SELECT video FROM (SELECT DISTINCT video FROM coded) ORDER BY md5('0:' || video), video LIMIT 12)) WHERE r <= 9 GROUP BY 1", (_CODED,))
def training_pool(spark, sf):
    p = I.training_pool(_coded(spark, sf), 12, 9)
    return p.groupBy("family").agg(F.count("*").alias("n"), F.sum("qid").alias("ids"))


@query("SELECT qset AS id FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY md5('0:' || qset), qset) AS r FROM coded) WHERE r <= 10", (_CODED,))
def validation_ids(spark, sf):
    return I.validation_ids(_coded(spark, sf), 30)


def _top(source, n, extra=""):
    return f"(SELECT key, gold FROM {source} {extra} ORDER BY md5('0:' || key), key LIMIT {n})"


@query(
    "SELECT arm, origin, gold, count(*) AS n, sum(key) AS keys, bool_or(bare) AS bare FROM (" + " UNION ALL ".join(f"SELECT '{arm}' AS arm, '{origin}' AS origin, key, gold, {bare} AS bare FROM {src}" for arm, origin, bare, src in [("mixed_chains", "made", "false", "a"), ("mixed_chains", "real", "false", "b"), ("mixed_plain", "made", "true", "a"), ("mixed_plain", "real", "true", "b"), ("real_chains", "real", "false", "b"), ("mixed_rl", "made", "false", "c"), ("mixed_rl", "real", "false", "e"), ("real_rl", "real", "false", "d")]) + ") GROUP BY 1, 2, 3",
    ("made AS (SELECT s_suppkey AS key, 'yes' AS gold FROM supplier)", "real AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'yes' ELSE 'no' END AS gold FROM customer)", "a AS " + _top("made", 8), "b AS (SELECT key, gold FROM (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY md5('0:' || key), key) AS r FROM real) WHERE r <= 20)", "c AS " + _top("made", 5), "d AS " + _top("real", 10), "e AS " + _top("d", 5)),
)
def mixing_arms(spark, sf):
    made = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("yes").alias("gold"))
    real = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "yes").otherwise("no").alias("gold"))
    m = I.mixing_arms(made, real, made, real, 8, 40, 5)
    return m.groupBy("arm", "origin", "gold").agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.bool_or("bare").alias("bare"))


@query("SELECT tag, id FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY md5('0:' || qid), qid) AS q FROM (SELECT *, row_number() OVER (PARTITION BY tag, qid ORDER BY md5('0:' || id), id) AS i FROM (SELECT o_orderkey AS id, o_orderkey // 4 AS qid, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS tag FROM orders WHERE o_orderkey % 10 NOT IN (8, 9))) WHERE i = 1) WHERE q <= 25")
def audit_sample(spark, sf):
    p = C.parse(D.chain_texts(spark, sf)).select(F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("tag"), F.expr("k div 4").alias("qid"), F.col("k").alias("id"), F.col("parsed.chain").alias("chain"))
    return I.audit_sample(p, 25).select("tag", "id")


@query("SELECT o_custkey AS problem, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def first_of_problem(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("problem"), F.col("o_orderkey").alias("first_key"))
    return I.first_of_problem(o, "problem", "first_key")


@query("SELECT o_orderpriority AS kind, gold, n FROM (SELECT o_orderpriority, o_custkey % 40 AS gold, count(*) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_custkey % 40) AS r FROM orders GROUP BY 1, 2) WHERE r <= 12")
def top_answers(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 40).alias("gold"))
    return I.manifest(o, ["kind"])


# ---- teachers' steps, corruption, checks

_DETECTED = "detected AS (SELECT item % 100 AS video, l_partkey % 4 AS entity, CAST(l_suppkey % 16 AS INTEGER) AS frame, ax0 AS x0, ay0 AS y0, CASE WHEN q % 10 = 0 THEN ax0 + 0.005 ELSE ax1 END AS x1, ay1 AS y1, q AS score FROM boxes)"
_WANTED = "wanted AS (SELECT k AS id, j AS n, k % 100 AS video, (k + j) % 4 AS entity, CAST((k + j) % 14 + 1 AS INTEGER) AS frame FROM steps)"
_GROUNDED = "grounded AS (SELECT w.id, w.n, CASE WHEN s IS NULL THEN 'undetected' WHEN s.x1 - s.x0 <= 0.01 OR s.y1 - s.y0 <= 0.01 THEN 'degenerate' ELSE 'kept' END AS status, s.f AS found_at FROM wanted w LEFT JOIN (SELECT id, n, min({'s': -score, 'o': CASE WHEN d.frame = w.frame THEN 0 ELSE 1 END, 'f': d.frame, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) AS s FROM wanted w JOIN detected d ON d.video = w.video AND d.entity = w.entity AND abs(d.frame - w.frame) <= 1 GROUP BY 1, 2) b USING (id, n))"


def _grounded(spark, sf):
    b = D.boxes(spark, sf)
    thin = F.when(F.col("q") % 10 == 0, F.col("a.x0") + 0.005).otherwise(F.col("a.x1"))
    found = b.select((F.col("item") % 100).alias("video"), (F.col("l_partkey") % 4).cast("string").alias("phrase"), (F.col("l_suppkey") % 16).cast("int").alias("frame"), F.col("q").alias("score"), G.box("a.x0", "a.y0", thin, "a.y1").alias("box"))
    # equal scores of one frame: the first of their boxes
    one = found.groupBy("video", "phrase", "frame").agg(F.max("score").alias("score"), F.min_by("box", F.struct(-F.col("score"), "box")).alias("box"))
    k = F.col("id")
    steps = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).select("id", F.explode(F.sequence(F.lit(1).cast("long"), k % 3 + 1)).alias("n"))
    steps = steps.select("id", "n", (k % 100).alias("video"), ((k + F.col("n")) % 4).cast("string").alias("entity"), ((k + F.col("n")) % 14 + 1).cast("int").alias("frame"))
    return I.ground_steps(steps, one)


@query("SELECT status, count(*) AS n, sum(CASE WHEN status = 'kept' THEN found_at END) AS frames FROM grounded GROUP BY 1", (D.STEPS_SQL, D.BOXES_SQL, _DETECTED, _WANTED, _GROUNDED))
def ground_steps(spark, sf):
    return _grounded(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.sum("found_frame").alias("frames"))


@query("SELECT id || '_' || u.o AS problem_id, CAST(u.o AS INTEGER) AS option, u.g AS gold, n_steps FROM (SELECT id, n_steps, unnest([{'o': r, 'g': 'yes'}, {'o': d + CASE WHEN d >= r THEN 1 ELSE 0 END, 'g': 'no'}]) AS u FROM (SELECT id, count(*) AS n_steps, id % 5 AS r, CAST('0x' || substr(md5('0:' || id), 1, 12) AS BIGINT) % 4 AS d FROM grounded WHERE status = 'kept' GROUP BY 1))", (D.STEPS_SQL, D.BOXES_SQL, _DETECTED, _WANTED, _GROUNDED))
def grounded_records(spark, sf):
    q = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).cast("int").alias("right"))
    return I.grounded_records(q, _grounded(spark, sf))


@query("SELECT p_partkey AS key, CASE p_partkey % 4 WHEN 1 THEN 'no' WHEN 2 THEN 'at frame ' || greatest(0, p_partkey + [-20, -12, 12, 20][CAST('0x' || substr(md5('0:' || p_partkey || ':frame'), 1, 12) AS BIGINT) % 4 + 1]) WHEN 0 THEN 'the ' || list_filter(['gray', 'red', 'blue', 'green', 'brown', 'cyan', 'purple', 'yellow'], lambda c: c <> 'red')[CAST('0x' || substr(md5('0:' || p_partkey || ':value'), 1, 12) AS BIGINT) % 7 + 1] || ', thing' END AS answer FROM part")
def corrupt_answer(spark, sf):
    k = F.col("p_partkey")
    said = F.when(k % 4 == 0, "the red, thing").when(k % 4 == 1, "Yes, it is").when(k % 4 == 2, F.concat(F.lit("at frame "), k.cast("string"))).otherwise("silence")
    return D.table(spark, sf, "part").select(k.alias("key"), said.alias("said")).select("key", I.corrupt_answer(F.col("said"), "key").alias("answer"))


@query("SELECT unnest(['priced', 'open', 'early']) AS \"check\", count(*) AS n, unnest([count(*) FILTER (NOT coalesce(o_totalprice > 0, false)), count(*) FILTER (NOT coalesce(o_orderstatus = 'O', false)), count(*) FILTER (NOT coalesce(o_orderkey % 2 = 0, false))]) AS bad, unnest([CASE WHEN count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN count(*) FILTER (NOT coalesce(o_orderstatus = 'O', false)) = 0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN count(*) FILTER (NOT coalesce(o_orderkey % 2 = 0, false)) = 0 THEN 'PASS' ELSE 'WARN' END]) AS status FROM orders")
def format_checks(spark, sf):
    o = D.table(spark, sf, "orders")
    return I.checks(o, {"priced": (F.col("o_totalprice") > 0, "FAIL"), "open": (F.col("o_orderstatus") == "O", "FAIL"), "early": (F.col("o_orderkey") % 2 == 0, "WARN")})


@query("SELECT CASE k % 6 WHEN 1 THEN 'blank' WHEN 2 THEN 'span' WHEN 3 THEN 'box' WHEN 4 THEN 'link' WHEN 5 THEN 'no_steps' ELSE 'valid' END AS reason, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1")
def invalid_reasons(spark, sf):
    k = F.col("o_orderkey") % 6
    step = F.struct(F.when(k == 1, " \t").otherwise("q").alias("question"), F.lit("a").alias("answer"), F.when(k == 2, 9).otherwise(3).alias("t0"), F.lit(8).alias("t1"), G.box(F.lit(0.1), F.lit(0.1), F.when(k == 3, 1.2).otherwise(0.5), F.lit(0.6)).alias("box"), F.when(k == 4, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("deps"))
    c = D.table(spark, sf, "orders").select(F.filter(F.array(step), lambda _: k != 5).alias("c"))
    return c.groupBy(F.coalesce(I.invalid_reason(F.col("c")), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT id, string_agg(entity, '|' ORDER BY n) AS entities FROM (SELECT id, entity, min(j) AS n FROM cited GROUP BY 1, 2) GROUP BY 1", _STEPS)
def item_entities(spark, sf):
    return I.named_entities(_cites(spark, sf).withColumn("n", F.col("j"))).select("id", F.array_join("entities", "|").alias("entities"))


@query("SELECT k, sum(greatest(0, CAST(round_even(t0 % 16 * 127 / 15.0, 0) AS INTEGER) - 4)) AS starts, sum(least(127, CAST(round_even(t0 % 16 * 127 / 15.0, 0) AS INTEGER) + 4)) AS ends FROM steps WHERE k % 10 NOT IN (8, 9) GROUP BY 1", (D.STEPS_SQL,))
def rescaled_spans(spark, sf):
    c = C.parse(D.chain_texts(spark, sf)).where("parsed.chain is not null").select("k", F.transform("parsed.chain", lambda s: s.withField("t0", s["t0"] % 16)).alias("c"))
    return c.select("k", F.explode(I.rescaled(F.col("c"))).alias("s")).groupBy("k").agg(F.sum("s.t0").alias("starts"), F.sum("s.t1").alias("ends"))


@query("SELECT k, CAST(count(*) AS BIGINT) AS n, round(sum(x1), 6) AS x1, sum(coalesce(dep + 1, 0)) AS deps FROM steps WHERE k % 10 NOT IN (8, 9) GROUP BY 1", (D.STEPS_SQL,))
def chain_json(spark, sf):
    """Chains written as JSON and read again."""
    from pramana.sources.files import CHAIN, chain_from_json, chain_to_json

    c = C.parse(D.chain_texts(spark, sf)).where("parsed.chain is not null").select("k", chain_to_json("parsed.chain", F.col("parsed.answer")).alias("j"))
    s = c.select("k", chain_from_json("j", CHAIN).alias("c")).select("k", F.explode("c.triplets").alias("s"))
    return s.groupBy("k").agg(F.count("*").alias("n"), r6(F.sum(F.get("s.evidence.box", 2))).alias("x1"), F.sum(F.aggregate("s.depends_on", F.lit(0), lambda a, d: a + d + 1)).alias("deps"))


# ---- masks


@query("SELECT id, f AS frame, count(*) AS n FROM cited JOIN grid ON p BETWEEN t0 - 4 AND t1 + 4 GROUP BY 1, 2", (*_STEPS, _GRID))
def mask_hits(spark, sf):
    """On which sampled frames a mask blacks out how many boxes."""
    c = _cites(spark, sf).select("id", F.explode(G.frames_hit("t0", "t1")).alias("frame"))
    return c.groupBy("id", "frame").agg(F.count("*").alias("n"))


@query("SELECT id, CAST(count(*) AS BIGINT) AS n, round(sum(x0), 6) AS x0, sum(t0) AS starts FROM (SELECT DISTINCT id, t0, t1, x0, y0, x1, y1 FROM (SELECT c.id, g.p AS t0, g.p AS t1, t.x0, t.y0, t.x1, t.y1 FROM (SELECT DISTINCT id, video, entity FROM cited) c JOIN tracks t ON t.video = c.video AND t.phrase = c.entity JOIN grid g ON g.f = t.frame UNION ALL SELECT id, t0, t1, x0, y0, x1, y1 FROM cited WHERE (video, entity) IN (SELECT (video, phrase) FROM tracks) OR id IN (SELECT c.id FROM cited c JOIN tracks t ON t.video = c.video AND t.phrase = c.entity))) GROUP BY 1", (*_STEPS, D.BOXES_SQL, D.TRACKS_SQL, _GRID))
def entity_regions(spark, sf):
    """Regions of the entity-track mask: all detections of what a chain names, and its own citations; items without any are skipped."""
    e = X.entity_regions(_cites(spark, sf), D.tracks(spark, sf)).select("id", F.explode("regions").alias("r"))
    return e.groupBy("id").agg(F.count("*").alias("n"), r6(F.sum("r.box.x0")).alias("x0"), F.sum("r.t0").alias("starts"))


_MATCHED = "matched AS (SELECT DISTINCT c.id, c.video, p.o FROM cited c JOIN proposals p ON p.scene = c.video AND p.frame BETWEEN c.t0 AND c.t1 WHERE " + _iou("c.", "p.") + " >= 0.3 OR (p.x0 >= c.x0 - 0.01 AND p.y0 >= c.y0 - 0.01 AND p.x1 <= c.x1 + 0.01 AND p.y1 <= c.y1 + 0.01))"


def _matched(spark, sf, cites):
    c = cites.select("id", F.col("video").alias("scene"), "t0", "t1", "box")
    return R.evidence_objects(c, proposals(spark, sf), ["color", "material", "shape"])


@query("SELECT id, count(*) AS n, round(sum(x0), 6) AS x0 FROM (SELECT m.id, p.x0 FROM matched m JOIN proposals p ON p.scene = m.video AND p.o = m.o JOIN grid ON grid.p = p.frame) GROUP BY 1", (*_STEPS, D.BOXES_SQL, _PROPOSALS, _GRID, _MATCHED))
def object_tracks(spark, sf):
    """Regions of the track mask: the objects that an item's boxes meet, wherever they are on the sampled frames."""
    t = R.object_tracks(_matched(spark, sf, _cites(spark, sf)), proposals(spark, sf), ["color", "material", "shape"])
    return t.groupBy("id").agg(F.count("*").alias("n"), r6(F.sum("box.x0")).alias("x0"))


@query("SELECT CASE WHEN r.item IS NULL THEN 'no_regions' WHEN m.id IS NULL THEN 'no_objects' ELSE 'run' END AS status, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) o LEFT JOIN (SELECT DISTINCT id AS item FROM cited) r ON r.item = o.k LEFT JOIN (SELECT DISTINCT id FROM matched JOIN proposals p ON p.scene = matched.video AND p.o = matched.o JOIN grid ON grid.p = p.frame) m ON m.id = o.k GROUP BY 1", (*_STEPS, D.BOXES_SQL, _PROPOSALS, _GRID, _MATCHED))
def mask_skips(spark, sf):
    """Items that a track mask skips: those without regions, and those whose regions meet no object that is seen on a sampled frame."""
    items = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    cites = _cites(spark, sf)
    tracks = R.object_tracks(_matched(spark, sf, cites), proposals(spark, sf), ["color", "material", "shape"])
    return R.skip_rules(items, cites, tracks).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT scene, count(DISTINCT o) AS n FROM proposals WHERE frame % 8 = 0 GROUP BY 1", (D.BOXES_SQL, _PROPOSALS))
def all_objects(spark, sf):
    """Objects seen on every eighth frame."""
    p = proposals(spark, sf).where("frame % 8 = 0")
    return p.groupBy("scene").agg(F.count_distinct("color", "material", "shape").alias("n"))


@query("SELECT video, phrase, count(*) AS n, round(sum(round(x0, 4)), 6) AS x0 FROM tracks GROUP BY 1, 2", (D.BOXES_SQL, D.TRACKS_SQL))
def built_tracks(spark, sf):
    """Tracks as they are saved: a map from frame to a box of four decimals for each video and phrase."""
    t = R.build_tracks(D.tracks(spark, sf))
    return t.select("video", "phrase", F.size("frames").cast("long").alias("n"), r6(F.aggregate(F.map_values("frames"), F.lit(0.0), lambda a, b: a + F.get(b, 0))).alias("x0"))
