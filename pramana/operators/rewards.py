"""Scores of answers and chains against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pramana.functions import geometry as G
from pramana.functions import text as T
from pramana.functions.codec import valid_chain


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def outcome(raw, problem_type, subtype, gold, n_options) -> Column:
    """1 if the answer tag's content is the gold answer: letters of a multiple choice, else the normalised word; digits count as yes or no where that is asked."""
    answer = T.extract_answer(raw)
    word = T.normalize_short(answer)
    word = F.when(((_c(subtype) == "exist") | _c(gold).isin("yes", "no")) & word.rlike("^[0-9]+$"), F.when(word == "0", "no").otherwise("yes")).otherwise(word)
    right = F.when(_c(problem_type) == "multiple choice", T.parse_letters(answer, n_options) == _c(gold)).otherwise(word == _c(gold))
    return F.coalesce(right, F.lit(False)).cast("double")


def outcome_lenient(raw, problem_type, subtype, gold, n_options) -> Column:
    """As ``outcome``, on the last line of a text without the tag."""
    last = F.element_at(F.split(T.strip(raw), r"\R"), -1)
    answer = F.coalesce(T.extract_answer(raw), last)
    return outcome(F.concat(F.lit("<answer>"), answer, F.lit("</answer>")), problem_type, subtype, gold, n_options)


def exact(prediction, gold) -> Column:
    return (F.lower(T.strip(prediction)) == F.lower(T.strip(gold))).cast("double")


def format_tags(raw) -> Column:
    return _c(raw).rlike(r"(?s)^\s*<think>.*?</think>\s*<answer>.*?</answer>\s*$").cast("double")


def format_chain(parsed) -> Column:
    """1 for a valid chain, 0.2 for both tags, else 0."""
    p = _c(parsed)
    return F.when(p["chain"].isNotNull(), 1.0).when(p["has_tags"] & p["answer"].isNotNull(), 0.2).otherwise(0.0)


def within_clip(chain, frames: int) -> Column:
    """1 for a valid chain whose spans end inside the clip."""
    c = _c(chain)
    return F.coalesce(valid_chain(c) & F.forall(c, lambda s: s["t1"] < frames), F.lit(False)).cast("double")


def st_iou(a, b) -> Column:
    return G.span_iou(a["t0"], a["t1"], b["t0"], b["t1"]) * G.iou(a["box"], b["box"])


def grounding(chain, regions) -> Column:
    """Mean over steps of the best overlap in place and time with any reference region; 0 without either."""
    c, r = _c(chain), _c(regions)
    best = F.transform(c, lambda s: F.array_max(F.transform(r, lambda g: st_iou(s, g))))
    mean = F.aggregate(best, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    return F.when(c.isNotNull() & (F.size(r) > 0), mean).otherwise(0.0)


def chain_metrics(chain, regions, t_tol: int = 8) -> Column:
    """STRUCT<ground_st, ground_spatial, ground_recall, t_offset> of a chain against regions; nulls without either."""
    c, r = _c(chain), _c(regions)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v) / F.size(a)
    near = lambda s, g: G.span_offset(s["t0"], s["t1"], g["t0"], g["t1"]) <= t_tol
    spatial = mean(F.transform(c, lambda s: F.coalesce(F.array_max(F.transform(F.filter(r, lambda g: near(s, g)), lambda g: G.iou(s["box"], g["box"]))), F.lit(0.0))))
    recall = mean(F.transform(r, lambda g: F.exists(c, lambda s: (G.iou(s["box"], g["box"]) >= 0.5) & near(s, g)).cast("double")))
    offset = mean(F.transform(c, lambda s: F.array_min(F.transform(r, lambda g: G.span_offset(s["t0"], s["t1"], g["t0"], g["t1"]))).cast("double")))
    ok = c.isNotNull() & (F.size(r) > 0)
    return F.struct(F.when(ok, grounding(c, r)).alias("ground_st"), F.when(ok, spatial).alias("ground_spatial"), F.when(ok, recall).alias("ground_recall"), F.when(ok, offset).alias("t_offset"))


def greedy_match(pred, ref) -> Column:
    """STRUCT<pairs, score>: reference steps matched one to one, the most alike first, ties by the later steps.

    All pairs of one chain's steps are sorted once, then a fold takes those whose both ends are free.
    """
    p, r = _c(pred), _c(ref)
    pair = lambda s, i, g, j: F.struct((T.jaccard(s["answer"], g["answer"]) * (0.5 + 0.5 * st_iou(s, g))).alias("sim"), j.cast("int").alias("j"), i.cast("int").alias("i"))
    sims = F.flatten(F.transform(r, lambda g, j: F.transform(p, lambda s, i: pair(s, i, g, j))))
    ordered = F.filter(F.reverse(F.array_sort(sims)), lambda x: x["sim"] > 0)
    start = F.struct(F.array().cast("array<struct<j:int,i:int>>").alias("pairs"), F.lit(0.0).alias("total"))

    def take(a, x):
        free = ~F.exists(a["pairs"], lambda q: (q["j"] == x["j"]) | (q["i"] == x["i"]))
        return F.struct(F.when(free, F.array_append(a["pairs"], F.struct(x["j"].alias("j"), x["i"].alias("i")))).otherwise(a["pairs"]).alias("pairs"), F.when(free, a["total"] + x["sim"]).otherwise(a["total"]).alias("total"))

    return F.aggregate(ordered, start, take, lambda a: F.struct(a["pairs"].alias("pairs"), (a["total"] / F.greatest(F.lit(1), F.size(r))).alias("score")))


def order_violations(pred, ref, pairs) -> Column:
    """STRUCT<violations, edges>: reference dependencies whose matches are missing, reversed or not linked."""
    p, r, m = _c(pred), _c(ref), _c(pairs)
    edges = F.flatten(F.transform(r, lambda g, k: F.transform(g["deps"], lambda j: F.struct(j.alias("j"), k.cast("int").alias("k")))))
    of = lambda j: F.get(F.filter(m, lambda q: q["j"] == j), 0)["i"]
    bad = F.filter(edges, lambda e: F.coalesce((of(e["j"]) >= of(e["k"])) | ~F.array_contains(F.get(p, of(e["k"]))["deps"], of(e["j"])), F.lit(True)))
    return F.struct(F.size(bad).alias("violations"), F.size(edges).alias("edges"))


def process(df: DataFrame, pred: str, ref: str, out: str = "process", beta: float = 0.5) -> DataFrame:
    """Adds likeness of a chain to its reference less a penalty for broken order, 0 at least."""
    d = df.withColumn("_m", greedy_match(pred, ref)).withColumn("_v", order_violations(pred, ref, F.col("_m")["pairs"]))
    penalty = F.when(F.col("_v.edges") > 0, beta * F.col("_v.violations") / F.col("_v.edges")).otherwise(0.0)
    value = F.when(F.col(pred).isNotNull() & F.col(ref).isNotNull(), F.greatest(F.lit(0.0), F.col("_m.score") - penalty)).otherwise(0.0)
    return d.withColumn(out, value).drop("_m", "_v")


def process_best(df: DataFrame, pred: str, refs: str, out: str = "process", beta: float = 0.5) -> DataFrame:
    """Adds the best score of a chain over an array of references; 0 without a chain or any."""
    def one(ref):
        m = greedy_match(pred, ref)
        v = order_violations(pred, ref, m["pairs"])
        return F.greatest(F.lit(0.0), m["score"] - F.when(v["edges"] > 0, beta * v["violations"] / v["edges"]).otherwise(0.0))

    return df.withColumn(out, F.when(F.col(pred).isNotNull(), F.coalesce(F.array_max(F.transform(refs, one)), F.lit(0.0))).otherwise(0.0))


def necessity(deltas, delta: float, eps: float, gamma: float) -> Column:
    """Share of steps whose loss matters, less a multiple of the share that changes nothing; 0 without steps."""
    d, n = _c(deltas), F.size(_c(deltas))
    share = lambda f: F.size(F.filter(d, f)) / n
    return F.when(n > 0, share(lambda x: x > delta) - gamma * share(lambda x: x <= eps)).otherwise(0.0)


def necessity_by(df: DataFrame, by: list[str], value: str, delta: float, eps: float, gamma: float) -> DataFrame:
    """(by, necessity) over the rows of each group: two counts, no list."""
    n, x = F.count(value), F.col(value)
    return df.groupBy(*by).agg(F.when(n > 0, F.count_if(x > delta) / n - gamma * F.count_if(x <= eps) / n).otherwise(0.0).alias("necessity"))


def mix(weights: dict[str, float]) -> Column:
    """Weighted sum of reward columns."""
    return sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))


def group_advantage(df: DataFrame, group: str, reward: str, floor: float = 1e-6) -> DataFrame:
    """Adds the reward's deviation from its group's mean in standard deviations, null in a group without spread.

    A join with the groups' statistics and not a window, so that a large group is not sorted in one task.
    """
    s = df.groupBy(group).agg(F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_sd"))
    value = F.when(F.col("_sd") >= floor, (F.col(reward) - F.col("_mean")) / F.col("_sd"))
    return df.join(s, group).withColumn("advantage", value).drop("_mean", "_sd")


REWARDS = {"outcome": outcome, "outcome_lenient": outcome_lenient, "format": format_tags, "format_chain": format_chain, "grounding": grounding, "exact": exact}
