"""Sampling, mixing and assembling question sets, audits and training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pramana.functions.geometry import hash_draw
from pramana.operators.stats import numbered


def draw_key(seed: int, *key) -> Column:
    """A sort key that depends on the seed and the key alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]))


def stratified_questions(items: DataFrame, per_type: int, question: str = "qset", kind: str = "question_type", seed: int = 0) -> DataFrame:
    """All items of ``per_type`` questions of each type, drawn by hash; options of a question stay together."""
    q = items.groupBy(question).agg(F.min(kind).alias("_kind")).withColumn("_key", draw_key(seed, question))
    w = Window.partitionBy("_kind").orderBy("_key", question)
    chosen = q.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_type).select(question)
    return items.join(chosen, question, "left_semi")


def limit_questions(items: DataFrame, n: int, question: str = "qset") -> DataFrame:
    """All items of the first n questions."""
    return items.join(items.select(question).distinct().orderBy(question).limit(n), question, "left_semi")


def balanced_options(items: DataFrame, per_answer: dict[str, int], kind: str, answer: str, key: str, seed: int = 0) -> DataFrame:
    """Up to a stated number of items of each answer in each type, drawn by hash."""
    w = Window.partitionBy(kind, answer).orderBy(draw_key(seed, key), key)
    most = F.coalesce(*[F.when(F.col(answer) == a, n) for a, n in per_answer.items()])
    return items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def one_wrong_option(n_options, right, *key, seed: int = 0) -> Column:
    """Number of one wrong option, drawn by hash."""
    d = hash_draw(n_options - 1, F.lit(seed), *key)
    return d + F.when(d >= right, 1).otherwise(0)


def mix(sources: dict[str, DataFrame], seed: int = 0, key: str = "id") -> DataFrame:
    """All rows of all sources with their source, in an order drawn by hash (column ``place_key``)."""
    out = None
    for name, df in sorted(sources.items()):
        part = df.withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("place_key", draw_key(seed, "origin", key))


def explode_options(items: DataFrame, options: str = "options", right: str = "right") -> DataFrame:
    """One yes or no item for each option of a question."""
    e = items.select("*", F.posexplode(options).alias("option", "option_text"))
    return e.withColumn("item_id", F.concat_ws("_", F.col("qid").cast("string"), "option")).withColumn("gold", F.when(F.col("option") == F.col(right), "yes").otherwise("no"))


def attach_chains(records: DataFrame, chains: DataFrame, key: str, order: str) -> DataFrame:
    """Records with the chains of their key in order, an empty array without any."""
    g = chains.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in chains.columns if c not in (key, order)]))).alias("chains"))
    return records.join(g, key, "left").withColumn("chains", F.coalesce("chains", F.array().cast(g.schema["chains"].dataType)))


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` that are not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def audit_rates(judged: DataFrame) -> DataFrame:
    """Rates of yes, no and unsure for each key of names like ``c3_s1_onbox``, and their number."""
    j = judged.select(F.regexp_extract("name", r"^c\d+(?:_s\d+)?_(\w+)$", 1).alias("key"), "value").where("key <> ''")
    rate = lambda v: (F.count_if(F.col("value") == v) / F.count("*")).alias(v)
    return j.groupBy("key").agg(F.count("*").alias("n"), rate("yes"), rate("no"), rate("unsure"))


def onbox_given_visible(judged: DataFrame) -> DataFrame:
    """Share on the box among steps judged visible."""
    part = lambda k: judged.where(F.col("name").endswith(f"_{k}")).select(F.regexp_replace("name", f"_{k}$", "").alias("step"), F.col("value").alias(k))
    j = part("visible").where("visible = 'yes'").join(part("onbox"), "step")
    return j.agg(F.count("*").alias("n"), (F.count_if(F.col("onbox") == "yes") / F.nullif(F.count("*"), F.lit(0))).alias("rate"))


def log_windows(log: DataFrame, size: int, order: str = "step", part: str | None = None) -> DataFrame:
    """Means over every ``size`` rows of a log, in its order: those columns of a training log that it has.

    reward, r_ columns, comp_len and steps_credited over all rows; kl, grad_norm and kl_clip_frac over rows that were not
    skipped, 0 if all were. A window is counted in rows, so gaps and restarts of the step do not matter.
    """
    w = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1 if part else F.col("_place")
    log = log if part else numbered(log, order, "_place")
    log = log.withColumn("window", F.floor(w / size))
    run = ~F.coalesce(F.col("skipped"), F.lit(False))
    n, has = F.count("*"), log.columns
    means = [F.avg(c).alias(c) for c in has if c in ("reward", "comp_len", "steps_credited") or c.startswith("r_")]
    means += [F.coalesce(F.avg(F.when(run, F.col(c))), F.lit(0.0)).alias(c) for c in ("kl", "grad_norm", "kl_clip_frac") if c in has]
    per_step = (F.max_by("sec", order) - F.min_by("sec", order)) / F.greatest(n - 1, F.lit(1))
    return log.groupBy(*([part] if part else []), "window").agg(n.alias("n"), F.min(order).alias("first_step"), F.max(order).alias("last_step"), (1 - F.count_if(run) / n).alias("skip_rate"), *means, per_step.alias("sec_per_step"))


def profile_json(df: DataFrame, column: str) -> DataFrame:
    """Keys of a JSON column with their number, kinds and range of numbers."""
    kv = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("key", "v"))
    number = F.col("v").try_cast("double")
    return kv.groupBy("key").agg(F.count("*").alias("n"), F.count_if(number.isNotNull()).alias("n_number"), F.min(number).alias("low"), F.max(number).alias("high"), F.countDistinct("v").alias("kinds"))


def per_question(items: DataFrame, question: str = "qset", kind: str = "question_type") -> DataFrame:
    """Share of options and of questions all of whose options are right, by type and over all."""
    q = items.groupBy(question).agg(F.min(kind).alias(kind), F.min("correct").alias("all_right"), F.sum("correct").alias("right"), F.count("*").alias("n"))
    out = q.groupingSets([[kind], []], kind).agg(F.count("*").alias("questions"), F.avg("all_right").alias("per_question"), (F.sum("right") / F.sum("n")).alias("per_option"), F.grouping(kind).alias("_g"))
    return out.withColumn(kind, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(kind))).drop("_g")


def paired_sets(items: DataFrame, question: str, which: str, kind: str) -> DataFrame:
    """Questions right in both of their option sets; a set that is missing counts as wrong."""
    right = lambda s: F.max(F.when(F.col(which) == s, F.col("correct")).otherwise(0))
    q = items.groupBy(question).agg(F.min(kind).alias(kind), right(1).alias("one"), right(2).alias("two"))
    return q.groupBy(kind).agg(F.count("*").alias("n"), F.avg(F.col("one") * F.col("two")).alias("paired"))


def inferential_mean(summary: DataFrame, kinds: list[str], kind: str = "question_type", value: str = "per_question", n: str = "questions") -> DataFrame:
    """(n, value): the mean of some types' accuracies weighted by their numbers of questions; null without any."""
    some = summary.where(F.col(kind).isin(kinds) & F.col(value).isNotNull())
    return some.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), (F.sum(F.col(value) * F.col(n)) / F.nullif(F.sum(n), F.lit(0))).alias("value"))
