"""Evaluation items, training records and their samples, from question files, chains and result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pramana.functions import codec as C
from pramana.functions import geometry as G
from pramana.functions import text as T
from pramana.functions.joins import dealt
from pramana.operators.curate import draw_key

# Prompts, and the families of question codes.
DESCRIPTIVE = {"exist": "\nAnswer with yes or no.", "count": "\nAnswer with a number.", "query_color": "\nAnswer with a single word.", "query_material": "\nAnswer with a single word.", "query_shape": "\nAnswer with a single word."}
ANY_CORRECT = "\nOne or more options may be correct. Answer with the letters of all correct options, separated by commas. If none are correct, answer 'none'."
ONE_CORRECT = "\nExactly one option is correct. Answer with the letter of the correct option."
IS_CORRECT = "\nIs this option correct? Answer yes or no."
FAMILIES = {"CW": "causal", "CH": "causal", "TN": "temporal", "TC": "temporal", "TP": "temporal", "DC": "descriptive", "DL": "descriptive", "DO": "descriptive"}
SHIFTS = [-20, -12, 12, 20]


def letter(i) -> Column:
    return F.substring(F.lit("ABCDEFGH"), i + 1, F.lit(1))


def lettered(options) -> Column:
    """``A. first`` and so on, one string for each option."""
    return F.transform(options, lambda o, i: F.concat(letter(i), F.lit(". "), o))


def listed_prompt(question, options, end: str) -> Column:
    return F.concat(question, F.lit("\n"), F.array_join(lettered(options), "\n"), F.lit(end))


def option_prompt(question, i, choice) -> Column:
    return F.concat(question, F.lit("\nOption "), letter(i), F.lit(": "), choice, F.lit(IS_CORRECT))


def described(subtype) -> Column:
    """What a descriptive question asks for; an unknown subtype asks for a word."""
    out = F.lit(DESCRIPTIVE["query_color"])
    for k, v in DESCRIPTIVE.items():
        out = F.when(subtype == k, v).otherwise(out)
    return out


def clevrer_items(questions: DataFrame, mode: str = "multi") -> DataFrame:
    """(id, qid, question_type, prompt, gold, options, option): one item for each question, or for each option of those with choices.

    questions: scene_index, question_id, question, question_type, question_subtype, answer, choices (choice, answer).
    """
    q = questions.withColumn("qid", F.concat_ws("_", F.col("scene_index").cast("string"), F.col("question_id").cast("string")))
    is_open = F.col("question_type") == "descriptive"
    none = F.lit(None).cast("array<string>")
    plain = q.where(is_open).select(F.col("qid").alias("id"), "qid", "question_type", F.concat("question", described(F.coalesce("question_subtype", F.lit("query_color")))).alias("prompt"), T.normalize_short("answer").alias("gold"), none.alias("options"), F.lit(None).cast("int").alias("option"))
    closed = q.where(~is_open)
    if mode == "option":
        e = closed.select("qid", "question", "question_type", F.posexplode("choices").alias("option", "c"))
        rest = e.select(F.concat_ws("_", "qid", F.col("option").cast("string")).alias("id"), "qid", "question_type", option_prompt(F.col("question"), F.col("option"), F.col("c.choice")).alias("prompt"), F.when(F.col("c.answer") == "correct", "yes").otherwise("no").alias("gold"), none.alias("options"), "option")
    else:
        options = F.transform("choices", lambda c: c["choice"])
        rest = closed.select(F.col("qid").alias("id"), "qid", "question_type", listed_prompt(F.col("question"), options, ANY_CORRECT).alias("prompt"), T.gold_letters(F.transform("choices", lambda c: c["answer"] == "correct")).alias("gold"), options.alias("options"), F.lit(None).cast("int").alias("option"))
    return plain.unionByName(rest)


def family(code) -> Column:
    """The family of a question code; of an unknown one the code in lower case."""
    table = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lower(code))


def nextqa_items(rows: DataFrame, mode: str = "multi", ids: DataFrame | None = None) -> DataFrame:
    """(id, qset, question_type, frames_key, prompt, gold, options) of rows (video, qid, type, question, right, options), only of listed ids (qset) if given."""
    r = rows.withColumn("qset", F.concat_ws("_", F.col("video").cast("string"), F.col("qid").cast("string")))
    if ids is not None:
        r = keep_ids(r, ids, "qset")
    asked = F.concat("question", F.lit("?"))
    head = [F.col("qset"), family(F.col("type")).alias("question_type"), F.col("video").cast("string").alias("frames_key")]
    if mode == "option":
        e = r.select("*", F.posexplode("options").alias("i", "o"))
        return e.select(F.concat_ws("_", "qset", F.col("i").cast("string")).alias("id"), *head, option_prompt(asked, F.col("i"), F.col("o")).alias("prompt"), F.when(F.col("i") == F.col("right"), "yes").otherwise("no").alias("gold"), F.lit(None).cast("array<string>").alias("options"))
    return r.select(F.col("qset").alias("id"), *head, listed_prompt(asked, F.col("options"), ONE_CORRECT).alias("prompt"), letter(F.col("right").cast("int")).alias("gold"), "options")


def causalvqa_items(rows: DataFrame, mode: str = "multi") -> DataFrame:
    """(id, qset, question_type, video, difficulty, prompt, gold, options, option, yes_no): an item for each option set of a question, or for each option.

    rows: qid, type, question, difficulty, video, set (1 or 2), options, gold (the number of the right option, from 1); a
    set without a number has no answer and is left out.
    """
    right = F.col("gold").try_cast("int")
    r = rows.withColumn("_right", right).where("_right is not null").withColumn("qset", F.concat_ws("_", F.col("qid").cast("string"), F.col("set").cast("string")))
    asked = F.regexp_replace(F.trim("question"), r'^"+|"+$', "")
    head = [F.col("qset"), F.lower("type").alias("question_type"), "video", "difficulty"]
    if mode == "option":
        e = r.select("*", F.posexplode("options").alias("option", "o"))
        return e.select(F.concat_ws("_", "qset", F.col("option").cast("string")).alias("id"), *head, option_prompt(asked, F.col("option"), F.col("o")).alias("prompt"), F.when(F.col("option") + 1 == F.col("_right"), "yes").otherwise("no").alias("gold"), F.lit(None).cast("array<string>").alias("options"), "option", F.lit(True).alias("yes_no"))
    return r.select(F.col("qset").alias("id"), *head, listed_prompt(asked, F.col("options"), ONE_CORRECT).alias("prompt"), letter(F.col("_right") - 1).alias("gold"), "options", F.lit(None).cast("int").alias("option"), F.lit(False).alias("yes_no"))


#: Builders of items by the name of their benchmark; each takes the rows of its reader and a mode.
BENCHMARKS = {"clevrer": clevrer_items, "causalvqa": causalvqa_items, "nextqa": nextqa_items}


def benchmark_items(name: str, rows: DataFrame, mode: str = "multi", **more) -> DataFrame:
    """The items of a benchmark by its name; an error names those that are known."""
    if name not in BENCHMARKS:
        raise ValueError(f"{name} is no benchmark here: {', '.join(sorted(BENCHMARKS))}")
    return BENCHMARKS[name](rows, mode, **more)


def score_items(items: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Adds pred, correct, option_correct and option_total: letters where there are options, else a word whose digits mean yes or no where that is asked.

    items: gold, options (null: none), yes_no.
    """
    word = T.normalize_short(prediction)
    word = F.when(F.col("yes_no") & word.rlike("^[0-9]+$"), F.when(word == "0", "no").otherwise("yes")).otherwise(word)
    n = F.size("options")
    pred = F.when(F.col("options").isNull(), word).otherwise(T.parse_letters(prediction, n))
    d = items.withColumn("pred", pred)
    agree = F.size(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.contains(F.col("pred"), letter(i)) == F.contains(F.col("gold"), letter(i))))
    return d.withColumn("correct", (F.col("pred") == F.col("gold")).cast("int")).withColumn("option_correct", F.when(F.col("options").isNotNull(), agree)).withColumn("option_total", F.when(F.col("options").isNotNull(), n))


# ---- filters and orders


def keep_ids(items: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return items.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def keep_with_regions(items: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Items that have a region of their own or of their question."""
    return items.join(regions.where(F.size("regions") > 0).select(key).distinct(), key, "left_semi")


def first_items(items: DataFrame, most: int, order: str) -> DataFrame:
    return items.orderBy(order).limit(most)


def by_video(items: DataFrame, video: str = "video", key: str = "id") -> DataFrame:
    """Items of a video together and in order, each video in one task, so that its frames are opened once."""
    return items.repartition(video).sortWithinPartitions(video, key)


def frames_key(path) -> Column:
    """The name of a path's last part without its ending."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def under(root: str, path) -> Column:
    """A path below a root, an absolute one as it is."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


# ---- records and exports


def question_records(questions: DataFrame) -> DataFrame:
    """(problem_id, question_type, subtype, problem_type, problem, options, gold, solution) of every question."""
    items = clevrer_items(questions)
    types = questions.select(F.concat_ws("_", F.col("scene_index").cast("string"), F.col("question_id").cast("string")).alias("id"), F.col("question_subtype").alias("subtype"))
    r = items.join(types, "id")
    kind = F.when(F.col("question_type") != "descriptive", "multiple choice").when(F.col("subtype") == "count", "numerical").otherwise("free-form")
    none = F.array().cast("array<string>")
    return r.select(F.col("id").alias("problem_id"), "question_type", "subtype", kind.alias("problem_type"), F.col("prompt").alias("problem"), F.coalesce(lettered("options"), none).alias("options"), "gold", F.concat(F.lit("<answer>"), "gold", F.lit("</answer>")).alias("solution"))


def sft_records(chains: DataFrame, questions: DataFrame) -> DataFrame:
    """(problem_id, question_type, problem, response, gold) of chains (scene_index, question_id, choice_id, question_type, chain, final_answer): those of an option ask about it alone."""
    q = questions.select("scene_index", "question_id", "question", "question_subtype", "choices")
    j = chains.join(dealt(q), ["scene_index", "question_id"])
    choice = F.get("choices", F.col("choice_id"))["choice"]
    is_open = F.col("question_type") == "descriptive"
    problem = F.when(is_open, F.concat("question", described(F.coalesce("question_subtype", F.lit("query_color"))))).otherwise(option_prompt(F.col("question"), F.col("choice_id"), choice))
    return j.select(F.concat_ws("_", F.col("scene_index").cast("string"), F.col("question_id").cast("string"), F.when(~is_open, F.col("choice_id").cast("string"))).alias("problem_id"), "question_type", problem.alias("problem"), C.render("chain", "final_answer").alias("response"), F.col("final_answer").alias("gold"))


def option_records(records: DataFrame) -> DataFrame:
    """One yes or no record for each option of records with options, with the chains of that option; others pass.

    records: problem_id, question_type, problem, options (``A. text``), gold, chains (choice_id, ...).
    """
    is_open = F.col("question_type") == "descriptive"
    e = records.where(~is_open).select("*", F.posexplode("options").alias("i", "o"))
    mark, text = F.substring_index("o", ". ", 1), F.regexp_replace("o", r"^[^.]*\. ", "")
    gold = F.when(F.contains("gold", mark), "yes").otherwise("no")
    own = F.filter("chains", lambda c: c["choice_id"] == F.col("i"))
    each = e.select(F.concat_ws("_", "problem_id", F.col("i").cast("string")).alias("problem_id"), "question_type", option_prompt(F.substring_index("problem", "\n", 1), F.col("i"), text).alias("problem"), gold.alias("gold"), own.alias("chains"))
    return records.where(is_open).select("problem_id", "question_type", "problem", "gold", "chains").unionByName(each)


def bare_answers(records: DataFrame) -> DataFrame:
    """The same records answered without a chain."""
    return records.drop("chain").withColumn("response", F.concat(F.lit("<answer>"), "gold", F.lit("</answer>")))


def rescaled(chain) -> Column:
    """A chain of sampled frames on the positions of the whole clip: each span is the stretch around its first frame."""
    def one(s):
        a, b = G.rescale_span(s["t0"])
        return s.withField("t0", a.cast("int")).withField("t1", b.cast("int"))

    return F.transform(chain, one)


def manifest(records: DataFrame, by: list[str], answer: str = "gold", most: int = 12) -> DataFrame:
    """(by, answer, n): the most frequent answers of each group, of equally frequent ones the first in order."""
    n = records.groupBy(*by, answer).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), answer)
    return n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


# ---- samples: every draw is the order of a hash of the seed and the key


def stratified_records(records: DataFrame, per_group: int, group: list[str], key: str, seed: int = 0) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(draw_key(seed, key), key)
    return records.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_group).drop("_r")


def drawn(records: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n records drawn by hash."""
    return records.orderBy(draw_key(seed, key), key).limit(n)


def training_pool(rows: DataFrame, videos: int, per_family: int, seed: int = 0) -> DataFrame:
    """Questions of some drawn videos, at most so many of each family. rows: (video, qid, type)."""
    chosen = drawn(rows.select("video").distinct(), videos, "video", seed)
    r = rows.join(chosen, "video", "left_semi").withColumn("family", family(F.col("type"))).withColumn("problem_id", F.concat_ws("_", F.lit("nq"), F.col("video").cast("string"), F.col("qid").cast("string")))
    return stratified_records(r, per_family, ["family"], "problem_id", seed)


def validation_ids(rows: DataFrame, questions: int, seed: int = 0) -> DataFrame:
    """(id): a third of ``questions`` of each family."""
    r = rows.select(F.concat_ws("_", F.col("video").cast("string"), F.col("qid").cast("string")).alias("id"), family(F.col("type")).alias("family"))
    return stratified_records(r, questions // 3, ["family"], "id", seed).select("id")


def mixing_arms(made_sft: DataFrame, real_sft: DataFrame, made_rl: DataFrame, real_rl: DataFrame, n_made: int, n_real: int, n_rl: int, seed: int = 0) -> DataFrame:
    """(arm, origin, key, gold, bare): the five training sets of made and real records (key, gold).

    mixed_chains and mixed_plain hold n_made made ones and n_real real ones, half yes and half no, with a chain or bare;
    real_chains the real ones of these; mixed_rl n_rl of either source; real_rl twice as many real ones.
    """
    tag = lambda df, arm, origin, bare=False: df.select(F.lit(arm).alias("arm"), F.lit(origin).alias("origin"), "key", "gold", F.lit(bare).alias("bare"))
    a = drawn(made_sft, n_made, "key", seed)
    b = stratified_records(real_sft.where(F.col("gold").isin("yes", "no")), n_real // 2, ["gold"], "key", seed)
    c, d = drawn(made_rl, n_rl, "key", seed), drawn(real_rl, 2 * n_rl, "key", seed)
    parts = [tag(a, "mixed_chains", "made"), tag(b, "mixed_chains", "real"), tag(a, "mixed_plain", "made", True), tag(b, "mixed_plain", "real", True), tag(b, "real_chains", "real"), tag(c, "mixed_rl", "made"), tag(drawn(d, n_rl, "key", seed), "mixed_rl", "real"), tag(d, "real_rl", "real")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_sample(rows: DataFrame, n_each: int, seed: int = 0) -> DataFrame:
    """One drawn item of each of n_each drawn questions of every file, of the items whose chain cites something. rows: (tag, qid, id, chain)."""
    r = rows.where(F.size("chain") > 0)
    one = r.withColumn("_i", F.row_number().over(Window.partitionBy("tag", "qid").orderBy(draw_key(seed, "id"), "id"))).where("_i = 1")
    w = Window.partitionBy("tag").orderBy(draw_key(seed, "qid"), "qid")
    return one.withColumn("_q", F.row_number().over(w)).where(F.col("_q") <= n_each).drop("_i", "_q")


def first_of_problem(records: DataFrame, problem: str, order: str) -> DataFrame:
    """The first record of each problem."""
    rest = [c for c in records.columns if c != problem]
    return records.groupBy(problem).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(problem, "_r.*")


# ---- grounding of teachers' steps


def ground_steps(steps: DataFrame, detections: DataFrame, least: float = 0.01) -> DataFrame:
    """Adds the best detection and a status to steps (id, n, video, entity, frame): of the frame and its two neighbours the one with
    the best score, the step's own and then the earlier frame of equal ones.

    detections: (video, phrase, frame, score, box). Statuses: kept, undetected, and degenerate for a box that is hardly wide or high.
    """
    near = steps.select("id", "n", "video", F.col("entity").alias("phrase"), F.col("frame").alias("own"), F.explode(F.array(F.col("frame"), F.col("frame") - 1, F.col("frame") + 1)).alias("frame"))
    hit = near.join(detections, ["video", "phrase", "frame"])
    ahead = F.struct("score", (F.col("frame") == F.col("own")).cast("int"), -F.col("frame"))
    best = hit.groupBy("id", "n").agg(F.max_by(F.struct("frame", "box"), ahead).alias("b"))
    b = F.col("b.box")
    thin = (b["x1"] - b["x0"] <= least) | (b["y1"] - b["y0"] <= least)
    status = F.when(F.col("b").isNull(), "undetected").when(thin, "degenerate").otherwise("kept")
    return steps.join(best, ["id", "n"], "left").select(*steps.columns, status.alias("status"), F.when(status == "kept", F.col("b.frame")).alias("found_frame"), F.when(status == "kept", b).alias("box"))


def grounded_records(questions: DataFrame, grounded: DataFrame, seed: int = 0) -> DataFrame:
    """(problem_id, option, gold, n_steps): for each question with a step kept a yes record of the right option and a no record of a drawn wrong one."""
    n = grounded.where("status = 'kept'").groupBy("id").agg(F.count("*").alias("n_steps"))
    d = G.hash_draw(4, F.lit(seed), "id")
    wrong = (d + F.when(d >= F.col("right"), 1).otherwise(0)).cast("int")
    both = F.array(F.struct(F.col("right").cast("int").alias("option"), F.lit("yes").alias("gold")), F.struct(wrong.alias("option"), F.lit("no").alias("gold")))
    return questions.join(n, "id").select("id", "n_steps", F.explode(both).alias("r")).select(F.concat_ws("_", F.col("id").cast("string"), F.col("r.option").cast("string")).alias("problem_id"), "r.option", "r.gold", "n_steps")


# ---- corruption


def corrupt_answer(answer, *key, seed: int = 0) -> Column:
    """An answer with one attribute word changed for another of its kind, else yes and no exchanged, else its frame moved; null if
    nothing can be changed. What is changed, and to what, follows a hash of the key."""
    vocab = [T.COLORS, T.MATERIALS, T.SHAPES]
    words = F.split(answer, r"\s+")
    bare = lambda w: F.btrim(w, F.lit(",;."))
    places = F.filter(F.transform(words, lambda w, i: F.when(bare(w).isin(*sum(vocab, [])), i)), lambda i: i.isNotNull())
    at = F.get(places, (G.hash_draw(F.greatest(F.size(places), F.lit(1)), F.lit(seed), *key, F.lit("word"))).cast("int"))
    old = bare(F.get(words, at))
    new = F.lit(None).cast("string")
    for v in vocab:
        others = F.filter(F.array(*map(F.lit, v)), lambda x: x != old)
        new = F.when(old.isin(*v), F.get(others, G.hash_draw(len(v) - 1, F.lit(seed), *key, F.lit("value")).cast("int"))).otherwise(new)
    swapped = F.array_join(F.transform(words, lambda w, i: F.when(i == at, F.replace(w, old, new)).otherwise(w)), " ")
    low = F.lower(T.strip(answer))
    frame = F.regexp_extract(answer, r"frame (\d+)", 1)
    shift = F.get(F.array(*map(F.lit, SHIFTS)), G.hash_draw(len(SHIFTS), F.lit(seed), *key, F.lit("frame")).cast("int"))
    moved = F.replace(answer, F.concat(F.lit("frame "), frame), F.concat(F.lit("frame "), F.greatest(F.lit(0), frame.try_cast("int") + shift).cast("string")))
    return F.when(F.size(places) > 0, swapped).when(low.startswith("yes"), "no").when(low.startswith("no"), "yes").when(frame != "", moved)


def corrupt_chain(chain, *key, seed: int = 0) -> Column:
    """STRUCT<at, answer>: a step that the last one rests on, or the last one itself, drawn by hash among those whose answer can be changed, and its changed answer; null if there is none."""
    deps = F.transform(chain, lambda s: s["deps"])
    last = F.size(chain) - 1
    path = F.array_union(C.ancestors(deps, last), F.array(last.cast("int")))
    tried = F.transform(path, lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key], i.cast("string"))).alias("k"), i.alias("at"), corrupt_answer(F.get(chain, i)["answer"], *key, i, seed=seed).alias("answer")))
    first = F.array_min(F.filter(tried, lambda s: s["answer"].isNotNull() & (s["answer"] != F.get(chain, s["at"])["answer"])))
    return F.when(first.isNotNull(), F.struct(first["at"].alias("at"), first["answer"].alias("answer")))


# ---- checks


def checks(df: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """(check, n, bad, status): each rule over all rows in one pass; FAIL or WARN, as the rule says, if a row breaks it or is null there, else PASS."""
    bad = df.agg(F.count("*").alias("n"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"b{k}") for k, (ok, _) in enumerate(rules.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"b{k}").alias("bad"), F.lit(level).alias("level")) for k, (name, (_, level)) in enumerate(rules.items())])
    return bad.select("n", F.explode(rows).alias("r")).select("r.check", "n", "r.bad", F.when(F.col("r.bad") == 0, "PASS").otherwise(F.col("r.level")).alias("status"))


def invalid_reason(chain) -> Column:
    """Why a chain is not valid: the first of no steps, a blank text, a span, a box, a link; null if it is."""
    b = lambda s: s["box"]
    blank = F.exists(chain, lambda s: (T.strip(s["question"]) == "") | (T.strip(s["answer"]) == ""))
    span = F.exists(chain, lambda s: (s["t0"] < 0) | (s["t1"] < s["t0"]))
    box = F.exists(chain, lambda s: ~(b(s)["x0"].between(0, 1) & b(s)["y0"].between(0, 1) & b(s)["x1"].between(0, 1) & b(s)["y1"].between(0, 1) & (b(s)["x1"] > b(s)["x0"]) & (b(s)["y1"] > b(s)["y0"])))
    link = F.exists(F.transform(chain, lambda s, i: F.exists(s["deps"], lambda d: (d < 0) | (d >= i))), lambda x: x)
    return F.when(F.size(chain) == 0, "no_steps").when(blank, "blank").when(span, "span").when(box, "box").when(link, "link")


def named_entities(steps: DataFrame) -> DataFrame:
    """(id, entities): the distinct entities that a chain names, in lower case, in order of their first step. steps: (id, n, entity)."""
    first = steps.where("entity is not null").groupBy("id", F.lower("entity").alias("entity")).agg(F.min("n").alias("n"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "entity"))), lambda s: s["entity"]).alias("entities"))
