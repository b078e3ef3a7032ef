"""Quality by a sparse rule ensemble: tree paths as conjunctive rules, lasso logistic weights, Spark columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm._spark import table

#: Bound of the training sample.
ROWS = 6000
TREES, DEPTH, CUTS, SHRINK = 24, 3, 24, 0.3
#: Lasso strength, and rules that may carry a weight.
LASSO, MOST_RULES = 0.002, 60
THRESHOLD = 0.3
FEATURES = ("words", "word_length", "kinds", "line_kinds", "line_words", "upper", "digits", "symbols", "runs", "stops", "repeats")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; all are defined for null and empty texts."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.split(t, "\n")
    return {
        "chars": F.length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "kinds": F.size(F.array_distinct(words)).cast("double"),
        "lines": F.size(lines).cast("double"),
        "line_kinds": F.size(F.array_distinct(lines)).cast("double"),
        "upper": F.regexp_count(t, F.lit("[A-Z]")).cast("double"),
        "digits": F.regexp_count(t, F.lit("[0-9]")).cast("double"),
        "symbols": F.regexp_count(t, F.lit(r"[#$%&*|!<>{}=_~^@/\\]")).cast("double"),
        "runs": F.regexp_count(t, F.lit(r"([^\w\s])\1")).cast("double"),
        "stops": F.regexp_count(t, F.lit(r"[.?!](?=\s|$)")).cast("double"),
        "repeats": F.aggregate(words, F.struct(F.lit("").alias("p"), F.lit(0.0).alias("n")), lambda a, w: F.struct(w.alias("p"), (a["n"] + F.when(a["p"] == w, 1.0).otherwise(0.0)).alias("n")), lambda a: a["n"]),
    }


def _ratios() -> dict[str, Column]:
    c, at_least = lambda n: F.col(f"s_{n}"), lambda n: F.greatest(F.col(f"s_{n}"), F.lit(1.0))
    return {
        "words": c("words"),
        "word_length": c("chars") / at_least("words"),
        "kinds": c("kinds") / at_least("words"),
        "line_kinds": c("line_kinds") / at_least("lines"),
        "line_words": c("words") / at_least("lines"),
        "upper": c("upper") / at_least("chars"),
        "digits": c("digits") / at_least("chars"),
        "symbols": c("symbols") / at_least("words"),
        "runs": c("runs") / at_least("words"),
        "stops": c("stops") / at_least("words"),
        "repeats": c("repeats") / at_least("words"),
    }




def with_features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """(kept, f_...) of every row: the columns ``keep`` in one struct, so that no name can clash, and the features."""
    kept = F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept")
    counted = docs.select(kept, *[v.alias(f"s_{k}") for k, v in statistics(F.col(text_col)).items()])
    return counted.select("kept", *[v.alias(f"f_{k}") for k, v in _ratios().items()])


def _grow(x, grad, hess, cuts, rows, depth, path, leaves, rules):
    """One regression tree on gradients; every node's path is a rule."""
    best = None
    if depth < DEPTH and len(rows) >= 20:
        g, h = grad[rows].sum(), hess[rows].sum()
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            slot = np.searchsorted(c, x[rows, j], "right")
            gl = np.cumsum(np.bincount(slot, grad[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(slot, hess[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(slot, minlength=len(c) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < 8) | (len(rows) - nl < 8)] = -1
            k = int(gain.argmax())
            if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, float(c[k]))
    if best is None:
        leaves.append((rows, -SHRINK * grad[rows].sum() / (hess[rows].sum() + 1)))
        return
    _, j, cut = best
    below = x[rows, j] < cut
    for side, part in ((True, rows[below]), (False, rows[~below])):
        longer = path + ((j, cut, side),)
        rules.append(longer)
        _grow(x, grad, hess, cuts, part, depth + 1, longer, leaves, rules)


def _simple(path: tuple) -> tuple:
    """The same rule with one bound for each feature and side."""
    bound: dict = {}
    for j, cut, below in path:
        old = bound.get((j, below))
        bound[j, below] = cut if old is None else (min if below else max)(old, cut)
    return tuple(sorted((j, cut, below) for (j, below), cut in bound.items()))


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, cut, below in rule:
        out &= (x[:, j] < cut) == below
    return out


def _lasso(r: np.ndarray, y: np.ndarray, strength: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for l1 logistic regression; the intercept is free."""
    n, m = r.shape
    z = np.column_stack([r, np.ones(n)])
    v = np.ones(m + 1)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * np.linalg.norm(z @ v) ** 2 / n * 1.02)
    w = np.zeros(m + 1)
    look, t = w, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ look, -30, 30)))
        new = look - rate * (z.T @ (p - y)) / n
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * strength, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look = new + (old - 1) / t * (new - w)
        w = new
    return w[:m], float(w[m])


def learn(x: np.ndarray, y: np.ndarray, trees: int = TREES, strength: float = LASSO, most: int = MOST_RULES) -> dict:
    """{"bias", "rules": [(weight, ((feature number, cut, below?), ...))]} from features and 0/1 labels."""
    p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    alone = {"bias": float(np.log(p / (1 - p))), "rules": []}
    if not len(y) or y.min() == y.max():
        return alone
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(x.shape[1])]
    margin, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    rng = np.random.default_rng(5)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        leaves: list = []
        # each tree sees half of the rows, so that paths differ
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        _grow(x, p - y, p * (1 - p), cuts, rows, 0, (), leaves, found)
        tree = [(r, v) for r, v in leaves]
        for r, v in tree:
            margin[r] += v
    rules = sorted({_simple(p) for p in found})
    if not rules:
        return alone
    columns = np.array([_holds(x, r) for r in rules]).T.astype(float)
    _, first = np.unique(columns, axis=1, return_index=True)
    rules = [rules[i] for i in sorted(first)]
    columns = columns[:, sorted(first)]
    while True:
        w, bias = _lasso(columns, y, strength)
        if (w != 0).sum() <= most:
            break
        strength *= 1.3
    return {"bias": bias, "rules": [(float(v), r) for v, r in zip(w, rules) if v != 0]}


def compiled(model: dict) -> Column:
    """The probability as a column over ``f_`` features."""
    total = F.lit(model["bias"])
    for weight, rule in model["rules"]:
        holds = F.lit(True)
        for j, cut, below in rule:
            f = F.col(f"f_{FEATURES[j]}")
            holds = holds & (f < cut if below else f >= cut)
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, label: str = "quality", kept_apart=None) -> dict:
    """A model from at most ``rows`` labelled rows, drawn by a hash of id and text.

    ``rows`` is the only bound. Null labels, ids and texts are left out; of an id that has several labels the
    largest counts, and each of its rows may be drawn. Without two kinds of labels, as from an empty table, the
    model is a constant.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if kept_apart is not None:
        known = known.where(~kept_apart)
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    names = [f"f_{k}" for k in FEATURES]
    # features are drawn, not texts: a row that comes to the driver has a fixed size
    made = with_features(found.withColumn("h", F.xxhash64("doc_id", "text")), ["y", "h"])
    sample = made.select(F.col("kept.h").alias("h"), F.col("kept.y").alias("y"), *names).orderBy("h", "y", *names).limit(rows).toPandas()
    return learn(sample[names].to_numpy(float).reshape(-1, len(FEATURES)), sample["y"].to_numpy(float))


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """``keep`` (columns of ``docs``, one named score is replaced) and the score of every whole text.

    Each row gets its row, repeated ones and those without an id too. Null and empty texts have all statistics
    zero and score by the rules that hold for that.
    """
    scored = with_features(docs, keep).select("kept", compiled(model).alias("score"))
    return scored.select(*[F.col(f"kept.`{k}`") for k in keep if k.lower() != "score"], "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of held-out rows are not learned from. A row without an id is not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs, labels, kept_apart=apart)
    return score(docs, model, ["doc_id"]).select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
