"""Reading and writing reasoning chains as text, and operators on their dependency graph.

A chain is ARRAY<STRUCT<question, answer, t0, t1, box, deps: ARRAY<INT>, role>>; deps count from 0 and point back.
Text holds no roles: they are null there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pramana.functions import lines
from pramana.functions.geometry import box
from pramana.functions.text import strip

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


STEP_TYPE = "struct<question:string,answer:string,t0:int,t1:int,box:struct<x0:double,y0:double,x1:double,y1:double>,deps:array<int>,role:string>"
PARSED_TYPE = f"struct<chain:array<{STEP_TYPE}>,answer:string,n_lines:int,n_steps:int,has_tags:boolean>"


def valid_step(s) -> Column:
    b = s["box"]
    inside = lambda v: v.between(0, 1)
    return (strip(s["question"]) != "") & (strip(s["answer"]) != "") & (s["t0"] >= 0) & (s["t1"] >= s["t0"]) & inside(b["x0"]) & inside(b["y0"]) & inside(b["x1"]) & inside(b["y1"]) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])


def valid_chain(chain) -> Column:
    """Not empty, every step valid, dependencies strictly backward."""
    chain = _c(chain)
    back = F.forall(F.transform(chain, lambda s, i: F.forall(s["deps"], lambda d: (d >= 0) & (d < i))), lambda x: x)
    return (F.size(chain) > 0) & F.forall(chain, valid_step) & back


def parse(df, text: str = "raw", out: str = "parsed"):
    """Adds STRUCT<chain, answer, n_lines, n_steps, has_tags>; chain is null if the text is no valid one, all is null for a null text.

    A batch of texts is split into lines, matched and linked as whole columns. Of a repeated number the last step counts,
    numbers not seen before go. Declared not deterministic, so that it is not repeated in filters: a text is read once.
    """
    return df.withColumn(out, F.arrow_udf(lines.parse, PARSED_TYPE).asNondeterministic()(F.col(text).cast("string")))


def thousandths(v) -> Column:
    """A number from 0 on with three places, as its exact binary value rounds: to the nearest, ties to the even digit.

    Times 2^30 the number is a whole part and a rest that is exact in a double. The whole part times 1000 is split into
    thousandths and what is left, so that a half is met by comparing two exact numbers; no decimal text of the number is rounded.
    """
    scaled = v * F.lit(float(1 << 30))
    whole = F.floor(scaled)
    rest, units = (scaled - whole) * 1000, whole * 1000
    low, half = F.shiftright(units, 30), F.lit(1 << 29) - units.bitwiseAND(F.lit((1 << 30) - 1))
    n = low + F.when(rest > half, 1).when(rest == half, low % 2).otherwise(0)
    text = F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    return F.when((v >= 0) & (v < 1_000_000), text).otherwise(F.format_string("%.3f", v))


def render_step(s, i) -> Column:
    b = s["box"]
    numbers = F.concat_ws(",", *[thousandths(b[k]) for k in ("x0", "y0", "x1", "y1")])
    deps = F.array_join(F.transform(s["deps"], lambda d: (d + 1).cast("string")), ",")
    return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Q: "), s["question"], F.lit(" | A: "), s["answer"], F.lit(" | E: t="), s["t0"].cast("string"), F.lit("-"), s["t1"].cast("string"), F.lit(" box=("), numbers, F.lit(") | deps="), deps)


def render(chain, answer) -> Column:
    """A chain as text."""
    return F.concat(F.lit("<think>\n"), F.array_join(F.transform(_c(chain), render_step), "\n"), F.lit("\n</think>\n<answer>"), _c(answer), F.lit("</answer>"))


def step_spans(text) -> Column:
    """Start and end character of every step line inside the first think tag, whatever ends its lines; empty for a null text."""
    return F.arrow_udf(lines.step_spans, "array<struct<start:int,end:int>>")(_c(text).cast("string"))


def closure(deps, i) -> Column:
    """Places of all steps that depend on step i, directly or not: one pass, as dependencies point back."""
    i = F.lit(i) if isinstance(i, int) else i
    start = F.array(i.cast("int"))
    reached = F.aggregate(F.transform(_c(deps), lambda d, k: F.struct(k.cast("int").alias("k"), d.alias("d"))), start, lambda acc, s: F.when(F.arrays_overlap(s["d"], acc), F.array_append(acc, s["k"])).otherwise(acc))
    return F.array_except(reached, start)


def ancestors(deps, i) -> Column:
    """Places of all steps that step i rests on: one pass backward."""
    i = F.lit(i) if isinstance(i, int) else i
    rows = F.reverse(F.transform(_c(deps), lambda d, k: F.struct(k.cast("int").alias("k"), d.alias("d"))))
    reached = F.aggregate(rows, F.array(i.cast("int")), lambda acc, s: F.when(F.array_contains(acc, s["k"]), F.array_union(acc, s["d"])).otherwise(acc))
    return F.array_except(reached, F.array(i.cast("int")))


def without_step(chain, deps, i) -> Column:
    """The chain without step i and all that depends on it, dependencies renumbered."""
    i = F.lit(i) if isinstance(i, int) else i
    keep = F.array_except(F.sequence(F.lit(0), F.size(_c(deps)) - 1), F.array_union(closure(deps, i), F.array(i.cast("int"))))

    def one(k):
        s = F.get(_c(chain), k)
        new = F.transform(F.filter(s["deps"], lambda d: F.array_contains(keep, d)), lambda d: (F.array_position(keep, d) - 1).cast("int"))
        return F.struct(s["question"].alias("question"), s["answer"].alias("answer"), s["t0"].alias("t0"), s["t1"].alias("t1"), s["box"].alias("box"), new.alias("deps"), s["role"].alias("role"))

    return F.transform(keep, one)


def decisive(chain, question_type) -> Column:
    """Steps that decide the answer: observations of predictive and counterfactual chains, else the last.

    A step with a role is an observation by its role alone; one without, as text gives them, by its first word.
    """
    chain = _c(chain)
    observed = F.filter(chain, lambda s: F.when(s["role"].isNotNull(), s["role"] == "observe").otherwise(s["question"].startswith("Do ")))
    return F.when(_c(question_type).isin("predictive", "counterfactual") & (F.size(observed) > 0), observed).otherwise(F.slice(chain, -1, 1))


def regions(chain) -> Column:
    """Sorted distinct regions of a chain that are not the whole frame."""
    some = F.filter(_c(chain), lambda s: ~((s["box"]["x0"] == 0) & (s["box"]["y0"] == 0) & (s["box"]["x1"] == 1) & (s["box"]["y1"] == 1)))
    return F.array_sort(F.array_distinct(F.transform(some, lambda s: F.struct(s["t0"].alias("t0"), s["t1"].alias("t1"), s["box"].alias("box")))))


__all__ = ["box", "parse", "render", "regions"]
