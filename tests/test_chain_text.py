"""Chain texts whose parts are known because the test puts them together."""

import random
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import functions as F

from pramana.functions import codec, lines
from pramana.sources.files import CHAIN, chain_from_json, chain_to_json

ENDS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", " "]
BLANKS = ["", " ", "\t", "  \t", " ", "　 "]


def made(rng):
    """(text, spans, steps as (question, answer, t0, t1, deps)) of a valid chain."""
    text = rng.choice(["", "intro ✓ ", "[1] Q: "]) + "<think>"
    seen, spans, steps = {}, [], []
    for k in range(rng.randint(1, 6)):
        while rng.random() < 0.3:
            text += rng.choice(BLANKS) + rng.choice(["a note", "", "[x] Q: no", "[1] Q: a | A: b"]) + rng.choice(BLANKS)
            text += rng.choice(ENDS)
        number = rng.choice([k + 1, 7, 10**rng.randint(0, 30)])
        named = [rng.choice([*seen, 99, 7, 1]) for _ in range(rng.randint(0, 3))]
        deps = sorted(seen[d] for d in named if d in seen)
        gap = lambda: rng.choice([" ", "", "  ", "\t"])
        q, a, t0 = rng.choice(["what?", "où | est-ce", "日本 Q"]), rng.choice(["x", "a b", "ü"]), rng.randint(0, 99)
        step = f"[{'0' * rng.randint(0, 2)}{number}]{gap()}Q:{gap()}{q}{gap()}|{gap()}A:{gap()}{a}{gap()}|{gap()}E:{gap()}t={t0}{gap()}-{gap()}{t0 + 3}{gap()}box=({gap()}0.1{gap()},{gap()}.25,{gap()}1.,1.0{gap()}){gap()}|{gap()}deps={(gap() + ',').join(map(str, named))}"
        text += rng.choice(BLANKS)
        spans.append((len(text), len(text) + len(step)))
        text += step + rng.choice(BLANKS) + rng.choice(ENDS)
        seen[number] = k
        steps.append((q, a, t0, t0 + 3, deps))
    return text + "</think> <answer> yes\t</answer>", spans, steps


def test_steps_and_spans_of_any_line_ends(spark):
    rng = random.Random(7)
    all_ = [made(rng) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(all_)], "k int, raw string").repartition(3)
    got = {r.k: r for r in codec.parse(df.withColumn("spans", codec.step_spans("raw"))).collect()}
    for k, (text, spans, steps) in enumerate(all_):
        r = got[k]
        # the deps of a line end with what is stripped from the line
        cut = lambda s: s.rstrip()
        assert [cut(text[a:b]) for a, b in r.spans] == [cut(text[a:b]) for a, b in spans] and [a for a, _ in r.spans] == [a for a, _ in spans]
        assert [(s.question, s.answer, s.t0, s.t1, s.deps) for s in r.parsed.chain] == steps
        assert [tuple(s.box) for s in r.parsed.chain] == [(0.1, 0.25, 1.0, 1.0)] * len(steps) and r.parsed.answer == "yes"
        inside = text[text.index("<think>") + 7 : text.index("</think>")]
        assert (r.parsed.n_steps, r.parsed.n_lines) == (len(steps), sum(bool(x.strip()) for x in inside.splitlines()))


def test_odd_texts():
    step = "[{}] Q: q | A: a | E: t={}-{} box=({}) | deps={}"
    good = step.format(1, 0, 3, "0,0,1,1", "")
    wrap = lambda *s: "<think>" + "\n".join(s) + "</think><answer>x</answer>"
    cases = [
        (None, None),
        ("", (0, 0, False, None)),
        (wrap(), (0, 0, True, None)),
        (wrap(good, step.format(2, 2**31, 2**31, "0,0,1,1", "")), (2, 2, True, None)),
        (wrap(step.format(2, 0, 1, "0,0,1.1.1,1", ""), good), (1, 2, True, None)),
        (wrap(step.format(2, 0, 1, ".,0,1,1", ""), good), (1, 2, True, None)),
        (wrap(good, step.format(2, 0, 1, "0,0,1,1", "1 1"), good), (2, 3, True, None)),
        (wrap(good, step.format(2, 5, 4, "0,0,1,1", ""), good), (3, 3, True, None)),
        (wrap(good, step.format(2, 0, 1, "0,0.5,1,0.5", "")), (2, 2, True, None)),
        (wrap(good.replace("Q: q", "Q: ")), (1, 1, True, None)),
        (wrap("x" + good), (0, 1, True, None)),
        (wrap(good, good) + wrap("[3]"), (2, 2, True, 2)),
        (wrap(good).replace("</think>", ""), (0, 0, False, None)),
        (wrap(step.format(1, 0, 3, "0,0,1,1", "1,2,,"), good), (2, 2, True, 2)),
    ]
    got = lines.parse(pa.array([t for t, _ in cases])).to_pylist()
    for (text, want), r in zip(cases, got):
        assert (r and (r["n_steps"], r["n_lines"], r["has_tags"], r["chain"] and len(r["chain"]))) == want, text
    assert lines.parse(pa.array([], pa.string())).to_pylist() == [] and lines.step_spans(pa.array([None, "x"])).to_pylist() == [[], []]
    assert lines.parse(pa.chunked_array([["", "a"], [None]]).combine_chunks().slice(1)).to_pylist()[1] is None


def test_three_places_round_as_the_exact_value_does(spark):
    rng = random.Random(3)
    numbers = [k / 16 for k in range(17)] + [k / 10000 for k in range(10001)] + [rng.random() for _ in range(3000)] + [1e-9, 5e-324, 0.0005, 0.9995, 0.99949999, 123.0625, 7.1e5, 2e7]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    for r in df.select("v", codec.thousandths(F.col("v")).alias("s")).collect():
        n = Fraction(r.v) * 1000
        low, rest = divmod(n, 1)
        want = low + (rest > Fraction(1, 2) or (rest == Fraction(1, 2) and low % 2))
        assert r.s == f"{want // 1000}.{want % 1000:03d}", r.v


def test_roles_decide_before_words_and_stay_in_json(spark):
    b = (0.0, 0.0, 0.1, 0.1)
    step = lambda q, role: (q, "a", 0, 0, b, [], role)
    rows = [
        (1, "counterfactual", [step("Which?", "resolve"), step("Are they near?", "observe"), step("Do they part?", "resolve")]),
        (2, "predictive", [step("Which?", None), step("Do they meet?", None), step("Which?", None)]),
        (3, "predictive", [step("Do they meet?", "resolve"), step("Which?", "resolve")]),
        (4, "descriptive", [step("Do they meet?", "observe"), step("last", None)]),
    ]
    df = spark.createDataFrame(rows, f"k int, kind string, chain array<{codec.STEP_TYPE}>")
    got = {r.k: [s.question for s in r.d] for r in df.select("k", codec.decisive("chain", F.col("kind")).alias("d")).collect()}
    assert got == {1: ["Are they near?"], 2: ["Do they meet?"], 3: ["Which?"], 4: ["last"]}
    back = df.select("k", chain_from_json(chain_to_json(F.col("chain"), F.lit("yes"), kind=F.col("kind")), CHAIN).alias("c"))
    assert {r.k: [t.role for t in r.c.triplets] for r in back.collect()} == {k: [s[6] for s in c] for k, _, c in rows}
    kept = df.select(codec.without_step("chain", F.transform("chain", lambda s: s["deps"]), 0).alias("c")).first().c
    assert [s.role for s in kept] == ["observe", "resolve"]
