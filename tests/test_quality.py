"""Nested profiles against a plain walk, and every check of scene files with a fixture that breaks it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pramana.operators import filechecks, profiles


def walk(x, path, out):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(x), "number")
    size = len(x) if isinstance(x, (list, str)) else None
    out.append((path, kind, x if kind == "number" else None, size))
    for k, v in x.items() if isinstance(x, dict) else ():
        walk(v, f"{path}.{k}", out)
    for v in x if isinstance(x, list) else ():
        walk(v, f"{path}[*]", out)


def plain(values):
    nodes = []
    for v in values:
        walk(v, "$", nodes)
    out = {}
    for path, kind, x, size in nodes:
        n, xs, sizes = out.setdefault((path, kind), [0, [], []])
        out[path, kind][0] += 1
        xs.extend([x] if x is not None else [])
        sizes.extend([size] if size is not None else [])
    return {k: (n, min(xs, default=None), max(xs, default=None), min(s, default=None), max(s, default=None)) for k, (n, xs, s) in out.items()}


def made(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([1, -2.5, 3, "ab", "", "é☃", True, None, 10**12, 0.1])
    if rng.random() < 0.5:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("abcd"): made(rng, depth - 1) for _ in range(rng.randint(0, 3))}


def test_profile_equals_a_walk(spark):
    rng = random.Random(1)
    values = [made(rng, rng.randint(0, 7)) for _ in range(200)]
    df = spark.createDataFrame([(json.dumps(v),) for v in values] + [(None,), ("{no json",)], "j string")
    got = {(r.path, r.kind): tuple(r)[2:] for r in profiles.nested_profile(df, "j").collect()}
    assert got.pop(("$", "invalid"))[0] == 1
    assert got == plain(values) and max(p.count("[") + p.count(".") for p, _ in got) >= 5


def test_profile_of_structs_and_variants(spark):
    df = spark.createDataFrame([(1, [(2, None)])], "a int, b array<struct<c:int,d:string>>").select(F.struct("a", "b").alias("s"))
    want = {("$", "object"), ("$.a", "number"), ("$.b", "array"), ("$.b[*]", "object"), ("$.b[*].c", "number"), ("$.b[*].d", "null")}
    assert {(r.path, r.kind) for r in profiles.nested_profile(df, "s").collect()} == want
    v = df.select(F.parse_json(F.to_json("s", {"ignoreNullFields": "false"})).alias("v"))
    assert {(r.path, r.kind) for r in profiles.nested_profile(v, "v").collect()} == want
    assert profiles.nested_profile(v.limit(0), "v").count() == 0


QUESTION = "scene int, qid int, question_type string, program array<string>, answer string, choices array<struct<answer:string,program:array<string>>>"
ANNOTATION = "scene int, object_property array<struct<color:string,material:string,shape:string>>, motion_trajectory array<struct<frame_id:int,objects:array<struct<location:array<double>,inside_camera_view:boolean>>>>, collision array<struct<frame_id:int>>"
PROPOSAL = "scene int, frame int, color string, material string, shape string, box struct<x0:double>"
GOOD = {
    "q": [(1, 0, "descriptive", ["count"], "3", None)] + [(1, k, t, ["objects"], None, [("correct", ["a"]), ("wrong", [])]) for k, t in enumerate(("explanatory", "predictive", "counterfactual"), 1)],
    "a": [(1, [("red", "metal", "cube")], [(0, [([0.1, 0.2], True)]), (1, [([0.1, 0.2], False)])], [(1,)])],
    "p": [(1, 0, "red", "metal", "cube", (0.1,)), (1, 1, "red", "metal", "cube", (0.1,))],
}
Q, A, P = GOOD["q"][0], GOOD["a"][0], GOOD["p"][0]
BROKEN = [
    ("questions are there", {"q": []}),
    ("a question is there once", {"q": [*GOOD["q"], Q]}),
    ("every type of question occurs", {"q": GOOD["q"][:3]}),
    ("every question has a program", {"q": [*GOOD["q"], (1, 9, "predictive", None, None, None), (1, 10, "predictive", [], None, None)]}),
    ("every choice has a program", {"q": [*GOOD["q"], (1, 9, "predictive", ["x"], None, [("wrong", None)])]}),
    ("every choice is right or wrong", {"q": [*GOOD["q"], (1, 9, "predictive", ["x"], None, [("maybe", ["x"])])]}),
    ("descriptive questions have an answer", {"q": [*GOOD["q"], (1, 9, "descriptive", ["x"], None, None)]}),
    ("annotations are there", {"a": []}),
    ("an annotation is there once", {"a": [A, A]}),
    ("objects have colour, material and shape", {"a": [(1, [("red", None, "cube")], *A[2:])]}),
    ("objects have colour, material and shape", {"a": [(1, None, *A[2:])]}),
    ("collisions have a frame", {"a": [(*A[:3], [(None,)])]}),
    ("there are collisions", {"a": [(*A[:3], [])]}),
    ("places are of two dimensions", {"a": [(*A[:2], [(0, [([0.1, 0.2, 0.3], True)]), (1, [])], A[3])]}),
    ("it is said what is in view", {"a": [(*A[:2], [(0, [([0.1, 0.2], None)]), (1, [])], A[3])]}),
    ("detections are there", {"p": []}),
    ("detections have a box", {"p": [*GOOD["p"], (1, 1, "red", "metal", "cube", None)]}),
    ("detections have colour, material and shape", {"p": [*GOOD["p"], (1, 1, None, "metal", "cube", (0.1,))]}),
    ("detections have as many frames as the annotation", {"p": GOOD["p"][:1]}),
    ("questions have an annotation", {"q": [*GOOD["q"], (2, 0, "predictive", ["x"], None, None)]}),
    ("annotations have questions", {"a": [A, (8, *A[1:])]}),
    ("annotations have detections", {"a": [A, (8, *A[1:])]}),
    ("detections have an annotation", {"p": [*GOOD["p"], (7, *P[1:])]}),
]


def run(spark, tables):
    q, a, p = (spark.createDataFrame((GOOD | tables)[k], s).coalesce(1) for k, s in (("q", QUESTION), ("a", ANNOTATION), ("p", PROPOSAL)))
    return {r.check: r for r in filechecks.scene_file_checks(q, a, p).collect()}


def test_good_files_pass(spark):
    found = run(spark, {})
    assert all(r.status == "PASS" and r.bad == 0 and r.samples == [] for r in found.values()) and len(found) == 22
    assert set(found) == {name for name, _ in BROKEN}


def test_each_check_sees_what_breaks_it(spark):
    """All that is there but wrong in one set of files, all that is missing in another."""
    wrong = {k: list(v) for k, v in GOOD.items()}
    missing = [b for b in BROKEN if not all(b[1].values()) or b[0] in ("every type of question occurs", "there are collisions", "detections have as many frames as the annotation")]
    for _, tables in [b for b in BROKEN if b not in missing]:
        for k, rows in tables.items():
            wrong[k] += [r for r in rows if r not in wrong[k]] or rows[:1]
    found = run(spark, wrong)
    for name in {n for n, _ in BROKEN} - {n for n, _ in missing}:
        assert found[name].status in ("FAIL", "WARN") and found[name].bad >= 1, name
    gone = run(spark, {"q": GOOD["q"][:3], "a": [(*A[:3], [])], "p": GOOD["p"][:1]}) | {k: r for k, r in run(spark, {"q": [], "a": [], "p": []}).items() if "are there" in k and "collisions" not in k}
    for name in {n for n, _ in missing}:
        assert gone[name].status in ("FAIL", "WARN") and gone[name].bad >= 1, name


def test_samples_are_few_and_in_order(spark):
    df = spark.createDataFrame([(k, k) for k in range(100)], "k int, v int").repartition(7)
    r = filechecks.holds("v is small", df, F.col("v") < 10, F.format_string("%03d", "k")).first()
    assert (r.n, r.bad, r.status, r.samples) == (100, 90, "FAIL", ["010", "011", "012", "013", "014"])
    both = filechecks.report([filechecks.is_unique("u", df, ["k"]), filechecks.holds("w", df, F.lit(False), F.lit("x"), "WARN")])
    assert tuple(filechecks.verdict(both).first()) == ("WARN", 2)
    nulls = spark.createDataFrame([(None,), (1,)], "k int")
    assert filechecks.has_partner("p", nulls, nulls, ["k"]).first().bad == 1
