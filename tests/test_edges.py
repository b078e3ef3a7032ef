"""Interventions, token ranges, items by benchmark, and readers and writers that only users call."""

import json
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pramana.functions import codec
from pramana.operators import curate, interventions, items, regions, rewards, strata
from pramana.sources import files, readers


def rule():
    """A backend that workers get by value: a number that follows from what it is asked."""

    class Rule:
        def call(self, asked):
            import zlib

            return [-(zlib.crc32(f"{a['prompt']}|{a['gold']}|{a['text']}".encode()) % 1000) / 500 for a in asked]

    return Rule


def chain_of(rng, n):
    steps = [(f"q{k}", f"a{rng.randrange(9)}", k, k + 1, (0.0, 0.0, 0.5, 0.25), sorted(rng.sample(range(k), min(k, rng.randint(0, 2)))), None) for k in range(n)]
    return steps


def plain_variants(chain):
    """Texts of a chain whole and without each step and what rests on it, by walking its links."""

    def text(kept):
        place = {k: i for i, k in enumerate(kept)}
        line = lambda k: f"[{place[k] + 1}] Q: {chain[k][0]} | A: {chain[k][1]} | E: t={chain[k][2]}-{chain[k][3]} box=(0.000,0.000,0.500,0.250) | deps={','.join(str(place[d] + 1) for d in chain[k][5] if d in place)}"
        return "\n".join(map(line, kept))

    out = [text(list(range(len(chain))))]
    for gone in range(len(chain)):
        lost = {gone}
        for k in range(gone + 1, len(chain)):
            if lost & set(chain[k][5]):
                lost.add(k)
        out.append(text([k for k in range(len(chain)) if k not in lost]))
    return out


def test_necessity_equals_a_loop(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, f"p{k % 7}", "yes", chain_of(rng, rng.randint(1, 5))) for k in range(40)] + [(99, "p", "yes", []), (98, "p", "yes", None)]
    df = spark.createDataFrame(rows, f"k int, prompt string, gold string, chain array<{codec.STEP_TYPE}>").repartition(5)
    d = interventions.deltas(df, "k", "prompt", "gold", rule(), str(tmp_path / "calls"))
    found = {(r.k, r.step): r.delta for r in d.collect()}
    score = {r.k: r.necessity for r in interventions.necessity_scores(d, "k", 0.1, 0.0, 0.5).collect()}
    credit = {(r.k, r.step): r.credit for r in interventions.step_credits(d, 0.1, 0.0, 0.5).collect()}
    want = {}
    for k, prompt, gold, chain in rows:
        if chain:
            p = [math.exp(-(zlib.crc32(f"{prompt}|{gold}|{t}".encode()) % 1000) / 500) for t in plain_variants(chain)]
            drops = [p[0] - x for x in p[1:]]
            want |= {(k, i): x for i, x in enumerate(drops)}
            assert score[k] == pytest.approx(sum(x > 0.1 for x in drops) / len(drops) - 0.5 * sum(x <= 0 for x in drops) / len(drops))
    assert found == pytest.approx(want) and set(score) == {k for k, *_, c in rows if c}
    assert all(credit[k] == (1.0 if x > 0.1 else -0.5 if x <= 0 else 0.0) for k, x in want.items())


def test_step_advantages(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -0.5), ("a", 0.0), ("b", 1.0), ("b", 1.0), ("c", 1.0)], "g string, credit double")
    got = [(r.g, r.advantage) for r in interventions.step_advantages(df, "g").collect()]
    mean = 0.5 / 3
    sd = math.sqrt(sum((v - mean) ** 2 for v in (1.0, -0.5, 0.0)) / 3) + 1e-4
    assert sorted(v for g, v in got if g == "a") == pytest.approx(sorted((v - mean) / sd for v in (1.0, -0.5, 0.0)))
    assert all(v is None for g, v in got if g != "a")


def test_token_ranges_equal_a_scan(spark):
    rng = random.Random(5)
    rows, want = [], []
    for _ in range(80):
        text = "".join(rng.choice(["a", "é", "日", "\t", " ", "\n", "🙂", "b"]) for _ in range(rng.randint(1, 25)))
        raw, parts = text.encode(), []
        while sum(map(len, parts)) < len(raw):
            at = sum(map(len, parts))
            parts.append(raw[at : at + rng.randint(1, 4)])
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 4)))
        spans = [(cuts[i], cuts[i + 1]) for i in range(0, len(cuts) - 1, 2)]
        broken = rng.random() < 0.2
        if broken:
            parts[0] = b"#" + parts[0]
        bytes_at = lambda c, t=text: len(t[:c].encode())
        ends = [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        hit = [[k for k in range(len(parts)) if ends[k] > bytes_at(s) and ends[k] - len(parts[k]) < bytes_at(e)] for s, e in spans]
        rows.append((len(rows), text, [bytearray(p) for p in parts], spans))
        want.append([] if broken else [(h[0], h[-1] + 1) if h else None for h in hit])
    rows.append((len(rows), None, [], []))
    df = spark.createDataFrame(rows, "k int, t string, p array<binary>, s array<struct<start:int,end:int>>")
    got = {r.k: [x and tuple(x) for x in r.r] for r in df.select("k", interventions.token_ranges("t", "p", "s").alias("r")).collect()}
    for k, w in enumerate(want):
        assert got[k] == w, (rows[k], w)
    assert got[len(want)] == []


def test_items_of_two_sets_and_the_registry(spark, tmp_path):
    (tmp_path / "m.csv").write_text('qid,type,question,difficulty,renamed_video,choices1,correct1,choices2,correct2\n7,Causal,"""who?""",easy,v.mp4,1. x| |2. y,2,1. z,\n')
    rows = readers.two_set_csv(spark, str(tmp_path / "m.csv"))
    one = items.benchmark_items("causalvqa", rows).collect()
    assert [(r.id, r.qset, r.question_type, r.video, r.gold, r.options) for r in one] == [("7_1", "7_1", "causal", "v.mp4", "B", ["x", "y"])]
    assert one[0].prompt.startswith("who?\nA. x\nB. y\nExactly one")
    each = items.benchmark_items("causalvqa", rows, "option").collect()
    assert sorted((r.id, r.option, r.gold) for r in each) == [("7_1_0", 0, "no"), ("7_1_1", 1, "yes")]
    scored = items.score_items(items.benchmark_items("causalvqa", rows, "option").withColumn("prediction", F.lit("1")))
    assert {(r.id, r.pred, r.correct) for r in scored.collect()} == {("7_1_0", "yes", 0), ("7_1_1", "yes", 1)}
    with pytest.raises(ValueError, match="causalvqa, clevrer, nextqa"):
        items.benchmark_items("other", rows)


def test_quoted_judgements_keep_texts_that_are_no_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,value\nc1_visible,"""yes"""\nc2_visible,no\nc3_visible,"""a ""quoted"" b"""\n')
    got = {r["name"]: r["value"] for r in readers.judgements(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"c1_visible": "yes", "c2_visible": "no", "c3_visible": '"a "quoted" b"'}


def test_citations_of_items_whose_answer_stays(spark):
    schema = "id int, entity string, t0 int, t1 int, box struct<x0:double,y0:double,x1:double,y1:double>"
    b, far = (0.1, 0.1, 0.3, 0.3), (0.6, 0.6, 0.9, 0.9)
    old = spark.createDataFrame([(1, "dog", 0, 9, b), (2, "dog", 0, 9, b), (3, "cat", 0, 9, b), (4, "cat", 0, 9, b)], schema)
    new = spark.createDataFrame([(1, "dog", 0, 9, b), (2, "dog", 0, 9, far), (3, "cat", 0, 9, far), (1, "dog", 0, 9, b)], schema)
    answers = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "b", "b"), (4, None, None), (9, "a", "a")], "id int, plain string, masked string")
    r = strata.recite_same_answer(old, new, answers).first()
    assert (r.share_items, r.items, r.steps, round(r.same_box, 6), round(r.same_frame_other_place, 6)) == (0.75, 2, 3, round(2 / 3, 6), round(1 / 3, 6))


def test_mean_weighted_by_questions(spark):
    s = spark.createDataFrame([("a", 10, 0.5), ("b", 30, 0.9), ("ALL", 40, 0.8), ("c", 5, None)], "question_type string, questions long, per_question double")
    r = curate.inferential_mean(s, ["a", "b", "c"]).first()
    assert (r.n, round(r.value, 9)) == (40, 0.8)
    assert tuple(curate.inferential_mean(s, ["z"]).first()) == (0, None)


def test_writers_append_and_partition(spark, tmp_path):
    df = spark.createDataFrame([("t", "plain", 1), ("t", "blind", 2)], "tag string, condition string, id int")
    for _ in range(2):
        readers.append_rows(df, str(tmp_path / "rows"))
        readers.write_runs(df, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 4
    plain = spark.read.parquet(str(tmp_path / "runs")).where("condition = 'plain'")
    assert plain.count() == 2 and len(plain.inputFiles()) >= 2


def test_rewards_are_mixed_with_absent_ones_as_zero(spark):
    df = spark.createDataFrame([(1.0, None), (0.5, 2.0)], "outcome double, grounding double")
    assert [r.m for r in df.select(rewards.mix({"outcome": 1.0, "grounding": 0.25}).alias("m")).collect()] == [1.0, 1.0]


def test_own_regions_or_else_the_questions(spark):
    r = "array<struct<t0:int,t1:int>>"
    own = spark.createDataFrame([(1, "q", [(0, 1)]), (2, "q", []), (3, "z", [])], f"id int, key string, own {r}")
    pool = spark.createDataFrame([("q", [(5, 6)])], f"key string, pool {r}")
    got = {x.id: [tuple(y) for y in x.regions] for x in regions.pooled_regions(own, pool).collect()}
    assert got == {1: [(0, 1)], 2: [(5, 6)], 3: []}


def test_chains_within_the_clip(spark):
    step = lambda t1: ("q", "a", 0, t1, (0.0, 0.0, 0.5, 0.5), [], None)
    df = spark.createDataFrame([([step(7)],), ([step(8)],), ([],), (None,)], f"c array<{codec.STEP_TYPE}>")
    assert [r.w for r in df.select(rewards.within_clip("c", 8).alias("w")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_questions_and_their_choices(spark, tmp_path):
    q = {"question_id": 3, "question": "why?", "question_type": "explanatory", "program": ["a"], "choices": [{"choice_id": 0, "choice": "x", "answer": "correct", "program": ["b"]}]}
    body = [{"scene_index": 5, "video_filename": "v.mp4", "questions": [q, {"question_id": 4, "question": "how many?", "question_type": "descriptive", "answer": "2"}]}]
    (tmp_path / "q.json").write_text(json.dumps(body))
    found = readers.questions(spark, str(tmp_path / "q.json"))
    assert sorted((r.scene_index, r.question_id, r.question_type) for r in found.collect()) == [(5, 3, "explanatory"), (5, 4, "descriptive")]
    assert sorted((r.question_id, r.choice_at, r.choice_answer) for r in files.choices(found).collect()) == [(3, 0, "correct"), (4, None, None)]


def test_options_of_a_csv(spark, tmp_path):
    (tmp_path / "o.csv").write_text('video,qid,type,question,answer,a0,a1,a2,a3,a4\n1,2,CW,"who, he",3,a,b,c,"d, e",f\n')
    r = readers.option_csv(spark, str(tmp_path / "o.csv")).first()
    assert (r.question, r.right, r.options) == ("who, he", 3, ["a", "b", "c", "d, e", "f"])


def test_json_report(spark):
    df = spark.sql("select * from values ('what', 3, 0.5D, array(0.25D, 0.75D)), ('ALL', 9, cast(null as double), null) t(kind, n, gap, ci)").coalesce(1)
    assert json.loads(readers.json_report(df, "kind")) == {"what": {"n": 3, "gap": 0.5, "ci": [0.25, 0.75]}, "ALL": {"n": 9}}
    assert readers.json_report(df.where("false"), "kind") == "{}"
    for bad, message in ((df.unionAll(df), "one row for each kind"), (df.select(F.lit(None).cast("string").alias("kind"), "n"), "one row")):
        with pytest.raises(ValueError, match=message):
            readers.json_report(bad, "kind")
    with pytest.raises(ValueError, match="more than 1 rows"):
        readers.json_report(df, "kind", most=1)


def test_control_strata(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (2, 0.2), (3, 0.5), (4, 1.0), (5, None)], "id int, share double").select("id", strata.control_stratum("share").alias("s"))
    assert [r.s for r in df.orderBy("id").collect()] == ["on_background", "on_background", "mixed", "on_other_entity", "on_other_entity", None]
