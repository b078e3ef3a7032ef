"""Operators on small rows with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pramana.functions import codec, geometry, rle, text
from pramana.operators import curate, regions, rewards, scenes, stats
from pramana.sources import readers
from pramana.streaming.running import running_accuracy, score_with

STEP = "[{}] Q: {} | A: {} | E: t={}-{} box=({}) | deps={}"


def chain(*steps, answer="yes"):
    return "<think>\n" + "\n".join(steps) + f"\n</think>\n<answer> {answer} </answer>"


GOOD = [STEP.format(1, "Where is the dog?", "left", 3, 9, "0.100,0.200,0.300,0.400", ""), STEP.format(2, "Do they meet?", "yes", 5, 5, "0.0, 0.0, 1.0, 1.0", "1")]


def one(spark, value, schema="raw string"):
    return spark.createDataFrame([(value,)], schema)


@pytest.mark.parametrize(
    "raw, steps, lines, tags, good",
    [
        (chain(*GOOD), 2, 2, True, True),
        (chain("note", *GOOD), 2, 3, True, True),
        ("no tags", 0, 0, False, False),
        (chain(*GOOD).replace("<answer>", "<a>"), 2, 2, True, False),
        (chain(GOOD[0], GOOD[1].replace("1.0)", "1.2.3)")), 2, 2, True, False),
        (chain(GOOD[0].replace("deps=", "deps=1 2"), GOOD[1]), 1, 2, True, False),
        (chain(GOOD[0].replace("0.300", "0.050")), 1, 1, True, False),
        (chain(GOOD[0].replace("t=3-9", "t=9-3")), 1, 1, True, False),
        ("", 0, 0, False, False),
    ],
)
def test_parse(spark, raw, steps, lines, tags, good):
    p = codec.parse(one(spark, raw)).first().parsed
    assert (p.n_steps, p.n_lines, p.has_tags, p.chain is not None) == (steps, lines, tags, good)


def test_dependencies_keep_known_earlier_numbers_and_the_last_of_repeated(spark):
    lines = [STEP.format(n, "q", "a", 0, 1, "0,0,1,1", d) for n, d in ((1, "3"), (1, "1"), (5, "1, 9, 1"), (6, "6,5"))]
    p = codec.parse(one(spark, chain(*lines))).first().parsed
    assert [s.deps for s in p.chain] == [[], [0], [1, 1], [2]]
    assert p.answer == "yes"


def test_spans_of_step_lines(spark):
    raw = "x <think>\nplan\n  " + GOOD[0] + "\n" + GOOD[1] + "\n</think>"
    got = one(spark, raw).select(codec.step_spans("raw").alias("s")).first().s
    assert [raw[a:b] for a, b in got] == GOOD


def test_graph_operators(spark):
    df = spark.createDataFrame([([[], [0], [], [1, 2], [2]],)], "deps array<array<int>>")
    r = df.select(codec.closure("deps", 0).alias("c"), codec.ancestors("deps", 3).alias("a")).first()
    assert sorted(r.c) == [1, 3] and sorted(r.a) == [0, 1, 2]


@pytest.mark.parametrize("raw, want", [(" The answer is: Three dogs", "3"), ("It's blue!", "blue"), ("", ""), ("...", ""), ("Ten", "10"), ("answer yes", "yes")])
def test_normalize(spark, raw, want):
    assert one(spark, raw).select(text.normalize_short("raw")).first()[0] == want


@pytest.mark.parametrize("raw, want", [("A, C", "AC"), ("AC", "AC"), ("options b and d", "BD"), ("none of them", ""), ("none but B", "B"), ("F", ""), ("", ""), ("a cat", "A")])
def test_letters(spark, raw, want):
    assert one(spark, raw).select(text.parse_letters("raw", 4)).first()[0] == want


@pytest.mark.parametrize("raw, want", [("Where is 2: white dog: the white dog?", "the white dog"), ("Where is the man in red?", "the man in red"), ("Who is it?", None), ("Where is ?", "?"), ("Where  is the dog?", "the dog"), ("where is the dog", "the dog"), ("Where are the dogs?", None), ("Where is " + "x" * 81, None)])
def test_entity(spark, raw, want):
    assert one(spark, raw).select(text.entity_of("raw")).first()[0] == want


def test_teacher_lines(spark):
    """Any numbering or label, frames within the clip, at most four."""
    raw = "[1] entity: the dog. | observation: It runs | frame: 3\n2. cat: the black cat | observation: sits | frame: 12\nnoise\n- the red cup | OBSERVATION: falls | Frame: 5\n* far | observation: x | frame: 99\n" + "y" * 81 + " | observation: x | frame: 1\nz | observation: w | frame: 0\nlast | observation: v | frame: 1"
    got = one(spark, raw).select(F.explode(text.teacher_steps("raw")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [("the dog", "It runs", 3), ("the black cat", "sits", 12), ("the red cup", "falls", 5), ("z", "w", 0)]


def test_places_and_middles_without_one_task(spark):
    df = spark.createDataFrame([(i * 7 % 1000, i % 3) for i in range(1000)], "v int, k int").repartition(5)
    got = {r.v: r.p for r in stats.numbered(df, "v", "p", within=90).collect()}
    assert got == {v: v for v in range(1000)}
    mid = {r.k: r.median for r in stats.upper_median_by(df, ["k"], "v").collect()}
    assert mid == {k: sorted(i * 7 % 1000 for i in range(1000) if i % 3 == k)[len([i for i in range(1000) if i % 3 == k]) // 2] for k in range(3)}


def test_log_windows_count_rows(spark):
    """Gaps and a restart of the step; means over rows that ran; zero where none did."""
    rows = [(s, float(i), float(i), 0.1 * i, i < 2, 2.0) for i, s in enumerate((0, 1, 7, 9, 20))]
    log = spark.createDataFrame(rows, "step int, sec double, reward double, kl double, skipped boolean, r_format double")
    got = {r.window: r for r in curate.log_windows(log, 2).collect()}
    assert [(got[k].n, got[k].first_step, got[k].last_step, got[k].skip_rate, got[k].reward, round(got[k].kl, 3), got[k].sec_per_step, got[k].r_format) for k in range(3)] == [(2, 0, 1, 1.0, 0.5, 0.0, 1.0, 2.0), (2, 7, 9, 0.0, 2.5, 0.25, 1.0, 2.0), (1, 20, 20, 0.0, 4.0, 0.4, 0.0, 2.0)]


def test_reports_are_whole_or_refused(spark):
    assert readers.markdown(spark.createDataFrame([(1, 0.5)], "a int, b double")).endswith("| 1 | 0.500 |")
    with pytest.raises(ValueError, match="more than 2"):
        readers.markdown(spark.range(3), most=2)


def test_three_valued_entities(spark):
    df = spark.createDataFrame([(["the red ball"], "a red ball falls"), (["dog"], "a red ball"), ([], "x")], "e array<string>, p string")
    assert [r[0] for r in df.select(text.entities_in_text("e", "p")).collect()] == [True, False, None]


def test_grid_and_boxes(spark):
    assert geometry.grid() == [0, 8, 17, 25, 34, 42, 51, 59, 68, 76, 85, 93, 102, 110, 119, 127] and geometry.tolerance() == 4
    b = lambda *v: geometry.box(*map(F.lit, v))
    r = spark.range(1).select(geometry.iou(b(0, 0, 1, 1), b(0, 0, 0.5, 1)).alias("i"), geometry.overlap_share(b(0, 0, 0.5, 1), b(0, 0, 1, 1)).alias("o"), geometry.frames_hit(F.lit(12), F.lit(13)).alias("f"), geometry.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)).alias("z")).first()
    assert (r.i, r.o, r.f, r.z) == (0.5, 1.0, [1, 2], 0.0)


def test_masks_as_boxes_match_the_bitmap(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(60):
        h, w = rng.randint(1, 6), rng.randint(1, 6)
        left, runs = h * w, []
        while left:
            n = rng.randint(0, left)
            runs.append(n)
            left -= n
        flat = [i % 2 for i, n in enumerate(runs) for _ in range(n)]
        on = [(p // h, p % h) for p, v in enumerate(flat) if v]
        want = (min(x for x, _ in on), min(y for _, y in on), max(x for x, _ in on) + 1, max(y for _, y in on) + 1) if on else None
        rows.append((runs, h, want))
    df = spark.createDataFrame([(r, h) for r, h, _ in rows], "runs array<int>, h int").coalesce(1)
    got = [tuple(r[0]) if r[0] else None for r in df.select(rle.runs_to_box("runs", "h")).collect()]
    assert got == [w for *_, w in rows]


def test_compressed_runs(spark):
    def pack(counts):
        s = ""
        for i, c in enumerate(counts):
            x = c - (counts[i - 2] if i > 2 else 0)
            while True:
                bits = x & 31
                x >>= 5
                done = x == (-1 if bits & 16 else 0)
                s += chr((bits | (0 if done else 32)) + 48)
                if done:
                    break
        return s

    for counts in ([3, 5, 2], [100, 4, 900, 7, 2, 1000], [0, 1, 40, 40, 1]):
        assert one(spark, pack(counts)).select(rle.decode_counts("raw")).first()[0] == counts


def test_gaps_and_intervals(spark):
    rows = [(i, q, c, v) for i, (q, p, a, b) in enumerate([(1, 1, 0, 1), (1, 1, 0, 0), (2, 1, 1, 1), (3, 0, 0, 0)]) for c, v in (("plain", p), ("mask_cite", a), ("mask_cite_random", b))]
    runs = spark.createDataFrame(rows, "id int, qset int, condition string, correct int").withColumns({"question_type": F.lit("t"), "gold": F.lit("yes"), "video": F.lit(1)})
    w = stats.wide(runs, ["plain", "mask_cite", "mask_cite_random"])
    g = stats.gap(w, "mask_cite", "mask_cite_random", ["question_type"]).first()
    assert (g.n_correct, g.flip, g.flip_control) == (3, pytest.approx(2 / 3), pytest.approx(1 / 3))
    for method in ("draws", "poisson"):
        i = stats.interval(stats.bootstrap(stats.sums_by_cluster(w, "mask_cite", "mask_cite_random"), 300, method=method)).first()
        assert 0 <= i.lo <= g.gap <= i.hi <= 1 and 200 < i.n_reps <= 300
    assert stats.interval(spark.createDataFrame([], "gap double")).first().n_reps == 0
    v = spark.createDataFrame([(float(x),) for x in range(1, 2001)], "gap double")
    assert tuple(stats.interval(v).first())[:2] == (51.0, 1951.0)


def test_rewards(spark):
    raw = spark.createDataFrame([(chain(*GOOD), "yes"), (chain(*GOOD, answer="2"), "yes"), ("text\nyes", "yes"), ("<answer>A, C</answer>", "AC")], "raw string, gold string")
    kind = F.when(F.col("gold") == "AC", "multiple choice").otherwise("open")
    got = raw.select(rewards.outcome("raw", kind, F.lit("exist"), "gold", 4), rewards.outcome_lenient("raw", kind, F.lit("exist"), "gold", 4)).collect()
    assert [tuple(r) for r in got] == [(1, 1), (1, 1), (0, 1), (1, 1)]
    df = codec.parse(raw.limit(1)).select(F.col("parsed.chain").alias("a"))
    assert rewards.process(df.withColumn("b", F.col("a")), "a", "b").first().process == 1.0
    assert rewards.process(df.withColumn("b", F.reverse("a")).withColumn("b", F.transform("b", lambda s, i: s.withField("deps", F.when(i == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))))), "a", "b").first().process == 0.5


def test_scene_modules(spark):
    v = spark.createDataFrame([(1, 1, f) for f in range(0, 10)] + [(1, 2, f) for f in range(3, 128)] + [(1, 3, f) for f in range(128)], "scene int, obj int, frame int")
    pairs = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 3, 50), (1, 1, 3, 200)], "scene int, a int, b int, frame int")
    c = scenes.retimed_collisions(pairs, v)
    assert sorted((r.a, r.b, r.moved) for r in c.collect()) == [(1, 2, 3), (2, 3, 50)]
    e = scenes.events(v, c).cache()
    assert [(r.type, r.frame) for r in e.orderBy("ord").collect()] == [("start", 0), ("in", 3), ("collision", 3), ("out", 10), ("collision", 50), ("end", 127)]
    last = scenes.filter_order(e.where("type = 'collision'"), "last")
    assert sorted(r.frame for r in scenes.filter_ancestor(e, last, e).collect()) == [3, 3]
    objs = spark.createDataFrame([(1, 1, "red", "metal", "cube"), (1, 2, "red", "rubber", "cube"), (1, 3, "blue", "metal", "sphere")], "scene int, obj int, color string, material string, shape string")
    where = objs.select("scene").distinct()
    red = scenes.filter_attr(objs, color="red")
    assert scenes.count(red, where).first().answer == 2 and scenes.unique(red).count() == 0
    assert scenes.missing(where, scenes.query_attr(scenes.unique(red), "shape")).first().answer == "error"
    blue = scenes.unique(scenes.filter_attr(objs, color="blue"))
    assert scenes.get_col_partner(last, blue, objs).first().obj == 2
    assert scenes.get_object(scenes.filter_order(e.where("type = 'out'"), "first"), objs).first().obj == 1
    assert scenes.belong_to(blue, e.where("type = 'collision'")).first().answer == "yes"
    assert scenes.belong_to(last, scenes.all_events(objs)).first().answer == "yes"
    assert scenes.exist(scenes.filter_before(e.where("type = 'collision'"), last), where).first().answer == "yes"
    moving = v.withColumn("speed", F.when(F.col("obj") == 2, 0.5).otherwise(0.0))
    assert [r.obj for r in scenes.filter_motion(objs, moving, True).collect()] == [2]
    assert scenes.unknown(where).first().answer == "unknown"


def test_controls_avoid(spark):
    df = spark.createDataFrame([(i,) for i in range(30)], "i int").withColumn("box", geometry.box(*map(F.lit, (0.1, 0.1, 0.3, 0.3)))).withColumn("avoid", F.array(geometry.box(*map(F.lit, (0.0, 0.0, 0.5, 1.0)))))
    c = regions.avoiding_controls(df, ["i"], "avoid").select(geometry.overlap_share("control", F.col("avoid")[0]).alias("m"), geometry.area("control").alias("a")).collect()
    assert all(r.m == 0 and r.a == pytest.approx(0.04) for r in c)


def test_curation(spark):
    items = spark.range(100).select(F.col("id"), (F.col("id") / 5).cast("int").alias("qset"), (F.col("id") / 50).cast("int").cast("string").alias("question_type"))
    s = curate.stratified_questions(items, 3)
    assert s.count() == 30 and s.select("qset").distinct().count() == 6
    assert curate.limit_questions(items, 2).count() == 10
    j = spark.createDataFrame([("c0_s1_visible", "yes"), ("c0_s1_onbox", "yes"), ("c1_s1_visible", "yes"), ("c1_s1_onbox", "no"), ("c2_s1_visible", "no")], "name string, value string")
    assert {r.key: round(r.yes, 3) for r in curate.audit_rates(j).collect()} == {"visible": 0.667, "onbox": 0.5}
    assert tuple(curate.onbox_given_visible(j).first()) == (2, 0.5)


def test_files(spark, tmp_path):
    lines = [json.dumps({"id": i, "correct": c, "qid": "q"}) for i, c in (("a", 0), ("b", 1), ("a", 1))]
    (tmp_path / "r.jsonl").write_text("\n".join(lines) + '\n{"id": "c", "corr')
    assert sorted((r.id, r.correct) for r in readers.run_rows(spark, str(tmp_path / "r.jsonl")).collect()) == [("a", 1), ("b", 1)]
    (tmp_path / "c.csv").write_text('qid,type,question,difficulty,choices1,correct1,choices2,correct2\n1,t,"who, he?",d,1. x| |2. y,A,1. z,\n')
    got = [(r.set, r.options, r.gold) for r in readers.two_set_csv(spark, str(tmp_path / "c.csv")).collect()]
    assert got == [(1, ["x", "y"], "A")]
    (tmp_path / "t.json").write_text(json.dumps({"v": {"dog": {"3": [0, 0, 1, 1]}}, "_summary": {"x": {"y": [1]}}}))
    assert [(r.video, r.phrase, r.frame, r.box.x1) for r in readers.entity_tracks(spark, str(tmp_path / "t.json")).collect()] == [("v", "dog", 3, 1.0)]


def test_stream_gives_what_the_table_gives(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("question_type"), (F.col("event_id") % 2).cast("int").alias("correct"))
    e.union(e.limit(20)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = running_accuracy(stream, delay="60 days").writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(spark.table("running")) == rows(running_accuracy(e))


def test_backend(spark):
    class Echo:
        def generate_batch(self, prompts):
            return ["A" for _ in prompts]

    df = spark.createDataFrame([(1, "p")], "id int, prompt string")
    assert score_with(df, Echo, "id int, prompt string, raw string").first().raw == "A"
