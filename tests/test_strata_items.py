"""Strata, programs, items and files that have no SQL, against plain versions on small fixtures."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from pramana.functions import geometry as G
from pramana.operators import items, programs, regions, stats, strata
from pramana.sources import files

NAMES = ["red ball", "white dog", "old man", "tall tree"]
GRID = G.grid()


def frames(t0, t1):
    return {f for f, p in enumerate(GRID) if t0 - 4 <= p <= t1 + 4}


def draw(*key):
    return int(hashlib.md5(":".join(["0", *map(str, key)]).encode()).hexdigest()[:12], 16) / 16**12


def area(b):
    return (b[2] - b[0]) * (b[3] - b[1])


def inter(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def iou(a, b):
    u = area(a) + area(b) - inter(a, b)
    return inter(a, b) / u if u > 0 else 0.0


@pytest.fixture(scope="module")
def clip(spark):
    rng = random.Random(4)
    box = lambda s: (x := rng.random() * (1 - s), y := rng.random() * (1 - s), x + s, y + s)
    steps = [(i, i % 3, rng.choice([*NAMES, None]), t := rng.randrange(110), t + rng.randrange(9), box(0.3)) for i in range(12) for _ in range(rng.randint(1, 3))]
    tracks = [(v, n, f, box(rng.choice([0.2, 0.3, 0.7]))) for v in range(3) for n in NAMES for f in range(16) if rng.random() < 0.4]
    s = spark.createDataFrame([(i, v, e, a, b, *x) for i, v, e, a, b, x in steps], "id int, video int, entity string, t0 int, t1 int, x0 double, y0 double, x1 double, y1 double")
    t = spark.createDataFrame([(v, n, f, *x) for v, n, f, x in tracks], "video int, phrase string, frame int, x0 double, y0 double, x1 double, y1 double")
    made = lambda d: d.select(*[c for c in d.columns if c not in ("x0", "y0", "x1", "y1")], G.box("x0", "y0", "x1", "y1").alias("box"))
    return steps, tracks, made(s), made(t)


def test_controls_of_entity_masks_avoid_and_are_rated(clip):
    steps, tracks, s, t = clip
    e = strata.avoiding_regions(strata.entity_regions(s, t))
    rows = {r.id: r for r in e.collect()}
    tup = lambda r: (r.t0, r.t1, tuple(r.box))
    for i, r in rows.items():
        own = {n for j, v, n, *_ in steps if j == i and n}
        want = {(GRID[f], GRID[f], b) for v, n, f, b in tracks if v == i % 3 and n in own} | {(a, b, x) for j, v, n, a, b, x in steps if j == i}
        assert {tup(x) for x in r.regions} == want
        for n, (x, c) in enumerate(zip(r.regions, r.controls)):
            near = [b for a, z, b in want if frames(a, z) & frames(x.t0, x.t1)]
            assert (c.t0, c.t1) == (x.t0, x.t1) and area(tuple(c.box)) == pytest.approx(area(tuple(x.box)))
            w, h = x.box.x1 - x.box.x0, x.box.y1 - x.box.y0
            tried = [(draw(i, n, k, "x") * max(0, 1 - w), draw(i, n, k, "y") * max(0, 1 - h)) for k in range(30)]
            first = min(range(30), key=lambda k: (round(max(iou((*tried[k], tried[k][0] + w, tried[k][1] + h), b) for b in near), 12), k))
            assert (c.box.x0, c.box.y0) == pytest.approx(tried[first])
    assert set(rows) == {i for i, v, n, *_ in steps if n and any(w == v and m == n for w, m, _, _ in tracks)}
    got = {r.id: r.share for r in strata.entity_control_share(e, s, t).collect()}
    for i, r in rows.items():
        own = {n for j, v, n, *_ in steps if j == i and n}
        hits = total = 0
        for c in r.controls:
            for f in frames(c.t0, c.t1):
                mine = [tuple(x.box) for x in r.regions if f in frames(x.t0, x.t1)]
                others = [b for v, n, g, b in tracks if v == i % 3 and g == f and n not in own and area(b) < 0.4 and not any(iou(b, m) >= 0.3 for m in mine)]
                total += 1
                hits += any(inter(b, tuple(c.box)) / area(b) >= 0.3 for b in others)
        assert got[i] == pytest.approx(hits / total)


def test_intervals_hold_the_gap_by_draws_and_by_weights(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("a" if c % 2 else "b", c, 1, int(rng.random() < 0.6), int(rng.random() < 0.3)) for c in range(60) for _ in range(3)] + [("none", 1, 0, 1, 1)]
    df = spark.createDataFrame(rows, "stratum string, cluster int, w int, x int, y int")
    for most in (10**6, 5):
        monkeypatch.setattr(stats, "MOST_SENT", most)
        got = {r.stratum: r for r in strata.clustered(df, 300).collect()}
        assert set(got) == {"a", "b"}
        for k, r in got.items():
            mine = [x for x in rows if x[0] == k]
            assert r.n == 90 and r.gap == pytest.approx(sum(x[3] - x[4] for x in mine) / 90)
            assert r.gap_lo < r.gap < r.gap_hi and r.flip_lo < r.flip < r.flip_hi and r.gap_hi - r.gap_lo < 0.6


def test_programs_short_circuit_and_pass_what_is_unknown(spark):
    row = [(1, [(1, "red", "metal", "cube"), (2, "blue", "rubber", "cube")], [(1, "start", 0, [], []), (2, "in", 5, [2], []), (3, "collision", 9, [1, 2], [2])], [(1, 5, 0.1), (2, 5, 0.0)])]
    s = spark.createDataFrame(row, "scene int, o array<struct<obj:int,color:string,material:string,shape:string>>, e array<struct<ord:int,type:string,frame:int,objects:array<int>,causes:array<int>>>, m array<struct<obj:int,frame:int,speed:double>>")
    for text, want in (
        ("objects cube filter_shape count", "2"), ("objects cube filter_shape unique query_color", "error"), ("objects red filter_color unique query_material", "metal"),
        ("events objects filter_collision unique objects red filter_color unique get_col_partner query_color", "blue"), ("events objects filter_in unique get_object query_color", "blue"),
        ("objects events objects filter_in unique get_frame filter_moving", "1"), ("objects start get_frame filter_moving count", "0"), ("events events objects filter_collision unique filter_ancestor count", "1"),
        ("unseen_events objects filter_in exist negate", "unknown"), ("unseen_events first filter_order", "error"), ("events start get_counterfact objects count", "error"), ("count", "error"), ("", "error"),
        ("events objects filter_collision second filter_order get_frame", "error"), ("events end filter_before objects filter_collision last filter_order get_frame", "9"),
    ):
        q = s.withColumn("program", F.array(*map(F.lit, text.split())).cast("array<string>"))
        assert programs.run(q).first().answer == want, text


def test_scene_and_proposal_files(spark, tmp_path):
    scene = {"scene_index": 7, "video_filename": "v", "object_property": [{"object_id": 0, "color": "red", "material": "metal", "shape": "cube"}], "motion_trajectory": [{"frame_id": f, "objects": [{"object_id": 0, "velocity": [0.03, 0.04, 9.0], "inside_camera_view": f > 0}]} for f in range(3)], "collision": [{"object_ids": [4, 0], "frame_id": 2}]}
    (tmp_path / "a.json").write_text(json.dumps(scene))
    got = files.scenes(spark, str(tmp_path / "a.json"))
    assert [tuple(r) for r in got["objects"].collect()] == [(7, 0, "red", "metal", "cube")]
    assert sorted((r.frame, round(r.speed, 6)) for r in got["frames"].collect()) == [(1, 0.05), (2, 0.05)]
    assert [tuple(r) for r in got["collisions"].collect()] == [(7, 0, 4, 2)]
    one = lambda counts, score: {"mask": {"size": [10, 20], "counts": counts}, "color": "red", "material": "metal", "shape": "cube", "score": score}
    (tmp_path / "proposal_00012.json").write_text(json.dumps({"video_name": "v", "frames": [{"frame_index": 3, "objects": [one("[12, 3, 185]", 0.5), one("[200]", 0.9)]}]}))
    p = files.proposals(spark, str(tmp_path / "proposal_00012.json"))
    assert sorted((r.scene, r.frame, r.score, r.box and tuple(r.box)) for r in p.collect()) == [(12, 3, 0.5, (0.05, 0.2, 0.1, 0.5)), (12, 3, 0.9, None)] and sorted(r.ord for r in p.collect()) == [0, 1]
    best = regions.best_detections(p.withColumn("n", F.lit(0)), ["scene", "frame", "color", "material", "shape"], "score", ["n"])
    assert [r.score for r in best.collect()] == [0.5]


def test_maps_lists_paths_and_packs(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": "x/1", "b": "y/2"}')
    (tmp_path / "l.json").write_text('["b", "a", "b"]')
    (tmp_path / "r.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": 2}\n{"id": "c"')
    assert sorted(map(tuple, files.json_map(spark, str(tmp_path / "m.json")).collect())) == [("a", "x/1"), ("b", "y/2")]
    assert sorted(r.id for r in files.id_list(spark, str(tmp_path / "l.json")).collect()) == ["a", "b"]
    rows = files.records(spark, str(tmp_path / "r.jsonl"), "id string, n int")
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 2)]
    assert spark.range(12345, 12346).select(files.scene_file(F.col("id"))).first()[0] == "video_12000-13000/video_12345.mp4"
    assert sorted(map(tuple, files.write_pack(rows, str(tmp_path / "pack"), ["id"]).collect())) == [("a", 1), ("b", 1)]
    files.write_summary(rows, str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).count() == 2
    assert files.type_tree(spark, str(tmp_path / "m.json")) == "struct<a:string,b:string>"
    d = spark.createDataFrame([("d/v_1.mp4", "x"), ("/abs/k", "y")], "p string, gold string")
    assert [tuple(r) for r in d.select(items.frames_key(F.col("p")), items.under("/r/", F.col("p"))).collect()] == [("v_1", "/r/d/v_1.mp4"), ("k", "/abs/k")]
    assert items.bare_answers(d.withColumn("chain", F.lit(1))).columns == ["p", "gold", "response"]


def test_corrupted_steps_are_on_the_path(spark):
    step = "struct<question:string,answer:string,deps:array<int>>"
    rows = [(k, [("q", "the red cube", []), ("q", "the blue cube", []), ("q", "yes", [0])]) for k in range(40)] + [(99, [("q", "silence", [])])]
    got = {r.k: r.c for r in spark.createDataFrame(rows, f"k int, chain array<{step}>").select("k", items.corrupt_chain(F.col("chain"), "k").alias("c")).collect()}
    assert got.pop(99) is None
    assert {c["at"] for c in got.values()} == {0, 2} and all(c.answer == "no" if c["at"] == 2 else c.answer != "the red cube" and len(c.answer.split()) == 3 for c in got.values())
