"""Chains from question programs on a scene small enough to work out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from pramana.functions import geometry as G
from pramana.operators import chains, programs
from pramana.sources import chain_files, files

N = 24
LOOKS = [(0, "red", "metal", "cube"), (1, "blue", "rubber", "sphere"), (2, "gray", "metal", "cylinder")]
#: The sphere enters at 6, the cube is gone from 18 on; the cylinder rests until 12.
SEEN = [(i, f) for i in range(3) for f in range(N) if not (i == 1 and f < 6) and not (i == 0 and f > 17)]
EVENTS = [("start", 0, []), ("in", 6, [1]), ("collision", 9, [0, 1]), ("collision", 13, [1, 2]), ("out", 18, [0]), ("end", 127, [])]
#: No cube at 9 and 10; no cylinder before 3 and between 12 and 14; the sphere grows until 8.
FOUND = [(i, f) for i, f in SEEN if not (i == 0 and f in (9, 10)) and not (i == 2 and (f < 3 or 12 <= f <= 14))]


def box(i, f):
    x = 0.25 * i + f / 1024
    return (x, 0.125, x + (0.125 if i != 1 or f >= 8 else (f - 4) / 64), 0.25)


def union(*bs):
    return tuple(pick(b[k] for b in bs) for k, pick in enumerate((min, min, max, max)))


@pytest.fixture(scope="module")
def scene(spark):
    objs = spark.createDataFrame([(7, *x) for x in LOOKS], "scene int, obj int, color string, material string, shape string")
    frames = spark.createDataFrame([(7, i, f, 1.0 if i != 2 or f >= 12 else 0.0) for i, f in SEEN], "scene int, obj int, frame int, speed double")
    log = spark.createDataFrame([(7, t, f, o, n) for n, (t, f, o) in enumerate(EVENTS)], "scene int, type string, frame int, objects array<int>, ord int")
    rows = [(7, f, *LOOKS[i][1:], 0.9, n, *box(i, f)) for n, (i, f) in enumerate(FOUND)]
    # a lesser, an equal but later, and an empty detection of the same object, and one of no object
    rows += [(7, 6, "blue", "rubber", "sphere", s, 900, 0.0, 0.0, 1.0, 1.0) for s in (0.5, 0.9)] + [(7, 6, "blue", "rubber", "sphere", 1.0, 901, None, None, None, None), (7, 6, "green", "metal", "cube", 1.0, 902, 0.0, 0.0, 1.0, 1.0)]
    raw = spark.createDataFrame(rows, "scene int, frame int, color string, material string, shape string, score double, ord int, x0 double, y0 double, x1 double, y1 double")
    found = raw.withColumn("box", F.when(F.col("x0").isNotNull(), G.box("x0", "y0", "x1", "y1")))
    return chains.with_detections(programs.scene_rows(objs, frames, log), objs, chains.best_detections(found)).cache()


FIRST = "events objects filter_collision first filter_order"
BLUE = "objects blue filter_color unique"
UNSEEN = " unseen_events belong_to"


def pair(a, b):
    return f"all_events objects {a} filter_color unique filter_collision objects {b} filter_color unique filter_collision unique"


#: Programs, known answers, and whether they are choices.
OBJECTS = [
    ("objects blue filter_color unique query_shape", "sphere", False),
    ("objects metal filter_material count", "2", False),
    ("objects green filter_color exist", "no", False),
    ("objects start get_frame filter_stationary unique query_color", "gray", False),
    ("objects metal filter_material null filter_moving count", "2", False),
]

EVENT_SETS = [
    (f"{FIRST} {BLUE} get_col_partner query_color", "red", False),
    (f"events {BLUE} filter_in unique get_frame", "6", False),
    ("events objects filter_out first filter_order get_object query_shape", "cube", False),
    (f"events objects filter_collision {FIRST} filter_after count", "1", False),
    (f"events objects gray filter_color unique filter_collision {BLUE} filter_collision unique events events objects red filter_color unique filter_out unique filter_ancestor belong_to", "no", True),
    (f"events {BLUE} filter_collision objects sphere filter_shape unique filter_collision second filter_order get_frame", "13", False),
]

CHOICES = [
    (pair("red", "blue") + UNSEEN, "yes", True),
    (pair("red", "gray") + UNSEEN, "no", True),
    ("objects blue filter_color unique events objects filter_collision belong_to", "no", True),
    ("objects metal filter_material unique query_shape", "cube", False),
    ("objects count", "4", False),
    ("events first filter_order get_frame", "0", False),
    ("red", None, False),
    ("", "1", False),
    (None, "1", True),
    ("unseen_events count", "3", True),
]


@pytest.fixture(scope="module")
def chain(spark, scene):
    """All chains, from one build."""
    asked = [*OBJECTS, *EVENT_SETS, *CHOICES]
    q = spark.createDataFrame([(n, 7, p.split() if p is not None else None, g, c) for n, (p, g, c) in enumerate(asked)], "id int, scene int, program array<string>, gold string, is_choice boolean")
    rows = chains.build(q.join(scene, "scene"), ["id"], frames=N).orderBy("id").collect()
    plain = lambda t: (t.question, t.answer, (t.evidence.t0, t.evidence.t1, tuple(t.evidence.box)), t.depends_on, t.role)
    done = [(r.status, r.final_answer, [plain(t) for t in r.triplets] if r.triplets is not None else None) for r in rows]
    return {"objects": done[: len(OBJECTS)], "events": done[len(OBJECTS) : -len(CHOICES)], "choices": done[-len(CHOICES) :]}


def test_objects_and_sets(chain):
    whole = (0, N - 1, (0.0, 0.0, 1.0, 1.0))
    got = chain["objects"]
    # every third frame at which the sphere is seen: 6, 9, ...; it is largest from 8 on
    assert got[0] == ("ok", "sphere", [("Which object is the blue object?", "the blue rubber sphere", (9, 9, box(1, 9)), [], "resolve")])
    # both are first seen and detected at frame 4 of 0, 4, 8, ...
    two = ("Which metal objects are there?", "the red metal cube, the gray metal cylinder", (4, 4, union(box(0, 4), box(2, 4))), [], "enumerate")
    assert got[1] == ("ok", "2", [two])
    assert got[2] == ("ok", "no", [("Which green objects are there?", "none", whole, [], "enumerate")])
    # frame 0 by its filter; the nearest detection is at 3
    assert got[3] == ("ok", "gray", [("Which object is the object that is stationary when the video begins?", "the gray metal cylinder", (0, 0, box(2, 3)), [], "resolve")])
    assert got[4] == ("ok", "2", [("Which metal objects are moving?", two[1], (1, 7, two[2][2]), [], "enumerate")])


def test_events_links_and_repeats(chain):
    hit = ("What is the first collision?", "the collision between the red metal cube and the blue rubber sphere at frame 9", (7, 11, union(box(0, 8), box(1, 9))), [], "resolve")
    ball = ("Which object is the blue object?", "the blue rubber sphere", (9, 9, box(1, 9)), [], "resolve")
    got = chain["events"]
    assert got[0] == ("ok", "red", [hit, ball, ("Which object does the blue rubber sphere collide with at frame 9?", "the red metal cube", (9, 9, box(0, 8)), [0, 1], "resolve")])
    assert got[1][2][1] == ("Which entry into the scene involving the blue object happens in the video?", "the blue rubber sphere entering the scene at frame 6", (6, 10, box(1, 8)), [0], "resolve")
    out = ("What is the first exit from the scene?", "the red metal cube exiting the scene at frame 18", (13, 17, box(0, 13)), [], "resolve")
    assert got[2] == ("ok", "cube", [out, ("Which object exits the scene at frame 18?", "the red metal cube", (17, 17, box(0, 17)), [0], "resolve")])
    after = ("Which collisions after the red metal cube and the blue rubber sphere collide at frame 9 are there?", "the collision between the blue rubber sphere and the gray metal cylinder at frame 13", (11, 15, union(box(1, 13), box(2, 11))), [0], "enumerate")
    assert got[3] == ("ok", "1", [hit, after])
    status, _, steps = got[4]
    assert status == "ok" and [s[3] for s in steps] == [[], [], [0, 1], [], [3], [4]]
    assert steps[2][0] == "Which collision involving the gray object and the blue object happens in the video?"
    # the entry and the first collision led to the exit
    assert steps[5][0] == "Which events that led to the red metal cube exiting the scene at frame 18 are there?"
    assert steps[5][1] == f"the blue rubber sphere entering the scene at frame 6; {hit[1]}" and steps[5][2] == (6, 11, union(box(1, 8), hit[2][2])) and steps[5][4] == "enumerate"
    # the sphere is named twice, told once
    assert [s[3] for s in got[5][2]] == [[], [0]] and got[5][2][1][0] == "What is the second collision involving the blue object and the sphere object?".replace("the sphere object", "the sphere")


def test_choices_and_statuses(chain):
    got = chain["choices"]
    assert [g[0] for g in got] == ["ok", "ok", "executor_disagrees", "executor_error", "executor_disagrees", "no_evidence", "executor_disagrees", "executor_error", "executor_error", "no_landmarks"]
    assert got[0][2][2] == ("Do the red metal cube and the blue rubber sphere collide during the video?", "yes, at frame 9", (7, 11, union(box(0, 8), box(1, 9))), [0, 1], "observe")
    assert got[1][2][2] == ("Do the red metal cube and the gray metal cylinder collide during the video?", "no", (13, 17, union(box(0, 17), box(2, 17))), [0, 1], "observe")
    assert all(g[2] is None for g in got[2:])


def test_counts(spark, scene):
    c = spark.createDataFrame([("a", "ok", [1, 2]), ("a", "ok", [3, 4]), ("a", "no_evidence", None), ("b", "ok", [1])], "question_type string, status string, triplets array<int>")
    assert {tuple(r) for r in chains.status_counts(c).collect()} == {("a", "ok", 2, 2), ("a", "no_evidence", None, 1), ("b", "ok", 1, 1)}


def runs_of(b, size=1024):
    """Column-major runs, zeros first, of a box on a square of ``size``."""
    x0, y0, x1, y1 = (round(v * size) for v in b)
    out, at = [], 0
    for x in range(x0, x1):
        out += [x * size + y0 - at, y1 - y0]
        at = x * size + y1
    return out + [size * size - at]


@pytest.fixture(scope="module")
def split(tmp_path_factory):
    """The scene, its detections and all questions as files; scenes that nothing asks about cannot be opened."""
    top = tmp_path_factory.mktemp("split")
    trips = {i: dict(zip(("color", "material", "shape"), look)) for i, *look in LOOKS}
    at = lambda i, f: {"object_id": i, "velocity": [1.0 if i != 2 or f >= 12 else 0.0, 0.0, 0.0], **({} if (i, f) in SEEN else {"inside_camera_view": False})}
    body = {"scene_index": 7, "video_filename": "video_00007.mp4", "object_property": [{"object_id": i, **t} for i, t in trips.items()], "motion_trajectory": [{"frame_id": f, "objects": [at(i, f) for i in range(3)]} for f in range(N)], "collision": [{"object_ids": o, "frame_id": f} for t, f, o in EVENTS if t == "collision"]}
    folder = top / "annotations" / "train" / "annotation_train" / "annotation_00000-01000"
    folder.mkdir(parents=True)
    (folder / "annotation_00007.json").write_text(json.dumps(body))
    (folder / "annotation_00900.json").symlink_to("/nowhere/at/all")
    mask = lambda b, score, i: {"mask": {"size": [1024, 1024], "counts": json.dumps(runs_of(b))}, "score": score, **trips[i]}
    found = [{"frame_index": f, "objects": [mask(box(i, f), 0.9, i) for i in range(3) if (i, f) in FOUND]} for f in range(N)]
    found[6]["objects"] += [mask((0, 0, 1, 1), s, 1) for s in (0.5, 0.9)] + [{"mask": {"size": [1024, 1024], "counts": "[1048576]"}, "score": 1.0, **trips[1]}]
    (top / "derender_proposals").mkdir()
    (top / "derender_proposals" / "proposal_00007.json").write_text(json.dumps({"video_name": "v", "frames": found}))
    asked = []
    for n, (p, g, c) in enumerate([*OBJECTS, *EVENT_SETS, *CHOICES]):
        words = p.split() if p is not None else None
        q = {"question_id": n, "question": f"question {n}?", "question_type": "counterfactual" if c else "descriptive", "question_subtype": None if c else "query"}
        if c:
            cut = len(words) // 2 if words is not None else 0
            q |= {"program": words and words[cut:], "choices": [{"choice_id": 4, "choice": "this", "program": words and words[:cut], "answer": "correct" if g == "yes" else "wrong"}]}
        else:
            q |= {"program": words, "answer": g}
        asked.append(q)
    (top / "questions").mkdir()
    other = {"scene_index": 8, "video_filename": "video_00008.mp4", "questions": [{"question_id": 0, "question": "?", "question_type": "descriptive", "program": ["objects", "count"], "answer": "0"}]}
    (top / "questions" / "train.json").write_text(json.dumps([{"scene_index": 7, "video_filename": "video_00007.mp4", "questions": asked}, other]))
    return str(top)


def test_files_to_files(spark, split, chain, tmp_path):
    counts = chain_files.generate(spark, split, "train", f"{tmp_path}/out", n_videos=1, frames=N).collect()
    want = [*chain["objects"], *chain["events"], *chain["choices"]]
    done = {r.question_id: r for r in spark.read.parquet(f"{tmp_path}/out/outcomes").collect()}
    assert sorted(done) == list(range(len(want))) and {r.scene for r in done.values()} == {7}
    for n, (status, _, steps) in enumerate(want):
        # an unknown or failed choice's known answer is no, if it is not correct
        assert done[n].status == status, n
        assert (done[n].triplets is None) == (steps is None)
    lines = {x["meta"]["question_id"]: x for x in (json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out/chains").collect())}
    assert sorted(lines) == [n for n, w in enumerate(want) if w[0] == "ok"]
    for n, x in lines.items():
        told = [(t["question"], t["answer"], (t["evidence"]["t_start"], t["evidence"]["t_end"], tuple(t["evidence"]["box"])), t["depends_on"], t["role"]) for t in x["triplets"]]
        assert told == want[n][2] and x["final_answer"] == want[n][1] and x["video_id"] == "video_00007.mp4"
        assert ("choice" in x["meta"]) == (x["question_type"] == "counterfactual")
    first = len(OBJECTS) + len(EVENT_SETS)
    assert lines[first]["meta"]["choice_id"] == 4 and lines[first]["meta"]["executor_answer"] == "unknown" and lines[0]["meta"]["question_subtype"] == "query"
    assert sum(r.n for r in counts) == len(want) and sum(r.n for r in counts if r.status == "ok") == len(lines)
    assert files.records(spark, f"{tmp_path}/out/chains", files.CHAIN).count() == len(lines)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        chain_files.generate(spark, split, "train", f"{tmp_path}/out", n_videos=1, frames=N)


def test_types_and_missing_scenes(spark, split, tmp_path):
    # no annotation of scene 8, and none of the questions of this type
    got = chain_files.generate(spark, split, "train", f"{tmp_path}/few", types=["descriptive"], frames=N)
    assert {r.kind for r in got.collect()} == {"descriptive"}
    assert chain_files.generate(spark, split, "train", f"{tmp_path}/none", types=["explanatory"], frames=N).collect() == []
