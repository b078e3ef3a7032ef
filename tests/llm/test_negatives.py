import random

import numpy as np
import pytest

from pramana.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows):
    """The hard negatives by scoring all pairs with Python's integers; one row of each id."""
    first = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [int(np.floor(256 * float(x))) for x in v]
        key = ((label + 1) % 10 if i % 7 == 0 else label, np.array(v, np.int32).tobytes())
        if i not in first or key < first[i][:2]:
            first[i] = (*key, v)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, (label, _, v) in first.items():
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, other) for j, (other, _, w) in first.items() if j != i)
        for p, pid, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(n, nid) for n, nid, other in scored if other != label and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out |= {(i, pid, k, nid, -p, -n) for k, (n, nid) in enumerate(fit, 1)}
    return out


def mined(df):
    got = [tuple(r) for r in negatives.hard_negatives(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(n, dims, labels, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dims)) * spread
    own = rng.integers(0, labels, n)
    return [(i, int(own[i]), [float(x) for x in (centre[own[i]] + rng.normal(size=dims)).astype(np.float32)]) for i in range(n)]


def test_equals_plain(spark):
    rows = vectors(1500, 24, 4, 1, 0.4)
    rows += [(5000 + k, rows[k % 9][1] if k % 2 else 9, rows[k % 9][2]) for k in range(60)]  # ties between copies
    got = mined(spark.createDataFrame(rows, SCHEMA))
    assert got == plain(rows) and len(got) > 200


def test_many_tasks_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "MOST_ROWS", 97)
    monkeypatch.setattr(negatives, "FEWEST_ROWS", 10)
    for name, size in (("BLOCK", 40), ("ANCHORS", 3), ("CHUNK", 5)):
        monkeypatch.setattr(negatives, name, size)
    rows = vectors(800, 17, 3, 2, 1.5)
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), [rng.choice([0.0, 0.5, -0.25, 1e-9]) for _ in range(rng.choice([4, 4, 4, 2, 0, 7]))]) for i in range(400)]
    rows += [(100, 2, [1.0, 1.0]), (100, 1, [1.0, 1.0, 2.0, 0.5]), (7, 1, [float("nan"), 1.0]), (8, 1, [float("inf")]), (9, 1, [None, 1.0]), (10, 1, None), (None, 1, [1.0, 2.0]), (-700, 1, [0.5, 0.5]), (-701, 2, [0.25, 0.5])]
    rows += rows[:50]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as g", "3 as kind", "'x' as v", "'y' as rank")
    assert mined(df) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(0, 1, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0])], [(0, 1, [0.0]), (1, 1, [1.0]), (2, 2, [3.0])], [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-0.5])]])
def test_few_rows(spark, rows):
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_large_components_are_exact(spark):
    rows = [(i, label, [v * 300000.0 + i, 250001.0 * v + 1]) for i, label, v in ((0, 1, 1), (1, 1, 2), (2, 2, 1), (3, 3, 1), (4, 1, 1), (5, 2, 0.5))]
    rows.append((6, 2, [2.0**21, 1.0]))
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    assert mined(df) == plain(rows[:-1])


def test_index_finds_exactly_what_is_above():
    rng = np.random.default_rng(5)
    x = rng.integers(-99, 100, (500, 40)) // rng.integers(1, 12, 40)
    q = x[:30] + rng.integers(-5, 6, (30, 40))
    index = negatives.Index(np.arange(500), np.zeros(500), x.astype(np.int32))
    score = q @ x.T
    for share in (0.9, 0.4, 0.1, 0.0, -1.0):
        t = (score.max(axis=1) * share).astype(np.int64)
        a, r, s = index.above(q, t)
        assert {*zip(a.tolist(), r.tolist(), s.tolist())} == {(i, j, score[i, j]) for i, j in zip(*np.nonzero(score >= t[:, None]))}


def test_text_ids_are_refused(spark):
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([("a", 1, [1.0])], "vec_id string, label int, embedding array<float>"))
