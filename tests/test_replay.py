"""Jumps of the generator and replayed controls against plain sequential runs."""

import random

import numpy as np
import pytest

from pramana.functions import twister
from pramana.operators import replay


def test_the_recurrence_has_the_degree_of_the_state():
    assert twister.recurrence().bit_length() == twister.DEGREE + 1


@pytest.mark.parametrize("seed, skipped", [(0, 0), (0, 1), (7, 311), (7, 312), (123456789, 100_003)])
def test_jumps_equal_walking(seed, skipped):
    r = random.Random(seed)
    for _ in range(skipped):
        r.random()
    assert twister.uniforms(seed, skipped, 700).tolist() == [r.random() for _ in range(700)]


def test_jumps_add_up():
    """Far beyond what could be walked: two jumps are one."""
    a, b = 10**13 + 7, 10**12 + 3
    both = twister._reduced(_product(twister.power(a), twister.power(b)), twister.recurrence())
    assert both == twister.power(a + b)


def _product(a, b):
    out = 0
    for k, bit in enumerate(reversed(format(b, "b"))):
        if bit == "1":
            out ^= a << k
    return out


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


@pytest.mark.parametrize("together", [13, 100, 10_000])
def test_controls_equal_the_sequential_run(spark, together):
    """File order by line and box over several parts, boxes larger than the frame and rows without a box among them."""
    rng = np.random.default_rng(3)
    rows = []
    for line in range(150):
        for j in range(int(rng.integers(0, 4))):
            x, y, w, h = rng.random(4).tolist()
            rows.append((line, j, (x, y, x + w * 1.2, y + h) if rng.random() < 0.9 else None, "k"))
    seed, want = 5, {}
    r = random.Random(seed)
    for line, j, b, _ in rows:
        if b:
            w, h = b[2] - b[0], b[3] - b[1]
            x, y = r.uniform(0.0, max(0.0, 1.0 - w)), r.uniform(0.0, max(0.0, 1.0 - h))
            want[line, j] = (x, y, x + w, y + h)
        else:
            want[line, j] = None
    df = spark.createDataFrame(rows, f"line int, j int, box {BOX}, extra string").repartition(6)
    got = replay.replayed_controls(df, ["line", "j"], seed=seed, together=together).collect()
    assert {(g.line, g.j): g.control and tuple(g.control) for g in got} == want and got[0].extra == "k"


def test_no_boxes(spark):
    df = spark.createDataFrame([(1, None)], f"line int, box {BOX}")
    assert [r.control for r in replay.replayed_controls(df, ["line"]).collect()] == [None]
    assert replay.replayed_controls(df.limit(0), ["line"]).count() == 0
