"""Streams with state against the same functions over a table of all rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pramana.sources import readers
from pramana.streaming import running, stateful

START = datetime(2024, 5, 1)
ROWS = "id long, condition string, kind string, correct int, ts timestamp"


@pytest.fixture()
def rocks(spark):
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(minutes):
    return START + timedelta(minutes=minutes)


def run(spark, df, tmp, name, mode):
    """Runs what is there, and stops: the next call goes on from the checkpoint."""
    got = []

    def keep(batch, number):
        got.extend(batch.collect())

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{tmp}/cp_{name}").start()
    try:
        q.processAllAvailable()
        state = [o for p in q.recentProgress for o in p["stateOperators"]]
    finally:
        q.stop()
    return got, state


def flips(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        first = rng.randrange(0, 600)
        for c in ("plain", "mask_a", "mask_b", "other"):
            if rng.random() < 0.9:
                rows.append((i, c, f"k{i % 3}", int(rng.random() < 0.6), at(first + rng.randrange(0, 50))))
    return rows


def test_flips_in_batches_equal_the_table(rocks, tmp_path):
    """Rows over several batches and a restart: partners in other batches, missing, repeated, too far apart."""
    rows = sorted(flips(120, 1), key=lambda r: r[4])
    rows += [(1000, "plain", "k0", 1, at(10)), (1000, "mask_a", "k0", 0, at(12)), (1000, "mask_b", "k0", 1, at(300))]  # too far apart
    rows.sort(key=lambda r: r[4])
    again = [(i, c, k, 1 - y, t + timedelta(minutes=1)) for i, c, k, y, t in rows[::7]]  # later rows of what is known
    rows = sorted(rows + again, key=lambda r: r[4])
    end = [(-1, c, "end", 1, at(5000)) for c in ("plain", "mask_a", "mask_b")] + [(-2, "plain", "end", 1, at(20000))]
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    size = len(rows) // 4 + 1
    cuts = [rows[k : k + size] for k in range(0, len(rows), size)] + [end[:3], end[3:]]
    schema = rocks.createDataFrame([], ROWS).schema
    stream = rocks.readStream.schema(schema).parquet(folder)
    within = timedelta(minutes=60)
    got, sizes = [], []
    for k, part in enumerate(cuts):
        rocks.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(folder)
        items = stateful.paired_items(stream, "mask_a", "mask_b", within, "50 minutes")
        new, state = run(rocks, stateful.flip_sums(items, "2 hours"), tmp_path, "flips", "append")  # a new query each time
        got += [tuple(r) for r in new]
        sizes += [s["numRowsTotal"] for s in state if "transformWithState" in s["operatorName"]]
    table = rocks.createDataFrame(rows + end, ROWS)
    want = stateful.flip_sums(stateful.paired_items(table, "mask_a", "mask_b", within), "2 hours")
    want = [tuple(r) for r in want.collect() if r.kind != "end"]
    got = [r for r in got if r[1] != "end"]
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 60
    # what is held at the end are the items of the last time only
    assert sizes[-1] <= 4


def test_late_rows_go_and_state_follows_the_watermark(rocks, tmp_path):
    folder = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    schema = rocks.createDataFrame([], ROWS).schema
    stream = rocks.readStream.schema(schema).parquet(folder)
    got, held = [], []
    for k in range(6):
        part = [(100 * k + i, "plain", "k", 1, at(200 * k + i)) for i in range(20)]
        part += [(100 * k + i, "mask_a", "k", 0, at(200 * k + i)) for i in range(20)]
        part += [(100 * k + i, "mask_b", "k", 1, at(200 * k + i)) for i in range(10)]  # ten never get their last row in time
        if k == 4:
            part += [(i, "mask_b", "k", 0, at(i)) for i in range(10, 20)]  # late by far
        rocks.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(folder)
        new, state = run(rocks, stateful.paired_items(stream, "mask_a", "mask_b", timedelta(minutes=30), "20 minutes"), tmp_path, "late", "append")
        got += new
        held.append([s["numRowsTotal"] for s in state][-1])
    assert sorted(r.id for r in got) == [100 * k + i for k in range(6) for i in range(10)]
    assert all((r.right, r.flip_a, r.flip_b) == (1, 1, 0) for r in got)
    assert max(held[1:]) <= held[0] * 2 + 4


def test_paired_items_of_a_table(spark):
    rows = [(1, "plain", "k", 1, at(0)), (1, "a", "k", 0, at(5)), (1, "a", "k", 1, at(4)), (1, "b", "k", 0, at(4)), (1, "b", "k", 1, at(4)), (2, "plain", "k", 1, at(0)), (2, "a", "k", 0, at(1)), (3, "plain", "k", 0, at(0)), (3, "a", "k", 0, at(1)), (3, "b", "k", 0, at(1)), (4, "plain", "k", 1, at(0)), (4, "a", "k", 1, None), (None, "a", "k", 1, at(0)), (5, "plain", None, None, at(0))]
    got = {r.id: tuple(r)[3:] for r in stateful.paired_items(spark.createDataFrame(rows, ROWS), "a", "b", timedelta(minutes=10)).collect()}
    assert got == {1: (1, 0, 1), 3: (0, 0, 0)}
    s = stateful.gaps(stateful.flip_sums(stateful.paired_items(spark.createDataFrame(rows, ROWS), "a", "b", timedelta(minutes=10))), ["kind"]).first()
    assert (s.n, s.n_correct, s.flip, s.flip_control, s.gap) == (2, 1, 0.0, 1.0, -1.0)


@pytest.mark.parametrize("cuts", [[37], [1, 2, 3, 10, 11, 30], [10, 20, 30]])
def test_log_tail_equals_windows_of_the_table(rocks, tmp_path, cuts):
    """Windows of ten rows over two logs, cut anywhere, each batch by a query that goes on from the checkpoint."""
    rng = random.Random(len(cuts))
    schema = "run string, step long, sec double, reward double, r_format double, kl double, grad_norm double, skipped boolean"
    rows = [(r, 3 * k, k * 1.5, rng.choice([rng.random(), None]), rng.random(), rng.random(), None if k % 5 else rng.random(), rng.choice([True, False, None])) for k in range(43) for r in ("x", "y")]
    folder = str(tmp_path / "log")
    (tmp_path / "log").mkdir()
    stream = rocks.readStream.schema(rocks.createDataFrame([], schema).schema).parquet(folder)
    last = {}
    for a, b in zip([0, *cuts], [*cuts, 43]):
        rocks.createDataFrame(rows[2 * a : 2 * b], schema).coalesce(1).write.mode("append").parquet(folder)
        new, _ = run(rocks, stateful.tail_windows(stream, 10), tmp_path, "log", "update")
        for r in new:
            assert r.n >= last.get((r.part, r.window), r).n
            last[(r.part, r.window)] = r
    want = {(r.part, r.window): r.asDict() for r in stateful.tail_windows(rocks.createDataFrame(rows, schema), 10).collect()}
    rounded = lambda d: {k: round(v, 9) if isinstance(v, float) else v for k, v in d.items()}
    assert {k: rounded(r.asDict()) for k, r in last.items()} == {k: rounded(r) for k, r in want.items()} and len(want) == 10


def test_tail_of_a_table_leaves_out_rows_without_a_step(spark):
    df = spark.createDataFrame([("x", None, 0.0, 1.0, False), ("x", 1, 0.0, 2.0, False)], "run string, step int, sec double, reward double, skipped boolean")
    assert [(r.n, r.reward) for r in stateful.tail_windows(df, 2).select("n", F.col("reward")).collect()] == [(1, 2.0)]


def test_rows_are_appended_once_over_restarts(spark, tmp_path):
    row = "tag string, condition string, id string, correct int"
    for n, rows in enumerate(([("a", "plain", "1", 1), ("a", "blind", "1", 0)], [("a", "plain", "2", 1)], [("b", "plain", "1", 0), ("a", "plain", "1", 0)])):
        spark.createDataFrame(rows, row).coalesce(1).write.json(f"{tmp_path}/in/{n}")
        q = running.append_runs(spark.readStream.schema(row).json(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/cp", availableNow=True)
        q.awaitTermination()
    back = spark.read.schema(row).json(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select("tag", "condition", "id", "correct").collect())) == [("a", "blind", "1", 0), ("a", "plain", "1", 0), ("a", "plain", "1", 1), ("a", "plain", "2", 1), ("b", "plain", "1", 0)]
    one = readers.run_rows(spark, f"{tmp_path}/out/tag=a/condition=plain", "id string, correct int")
    assert {(r.id, r.correct) for r in one.collect()} >= {("2", 1)} and one.count() == 2
