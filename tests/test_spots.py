"""What is made of an item's boxes is made in its row."""

import pytest
from pyspark.sql import functions as F

from pramana.functions import geometry as G
from pramana.operators import strata as X
from pramana.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["entity_control", "mirrored_control"])
def test_regions_and_controls_pass_no_shuffle(spark, sf_dir, name):
    text = plan(registry.QUERIES[name](spark, sf_dir))
    assert "Exchange" not in text[: text.index("SortMergeJoin")]


def test_frames_of_spans_beyond_the_clip(spark):
    spans = [(a, a + n) for a in range(-12, 145) for n in (-9, -1, 0, 3, 40)] + [(None, 3), (3, None)]
    got = spark.createDataFrame(spans, "a int, b int").select("a", "b", G.frames_hit("a", "b").alias("f")).collect()
    for r in got:
        assert r.f == ([] if None in (r.a, r.b) else [i for i, p in enumerate(G.grid()) if r.a - 4 <= p <= r.b + 4])


def test_controls_of_items_without_their_detections_are_rated_alike(spark):
    box = lambda x: F.expr(f"named_struct('x0', {x}, 'y0', 0.1D, 'x1', {x} + 0.3D, 'y1', 0.4D)").alias("box")
    steps = spark.range(4).select("id", (F.col("id") % 2).alias("video"), F.when(F.col("id") < 3, "dog").otherwise("cat").alias("entity"), F.lit(3).alias("t0"), F.lit(9).alias("t1"), box("id % 3 / 10.0D"))
    tracks = spark.range(12).select((F.col("id") % 2).alias("video"), F.get(F.array(*map(F.lit, ("dog", "cat", "man"))), (F.col("id") % 3).cast("int")).alias("phrase"), (F.col("id") % 4).cast("int").alias("frame"), box("id % 5 / 8.0D"))
    e = X.avoiding_regions(X.entity_regions(steps, tracks))
    share = lambda d: sorted(map(tuple, X.entity_control_share(d, steps, tracks).collect()))
    assert len(share(e)) == 4 and share(e) == share(e.drop("names", "seen"))
