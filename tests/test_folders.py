"""The source of scene folders: what it reads, and what it leaves shut."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pramana.sources import folders


@pytest.fixture(scope="module")
def root(tmp_path_factory, spark):
    """Three folders; files of the scenes 12, 1500 and 2999 can be opened, all others lead nowhere."""
    top = tmp_path_factory.mktemp("scenes")
    for low in (0, 1000, 2000):
        d = top / f"annotation_{low:05d}-{low + 1000:05d}"
        d.mkdir()
        for s in (low, low + 12, low + 500, low + 999):
            f = d / f"annotation_{s:05d}.json"
            if s in (12, 1500, 2999):
                body = {"scene_index": s, "object_property": [{"object_id": 0, "color": "red", "material": "metal", "shape": "cube"}] * (s % 10), "motion_trajectory": [], "collision": []}
                f.write_text(json.dumps(body))
            else:
                os.symlink("/nowhere/at/all", f)
    (top / "annotation_00000-01000" / "notes.txt").write_text("no scene")
    (top / "other").mkdir()
    folders.use_scene_folders(spark)
    return str(top)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_scene_opens_one_file(spark, root):
    df = folders.annotations(spark, root).where("scene = 12")
    r = df.collect()
    assert [(x.scene, len(x.object_property)) for x in r] == [(12, 2)]
    assert df.rdd.getNumPartitions() == 1
    # the source has taken the filter: Spark has none left to apply
    assert "BatchScan scene_folders" in plan(df) and "Filter" not in plan(df).replace("RuntimeFilters", "")


@pytest.mark.parametrize("rule, want", [("scene in (12, 2999, 7)", [12, 2999]), ("scene > 1499 and scene <= 1500", [1500]), ("scene >= 2999", [2999]), ("scene < 0", []), ("scene = 12 and scene = 1500", []), ("scene in (12, 1500) and scene > 100", [1500]), ("scene = 77", [])])
def test_filters_choose_what_is_opened(spark, root, rule, want):
    assert sorted(r.scene for r in folders.scene_texts(spark, root).where(rule).select("scene", F.length("text")).collect()) == want


def test_without_text_nothing_is_opened(spark, root):
    names = spark.read.format("scene_folders").schema("scene int, file string").load(root)
    assert names.count() == 12 and names.where("scene = 1012").first().file.endswith("annotation_01012.json")


def test_a_broken_file_that_is_wanted_is_told(spark, root):
    with pytest.raises(Exception, match="nowhere|No such file"):
        folders.scene_texts(spark, root).where("scene = 500").collect()


def test_other_filters_stay_with_spark(spark, root):
    df = folders.annotations(spark, root).where("scene in (12, 1500, 2999) and size(object_property) > 1")
    assert sorted(r.scene for r in df.collect()) == [12, 2999]


def test_detections(spark, tmp_path):
    d = tmp_path / "sim_00000-01000"
    d.mkdir()
    (d / "sim_00003.json").write_text(json.dumps({"video_name": "v", "frames": [{"frame_index": 4, "objects": [{"color": "red"}]}, {"frame_index": 5, "objects": []}]}))
    folders.use_scene_folders(spark)
    assert sorted((r.scene, r.frame, len(r.objects)) for r in folders.detections(spark, str(tmp_path)).collect()) == [(3, 4, 1), (3, 5, 0)]
