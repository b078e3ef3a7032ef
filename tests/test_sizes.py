"""What grows with the input goes through no driver and is made once."""

import pytest

from pramana.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", "control_coverage object_grounding object_tracks mask_skips entity_regions mirrored_control best_iou_per_step process_reward process_scores sft_records".split())
def test_no_side_of_a_join_is_sent_to_all(spark, sf_dir, name):
    text = plan(registry.QUERIES[name](spark, sf_dir))
    assert "Broadcast" not in text
    assert "SortMergeJoin" in text


def test_a_text_is_read_once(spark, sf_dir):
    assert plan(registry.QUERIES["chain_parse"](spark, sf_dir)).count("ArrowEvalPython") == 1


def test_keys_of_chains_are_dealt(spark, sf_dir):
    from pramana.plans import derive as D

    assert D.chain_texts(spark, sf_dir).rdd.getNumPartitions() >= 4


def test_a_scene_row_has_no_list_of_causes_for_each_event(spark):
    from pyspark.sql import functions as F

    from pramana.operators import programs as P

    log = spark.range(300).select(F.lit(1).alias("scene"), F.col("id").cast("int").alias("ord"), F.lit("collision").alias("type"), F.col("id").cast("int").alias("frame"), F.array((F.col("id") % 2).cast("int"), F.lit(7)).alias("objects"))
    objs = spark.sql("select 1 scene, 7 obj, 'red' color, 'metal' material, 'cube' shape")
    rows = P.scene_rows(objs, spark.sql("select 1 scene, 7 obj, 0 frame, 0.0D speed"), log)
    # an exploded row for each event and cause of a log: the square of its length
    assert "Generate" not in plan(rows)
    asked = rows.select("*", F.split(F.lit("events events objects filter_collision last filter_order filter_ancestor count"), " ").alias("program"))
    assert P.run(asked).first().answer == "299"


def test_nested_texts_are_made_once_whatever_the_depth(spark):
    from pyspark.sql import functions as F

    from pramana.operators.profiles import nested_profile

    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    texts = spark.range(6).select(F.lit('{"a": [{"b": [1, 2]}]}').alias("j")).mapInArrow(told, "j string")
    assert nested_profile(texts, "j").count() == 5
    assert seen.value == 6


@pytest.mark.parametrize("name", "mask_skips object_tracks object_grounding mirrored_control_intervals untouched_intervals text_intervals dose_intervals".split())
def test_texts_behind_citations_are_parsed_before_they_are_joined(spark, sf_dir, name):
    assert "ArrowEvalPython" not in plan(registry.QUERIES[name](spark, sf_dir))


def below(text, head):
    return text[text.index(head) :]


def test_equal_regions_of_a_scene_are_held_against_detections_once(spark):
    from pyspark.sql import functions as F

    from pramana.operators import regions as R

    box = F.expr("named_struct('x0', 0.1D, 'y0', 0.1D, 'x1', 0.5D, 'y1', 0.5D)").alias("box")
    regions = spark.range(5).select("id", F.expr("id % 1 + 1").alias("scene"), F.expr("id % 1 + 2").alias("t0"), F.expr("id % 1 + 4").alias("t1"), box)
    seen = spark.sql("select 1 scene, 'red' color, 3 frame").select("*", box)
    found = R.evidence_objects(regions, seen, ["color"])
    assert sorted(map(tuple, found.collect())) == [(k, 1, "red") for k in range(5)]
    assert "HashAggregate(keys=[scene" in below(plan(found), "Generate explode(")


def test_equal_questions_for_an_object_are_asked_once(spark):
    from pyspark.sql import functions as F

    from pramana.operators import regions as R

    box = F.expr("named_struct('x0', 0.1D, 'y0', 0.1D, 'x1', 0.5D, 'y1', 0.5D)").alias("box")
    one = "array(named_struct('color', 'red'), named_struct('color', 'red'))"
    steps = spark.range(5).select("id", F.expr("id % 1 + 1").alias("scene"), F.expr("id % 1 + 2").alias("t0"), F.expr("id % 1 + 4").alias("t1"), box, F.expr(one).alias("objects"))
    seen = spark.sql("select 1 scene, 'red' color, 6 frame").select("*", box)
    scored = R.step_scores(steps, seen, ["id"], ["color"])
    # an object named twice is found once, as it was before
    assert sorted(map(tuple, scored.collect())) == [(k, 1.0, False, 2) for k in range(5)]
    assert "HashAggregate(keys=[scene" in below(plan(scored), "Generate explode(")


def test_an_item_takes_a_list_for_each_of_its_phrases(spark):
    from pyspark.sql import functions as F

    from pramana.operators import strata as X

    box = F.expr("named_struct('x0', 0.1D, 'y0', 0.1D, 'x1', 0.5D, 'y1', 0.5D)").alias("box")
    steps = spark.range(3).select("id", F.expr("id % 1 + 1").alias("video"), F.when(F.col("id") < 2, "dog").otherwise("cat").alias("entity"), F.lit(3).alias("t0"), F.lit(9).alias("t1"), box)
    tracks = spark.range(2).select(F.expr("id % 1 + 1").alias("video"), F.concat(F.lit("dog"), F.repeat(F.lit("s"), (F.col("id") % 1).cast("int"))).alias("phrase"), F.col("id").cast("int").alias("frame"), box)
    e = X.entity_regions(steps, tracks)
    assert sorted((r.id, [(x.t0, x.t1) for x in r.regions]) for r in e.collect()) == [(k, [(0, 0), (3, 9), (8, 8)]) for k in range(2)]
    assert "HashAggregate(keys=[video" in plan(e).replace("ObjectHashAggregate", "HashAggregate") and "collect_set" not in plan(e)


@pytest.mark.parametrize("name", ["process_scores", "process_reward"])
def test_texts_of_both_sides_are_parsed_once_before_they_meet(spark, sf_dir, name):
    assert "ArrowEvalPython" not in plan(registry.QUERIES[name](spark, sf_dir))


def test_texts_without_a_question_are_not_parsed(spark, sf_dir):
    text = plan(registry.QUERIES["sft_records"](spark, sf_dir))
    assert text.count("ArrowEvalPython") == 1 and "LeftSemi" in below(text, "ArrowEvalPython")
