"""Clustered intervals by stratum, and the strata that reports are cut into.

An item table has one row for each item: id, cluster, and a column for each condition. Strata are added as a
column, or as an array to be exploded where an item is in several.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from pramana.functions import geometry as G
from pramana.functions import spots as S
from pramana.functions import text as T
from pramana.functions.joins import dealt
from pramana.operators.stats import resampled

REPLICATES = 2000


def right_under_plain(df: DataFrame, a: str, b: str, stratum: str = "stratum", cluster: str = "qset") -> DataFrame:
    """(stratum, cluster, w, x, y): items with both runs; w says whether plain is right, x and y whether the runs flip it."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("plain").isNotNull() & F.col(stratum).isNotNull())
    return both.select(F.col(stratum).alias("stratum"), F.col(cluster).alias("cluster"), F.col("plain").alias("w"), (1 - F.col(a)).alias("x"), (1 - F.col(b)).alias("y"))


def clustered(items: DataFrame, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """(stratum, n, flip, flip_lo, flip_hi, flip_control, gap, gap_lo, gap_hi) of items (stratum, cluster, w, x, y).

    Whole clusters are weighted anew within each stratum (``resampled``); only their sums are, not their items.
    Replicates without a counted item are left out, strata without one are absent.
    """
    counted = lambda c: F.sum(F.col("w") * F.col(c))
    sums = items.groupBy("stratum", "cluster").agg(F.sum("w").alias("n"), counted("x").alias("sx"), counted("y").alias("sy"))
    sizes = sums.groupBy("stratum").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy")])
    total = resampled(sums, replicates, seed).where("n > 0")
    flip, gap = F.col("sx") / F.col("n"), F.col("sx") / F.col("n") - F.col("sy") / F.col("n")
    # a list of as many values as there are replicates for each stratum
    lists = total.groupBy("stratum").agg(F.array_sort(F.collect_list(flip)).alias("flips"), F.array_sort(F.collect_list(gap)).alias("gaps"))

    def at(values: str, share: float) -> Column:
        n = F.size(values)
        return F.get(values, F.least(n - 1, F.floor(F.lit(share) * n).cast("int")))

    ends = lists.select("stratum", at("flips", 0.025).alias("flip_lo"), at("flips", 0.975).alias("flip_hi"), at("gaps", 0.025).alias("gap_lo"), at("gaps", 0.975).alias("gap_hi"))
    means = sizes.where("n > 0").select("stratum", "n", flip.alias("flip"), (F.col("sy") / F.col("n")).alias("flip_control"), gap.alias("gap"))
    return means.join(ends, "stratum", "left").select("stratum", "n", "flip", "flip_lo", "flip_hi", "flip_control", "gap", "gap_lo", "gap_hi")


# ---- strata: each gives (id, ...) for items, from steps (id, entity, t0, t1, box) and tracks (video, phrase, frame, box)


def by_text(steps: DataFrame, prompts: DataFrame) -> DataFrame:
    """(id, strata): in_text or not_in_text, and no_overlap, by whether the prompt names all (or shares no word with) the entities."""
    named = steps.where("entity is not null").groupBy("id").agg(F.collect_set("entity").alias("e"))
    both = named.join(dealt(prompts), "id")
    strata = F.array(F.when(T.entities_in_text("e", "prompt"), "in_text").otherwise("not_in_text"), F.when(T.entities_in_text("e", "prompt", "none"), "no_overlap"))
    return both.select("id", F.array_compact(strata).alias("strata"))


def control_coverage(steps: DataFrame, control: str = "control") -> DataFrame:
    """(id, covered): mean over an item's boxes of the largest share that a control box covers on a frame of both."""
    # equal boxes of an item have one best cover: they are one row with their number, known by what is in it
    r = steps.groupBy("id", "t0", "t1", "box", F.col(control).alias("c")).agg(F.count("*").alias("times")).withColumn("f", G.frames_hit("t0", "t1"))
    other = r.select("id", F.col("f").alias("of"), F.col("c").alias("oc")).distinct()
    pairs = r.join(dealt(other), "id", "left").withColumn("share", F.when(F.arrays_overlap("f", "of"), G.overlap_share(F.col("box"), F.col("oc"))))
    best = pairs.groupBy("id", "t0", "t1", "box", "c").agg(F.first("times").alias("times"), F.coalesce(F.max("share"), F.lit(0.0)).alias("best"))
    return best.groupBy("id").agg((F.sum(F.col("best") * F.col("times")) / F.sum("times")).alias("covered"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    v = F.col("covered")
    return covered.agg(F.count("*").alias("n"), F.avg(v).alias("mean_covered"), F.avg((v == 0).cast("int")).alias("share_untouched"), F.avg((v >= 0.5).cast("int")).alias("share_half_covered"))


def recite(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """Where the steps written under a mask cite, relative to the plain run's: one row of shares and counts.

    old, new: (id, entity, t0, t1, box) of the same items. A step is on the same box, on the same frame at another place,
    or on another frame. Items with named entities count as the same if both runs name the same set.
    """
    ids = lambda d, c: d.groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias(c))
    items = ids(old, "was").join(dealt(ids(new, "now")), "id", "left")
    met = items.where("now is not null")
    boxes = old.select("id", F.explode(G.frames_hit("t0", "t1")).alias("frame"), F.col("box").alias("was_box"))
    # equal citations of an item are one row with their number, known by what is in it
    cites = new.join(dealt(met.select("id")), "id", "left_semi").groupBy("id", G.frame_of("t0", "t1").alias("frame"), "box").agg(F.count("*").alias("times"))
    best = cites.join(dealt(boxes), ["id", "frame"], "left").groupBy("id", "frame", "box").agg(F.first("times").alias("times"), F.max(F.when(F.col("was_box").isNotNull(), G.iou("box", "was_box"))).alias("best"))
    share = lambda c: F.coalesce(F.sum(F.when(c, F.col("times")).otherwise(0)) / F.sum("times"), F.lit(0.0))
    steps = best.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("steps"), share(F.coalesce(F.col("best") >= least, F.lit(False))).alias("same_box"), share(F.coalesce(F.col("best") < least, F.lit(False))).alias("same_frame_other_place"), share(F.col("best").isNull()).alias("other_frame"))
    named = (F.size("was") > 0) | (F.size("now") > 0)
    per = items.agg(F.count("now").alias("items"), F.avg(F.when(F.col("now").isNotNull() & named, (F.col("was") == F.col("now")).cast("int"))).alias("same_entities"), F.count_if(F.col("now").isNull()).alias("items_without_citation"))
    return per.withColumn("_k", F.lit(0)).join(steps.withColumn("_k", F.lit(0)), "_k").drop("_k")


def recite_same_answer(old: DataFrame, new: DataFrame, answers: DataFrame, least: float = 0.5) -> DataFrame:
    """``recite`` over the items whose answer under the mask is the plain one, and their share of the items asked.

    answers: (id, plain, masked). Elsewhere a moved citation may follow a changed answer.
    """
    asked = answers.join(dealt(old.select("id").distinct()), "id", "left_semi")
    same = asked.where(F.col("plain").eqNullSafe(F.col("masked"))).select("id")
    found = recite(old.join(dealt(same), "id", "left_semi"), new.join(dealt(same), "id", "left_semi"), least)
    share = asked.agg((F.count_if(F.col("plain").eqNullSafe(F.col("masked"))) / F.nullif(F.count("*"), F.lit(0))).alias("share_items"))
    return found.withColumn("_k", F.lit(0)).join(share.withColumn("_k", F.lit(0)), "_k").drop("_k")


def dose(steps: DataFrame, tracks: DataFrame) -> DataFrame:
    """(id, frames, cover): mean detected frames of the entities an item names, and the share of all their frames that it cites."""
    named = steps.where("entity is not null")
    wanted = named.select("id", "video", F.col("entity").alias("phrase")).distinct()
    found = wanted.join(dealt(tracks.select("video", "phrase", "frame")), ["video", "phrase"])
    n = found.groupBy("id", "phrase").agg(F.count_distinct("frame").alias("k"), F.collect_set("frame").alias("f"))
    per = n.groupBy("id").agg(F.avg("k").alias("frames"), F.array_distinct(F.flatten(F.collect_list("f"))).alias("all"))
    cited = named.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(G.frames_hit("t0", "t1")))).alias("cited"))
    return per.join(dealt(cited), "id").select("id", "frames", (F.size(F.array_intersect("cited", "all")) / F.size("all")).alias("cover"))


def buckets(value, cuts: list[tuple[str, float]]) -> Column:
    """The name of the first bucket whose upper end is above the value."""
    out = F.lit(None).cast("string")
    for name, end in reversed(cuts):
        out = F.when(F.col(value) < end, name).otherwise(out)
    return out


#: Buckets of detected frames and of cited shares, upper ends exclusive.
FRAME_BUCKETS = [("1-8", 8.5), ("9-13", 13.5), ("14-15", 15.5), ("16", 99.0)]
COVER_BUCKETS = [("<0.15", 0.15), ("0.15-0.3", 0.3), (">=0.3", 9.0)]


def entity_regions(steps: DataFrame, tracks: DataFrame) -> DataFrame:
    """(id, video, names, seen, regions): every detection, on any frame, of the entities an item names, and its own citations.

    Regions are distinct and sorted STRUCT<t0, t1, box>; items none of whose entities was detected are absent. ``names`` are
    the entities, ``seen`` the video's detections, so that what rates an item has all of it in its row.
    """
    points = F.array(*[F.lit(p) for p in G.grid()])
    at = F.get(points, F.col("frame"))
    span = F.struct(F.col("t0").cast("int").alias("t0"), F.col("t1").cast("int").alias("t1"), "box")
    own = steps.groupBy("id", "video").agg(F.array_distinct(F.collect_list("entity")).alias("names"), F.collect_list(span).alias("own")).where(F.size("names") > 0)
    found = tracks.groupBy("video").agg(F.sort_array(F.collect_list(F.struct(F.struct(at.alias("t0"), at.alias("t1"), "box").alias("r"), "phrase"))).alias("found"), F.collect_list(F.struct("phrase", "frame", "box")).alias("seen"))
    # an item meets its video's detections, which fit a row: its regions are made there and pass no shuffle
    both = _dealt_by_video(own, found)
    named = lambda x: F.array_contains("names", x["phrase"])
    # detections are sorted once for a video, an item's few citations fall into their order
    of = F.transform(F.filter("found", named), lambda x: x["r"])
    return both.where(F.exists("found", named)).select("id", "video", "names", "seen", _distinct(F.concat(of, "own")).alias("regions"))


#: Parts that the items of a video are dealt in; its detections go to each.
PARTS = 8


def _dealt_by_video(items: DataFrame, videos: DataFrame) -> DataFrame:
    """Items with the row of their video, a video's items in ``PARTS`` parts: a small row is a lot of work, so the number of tasks is stated."""
    spark = items.sparkSession
    wide = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["video", "_part"]
    left = items.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).repartition(wide, *keys)
    right = videos.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(wide, *keys)
    return left.join(dealt(right), keys).drop("_part")


def _distinct(values: Column) -> Column:
    """Sorted, each once."""
    return G.let(F.sort_array(values), lambda s: F.filter(s, lambda x, n: (n == 0) | ~x.eqNullSafe(F.get(s, n - 1))))


def avoiding_regions(items: DataFrame, tries: int = 30, seed: int = 0) -> DataFrame:
    """Adds ``controls``: for each region of an item one of its span and size, at the drawn place that overlaps least, ideally
    not at all, with every region of the item on the frames it hits; of equal ones the first drawn."""
    keyed = items.withColumn("_key", F.col("id").cast("string"))
    out = T_.StructType([*items.schema.fields, T_.StructField("controls", items.schema["regions"].dataType)])
    columns = out.names

    def run(batches):
        for b in S.sliced(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], S.avoiding(b.column("_key"), b.column("regions"), tries, seed)], names=columns)

    return keyed.mapInArrow(run, out).where(F.size("controls") > 0)


def entity_control_share(items: DataFrame, steps: DataFrame, tracks: DataFrame, cover: float = 0.3, largest: float = 0.4, same: float = 0.3) -> DataFrame:
    """(id, share): of the frames that an item's controls hit, the share on which one covers another entity.

    items: (id, video, regions, controls), names and seen if they are of ``entity_regions``, else they are looked up. Another
    entity is one the item does not name, whose box is smaller than ``largest`` and overlaps none of the item's regions on
    that frame; it is covered by ``cover`` of its area or more.
    """
    if "seen" not in items.columns:
        named = steps.where("entity is not null").groupBy("id").agg(F.collect_set("entity").alias("names"))
        items = _dealt_by_video(items.join(dealt(named), "id", "left"), tracks.groupBy("video").agg(F.collect_list(F.struct("phrase", "frame", "box")).alias("seen")))
    # all of an item is in its row: what its controls hit is counted there and passes no shuffle
    lists = ["names", "seen", "regions", "controls"]
    rows = items.select("id", *lists)

    def run(batches):
        for b in S.sliced(batches):
            spots, hits = S.shares(*[b.column(c) for c in lists], cover, largest, same)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spots, pa.int64()), pa.array(hits, pa.int64())], names=["id", "spots", "hits"])

    out = T_.StructType([items.schema["id"], *[T_.StructField(c, T_.LongType()) for c in ("spots", "hits")]])
    return rows.mapInArrow(run, out).where("spots > 0").select("id", (F.col("hits") / F.col("spots")).alias("share"))


def control_stratum(share) -> Column:
    """Where an item's controls fall, by ``entity_control_share``: from a half on, between, and up to a tenth."""
    s = F.col(share) if isinstance(share, str) else share
    return F.when(s >= 0.5, "on_other_entity").when(s > 0.1, "mixed").when(s <= 0.1, "on_background")


def full_credit_flips(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(n_questions, flip, flip_control): of the questions with full credit under plain and all items in both runs, the share that loses it."""
    said = F.when(F.col("correct") == 1, F.col("gold")).otherwise(F.when(F.col("gold") == "yes", "no").otherwise("yes"))

    def credit(c):
        here = F.col("condition") == c
        yes = F.count_if(here & (F.col("said") == "yes"))
        good = F.count_if(here & (F.col("said") == "yes") & (F.col("gold") == "yes"))
        n = F.count_if(here)
        return n.alias(f"n_{c}"), F.when(yes == 0, 1 / F.nullif(n, F.lit(0))).when(good > 0, 1 / yes).otherwise(0.0).alias(f"c_{c}")

    q = runs.where(F.col("condition").isin("plain", a, b)).withColumn("said", said).groupBy("qset").agg(*[x for c in ("plain", a, b) for x in credit(c)])
    full = q.where((F.col("n_plain") == F.col(f"n_{a}")) & (F.col("n_plain") == F.col(f"n_{b}")) & (F.col("c_plain") == 1))
    lost = lambda c: F.avg((F.col(f"c_{c}") < 1).cast("int"))
    return full.agg(F.count("*").alias("n_questions"), lost(a).alias("flip"), lost(b).alias("flip_control"))
