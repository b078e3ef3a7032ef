"""Paired flip rates, gaps and their clustered bootstrap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pramana.operators.resample import BLOCK, cluster_key, mixed, replicate_keys, weighted_sums
from pramana.sources.shared import shared_folder

PAIRS = {"es": ("mask_evidence", "mask_random"), "track": ("mask_track", "mask_track_random"), "cite": ("mask_cite", "mask_cite_random"), "cite_track": ("mask_cite_track", "mask_cite_track_random")}


#: Clusters whose sums may be sent to all tasks, 40 bytes each at most.
MOST_SENT = 1_000_000
#: Places of clusters that a task holds.
PLACES = 1 << 22


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key, by ``order``; a maximum of structs, which combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(df.columns)


def wide(runs: DataFrame, conditions: list[str], keep: list[str] = ("question_type", "qset", "gold", "video")) -> DataFrame:
    """One row for each item: ``keep`` from the plain run and a column of correctness for each condition, null where it has none."""
    plain = F.col("condition") == "plain"
    return runs.where(F.col("condition").isin(*conditions)).groupBy("id").agg(*[F.max(F.when(plain, F.col(k))).alias(k) for k in keep], *[F.max(F.when(F.col("condition") == c, F.col("correct"))).alias(c) for c in conditions])


def flip_rate(run, plain="plain", among: Column | None = None) -> Column:
    """Share of the items right under plain that ``run`` gets wrong; null without any."""
    base = (F.col(plain) == 1) if among is None else (F.col(plain) == 1) & among
    return F.count_if(base & (F.col(run) == 0)) / F.nullif(F.count_if(base), F.lit(0))


def by_type(df: DataFrame, aggregates: list[Column], key: str = "question_type", total: str = "ALL") -> DataFrame:
    """Aggregates for every type and over all rows, in one pass of grouping sets."""
    return df.groupingSets([[key], []], key).agg(*aggregates, F.grouping(key).alias("_g")).withColumn(key, F.when(F.col("_g") == 1, total).otherwise(F.col(key))).drop("_g")


def paired_report(runs: DataFrame) -> DataFrame:
    """Per type and over all: accuracies, blind gap, flip rates and gaps of every pair of conditions.

    Main figures are over items in all of plain, blind, evidence and random; each further pair is over
    those of them that it covers.
    """
    main = ["plain", "blind", "mask_evidence", "mask_random"]
    w = wide(runs, [*main, *PAIRS["track"], *PAIRS["cite"], *PAIRS["cite_track"]])
    w = w.where(" and ".join(f"{c} is not null" for c in main))
    out = [F.count("*").alias("n"), F.avg("plain").alias("acc_plain"), F.avg("blind").alias("acc_blind"), F.avg(F.col("plain") - F.col("blind")).alias("blind_gap")]
    for name, (a, b) in PAIRS.items():
        among = F.col(a).isNotNull() & F.col(b).isNotNull()
        out += [F.count_if(among).alias(f"n_{name}"), flip_rate(a, among=among).alias(f"flip_{a[5:]}"), flip_rate(b, among=among).alias(f"flip_{b[5:]}"), (flip_rate(a, among=among) - flip_rate(b, among=among)).alias(f"{name}_gap")]
    return by_type(w, out)


def gap(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """n_correct, flip, flip_control and gap of two conditions of a wide table, by stratum; strata without right items are left out."""
    d = df.where((F.col("plain") == 1) & F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = F.avg(1 - F.col(a)), F.avg(1 - F.col(b))
    return d.groupBy(*by).agg(F.count("*").alias("n_correct"), x.alias("flip"), y.alias("flip_control"), (x - y).alias("gap"))


def sums_by_cluster(df: DataFrame, a: str, b: str, cluster: str = "qset") -> DataFrame:
    """What a ratio over resampled clusters needs: right items and flips of either condition."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    right = both & (F.col("plain") == 1)
    return df.where(both).groupBy(F.col(cluster).alias("cluster")).agg(F.count_if(right).alias("n"), F.count_if(right & (F.col(a) == 0)).alias("fa"), F.count_if(right & (F.col(b) == 0)).alias("fb"))


_SAMPLE = "rep long, n long, sx long, sy long"


def resampled(sums: DataFrame, replicates: int, seed: int = 0, method: str = "poisson") -> DataFrame:
    """(stratum, rep, n, sx, sy): sums over the clusters of a stratum, drawn anew for each replicate. sums: (stratum, cluster, n, sx, sy).

    ``poisson``, at any size: every cluster gets a Poisson weight for each replicate by a hash of its key; a task sends one
    row for each stratum and replicate. ``draws``, for up to MOST_SENT clusters and an error beyond: as many draws with
    replacement as there are clusters, the place of each by a hash of replicate and position, which all strata share; the
    clusters' sums are sent to all tasks, each of which makes some replicates.
    """
    spark = sums.sparkSession
    kind = dict(sums.dtypes)["stratum"]
    names = ["stratum", "rep", "n", "sx", "sy"]
    reps = replicate_keys(replicates, seed)
    cores = spark.sparkContext.defaultParallelism
    if method == "draws":
        if (size := sums.count()) > MOST_SENT:
            raise ValueError(f"draws with replacement are for {MOST_SENT} clusters at most, not {size}: take method='poisson'")
        table = sums.select("stratum", "cluster", "n", "sx", "sy").orderBy("stratum", "cluster").toArrow()
        values = np.column_stack([table[c].to_numpy() for c in names[2:]]).astype(np.int64).reshape(-1, 3)
        code = table["stratum"].combine_chunks().dictionary_encode()
        first = np.flatnonzero(np.diff(code.indices.to_numpy(), prepend=-1)) if size else np.zeros(0, np.int64)
        shared = spark.sparkContext.broadcast((code.dictionary.to_pylist(), np.split(values, first[1:])))

        def draw(batches):
            strata, held = shared.value
            most = max(map(len, held), default=0)
            for b in batches:
                for rep in b.column(0).to_pylist() if strata else ():
                    drawn = mixed(np.arange(most, dtype=np.uint64), reps[rep : rep + 1])[:, 0]
                    found = np.array([v[drawn[: len(v)] % np.uint64(len(v))].sum(axis=0) for v in held])
                    yield pa.RecordBatch.from_arrays([pa.array(strata, _ARROW[kind]), pa.array([rep] * len(strata)), *(pa.array(found[:, k]) for k in range(3))], names=names)

        parts = max(1, min(replicates, cores))
        return spark.range(0, replicates, 1, parts).mapInArrow(draw, f"stratum {kind}, {_SAMPLE}")

    def weigh(batches):
        total: dict = {}
        for b in batches:
            code = b.column("stratum").dictionary_encode()
            at, key = code.indices.to_numpy(zero_copy_only=False), b.column("key").to_numpy()
            values = np.column_stack([b.column(c).to_numpy() for c in names[2:]]).reshape(-1, 3)
            for k, stratum in enumerate(code.dictionary.to_pylist()):
                part = weighted_sums(key[at == k], values[at == k], reps)
                total[stratum] = total[stratum] + part if stratum in total else part
        for stratum, held in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([stratum] * replicates, _ARROW[kind]), pa.array(np.arange(replicates)), *(pa.array(held[:, k]) for k in range(3))], names=names)

    # a cluster is a small row and a lot of work: a stated number of parts, so that they are not put together by size
    known = sums.where("stratum is not null").select("stratum", cluster_key("cluster", seed).alias("key"), "n", "sx", "sy")
    dealt = known.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), "stratum", "key")
    parts = dealt.mapInArrow(weigh, f"stratum {kind}, {_SAMPLE}")
    return parts.groupBy("stratum", "rep").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy")])


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}


def drawn_by_place(sums: DataFrame, replicates: int, seed: int = 0, within: int = PLACES) -> DataFrame:
    """(rep, n, sx, sy): the draws of ``resampled`` over one stratum (cluster, n, sx, sy), at any number of clusters.

    Clusters are numbered by their key and dealt in blocks of ``within`` places; a task makes some replicates' draws and adds up
    those that fall into its block, so that neither the driver nor a task holds all clusters.
    """
    spark = sums.sparkSession
    known = numbered(sums.select("cluster", "n", "sx", "sy"), "cluster")
    size = sums.count()
    chunks = max(1, min(replicates, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    reps = replicate_keys(replicates, seed)

    def draw(t: pa.Table) -> pa.Table:
        block, chunk = (t[c][0].as_py() for c in ("_block", "_chunk"))
        base = block * within
        values = np.zeros((min(within, size - base), 3), np.int64)
        values[t["place"].to_numpy() - base] = np.column_stack([t[c].to_numpy() for c in ("n", "sx", "sy")])
        mine = np.arange(chunk, replicates, chunks)
        found = np.zeros((len(mine), 3), np.int64)
        for k, rep in enumerate(mine):
            for at in range(0, size, BLOCK):
                place = mixed(np.arange(at, min(size, at + BLOCK), dtype=np.uint64), reps[rep : rep + 1])[:, 0] % np.uint64(size)
                times = place[(place >= base) & (place < base + len(values))].astype(np.int64) - base
                found[k] += values[times].sum(axis=0)
        return pa.table({"rep": mine, **{c: found[:, i] for i, c in enumerate(("n", "sx", "sy"))}})

    rows = known.select(F.floor(F.col("place") / within).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"), "place", "n", "sx", "sy")
    return rows.groupBy("_block", "_chunk").applyInArrow(draw, "rep long, n long, sx long, sy long").groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy")])


def bootstrap(sums: DataFrame, replicates: int = 2000, seed: int = 0, method: str = "poisson") -> DataFrame:
    """(rep, gap) of resampled clusters (cluster, n, fa, fb); replicates without a right item are dropped.

    Methods as in ``resampled``, and ``places``: the same as ``draws`` at any number of clusters.
    """
    one = sums.select(F.lit("all").alias("stratum"), "cluster", "n", F.col("fa").alias("sx"), F.col("fb").alias("sy"))
    made = drawn_by_place(one.drop("stratum"), replicates, seed) if method == "places" else resampled(one, replicates, seed, method)
    return made.where("n > 0").select("rep", (F.col("sx") / F.col("n") - F.col("sy") / F.col("n")).alias("gap"))


def interval(reps: DataFrame, value: str = "gap", level: float = 0.95) -> DataFrame:
    """Percentiles by place in the sorted values, without interpolation; NaN without values."""
    tail = (1 - level) / 2
    v = reps.agg(F.array_sort(F.collect_list(value)).alias("v"))
    n = F.size("v")
    lo = F.get("v", F.floor(F.lit(tail) * n).cast("int"))
    hi = F.get("v", F.least(n - 1, F.floor(F.lit(1 - tail) * n).cast("int")))
    nan = F.lit(float("nan"))
    return v.select(F.coalesce(lo, nan).alias("lo"), F.coalesce(hi, nan).alias("hi"), n.alias("n_reps"))


def numbered(df: DataFrame, order: str, name: str = "place", within: int = 200_000) -> DataFrame:
    """Adds the place of each row by ``order``, from 0, without a sort of all rows in one task.

    Rows are dealt by ranges of ``order`` into parts of about ``within`` rows and written with their part and their place in it;
    what comes before a part is a sum over the parts' counts, one small row each. Nulls come first. Rows of equal
    value are numbered in any order, once for all.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // within))
    path = shared_folder(spark, "numbered")
    ranged = df.repartitionByRange(parts, F.col(order).asc_nulls_first()).sortWithinPartitions(F.col(order).asc_nulls_first())
    # the low 33 bits of the id of a sorted part's row are its place there
    ranged.withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    kept = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_id", T.LongType())])).parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    past = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_past"))
    return kept.join(past, "_part").withColumn(name, F.col("_past") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_id", "_past")


def upper_median_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median): the middle of the sorted values, the upper of two, from counts of each value and their running sum."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return n.select(*by, value, upto.alias("_u"), F.sum("_n").over(w).alias("_all")).where(F.col("_u") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(value).alias("median"))


def upper_median(value) -> Column:
    """The middle of the sorted values, the upper of two."""
    v = F.array_sort(F.collect_list(value))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def question_selection(runs: DataFrame, condition: str) -> DataFrame:
    """Credit of each question by its options said to be right: 1 / n with none, 1 / chosen if the right one is among them, else 0."""
    said = F.when(F.col("correct") == 1, F.col("gold")).otherwise(F.when(F.col("gold") == "yes", "no").otherwise("yes"))
    q = runs.where(F.col("condition") == condition).withColumn("said", said).groupBy("qset").agg(F.count("*").alias("n"), F.count_if(F.col("said") == "yes").alias("chosen"), F.count_if((F.col("said") == "yes") & (F.col("gold") == "yes")).alias("hit"))
    return q.select("qset", F.when(F.col("chosen") == 0, 1 / F.col("n")).when(F.col("hit") > 0, 1 / F.col("chosen")).otherwise(F.lit(0.0)).alias("credit"))
