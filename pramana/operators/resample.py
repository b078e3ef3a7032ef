"""Bootstrap weights by hash, and intervals of order statistics from sorted runs of items.

A cluster's weight in a replicate is a Poisson number with mean one that follows from the cluster's key, the replicate
and a seed alone, so every partitioning and every size gives the same. Weights are made for whole blocks of clusters and
replicates at a time.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pramana.sources.shared import shared_folder

MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Numbers in a block of weights.
BLOCK = 1 << 20
#: Items in a sorted run, about.
RUN = 200_000


def poisson_cuts() -> list[float]:
    """Up to which draw in [0, 1) a Poisson number with mean one is 0, 1, 2 and so on."""
    p, acc, out = 0.36787944117144233, 0.0, []
    for k in range(1, 12):
        acc += p
        p /= k
        out.append(acc)
    return out


_CUTS = [np.uint64(math.ceil(c * 2**53)) for c in poisson_cuts()]


def cluster_key(cluster, seed: int = 0) -> Column:
    """60 bits that stand for a cluster."""
    c = F.col(cluster) if isinstance(cluster, str) else cluster
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string"))), 1, 15), 16, 10).cast("long")


def replicate_keys(replicates: int, seed: int = 0) -> np.ndarray:
    return np.array([int(hashlib.md5(f"{seed}:rep:{r}".encode()).hexdigest()[:15], 16) for r in range(replicates)], np.uint64)


def mixed(keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """53 random bits for each key (down) and replicate (across)."""
    t = np.bitwise_xor.outer(keys.astype(np.uint64), reps)
    with np.errstate(over="ignore"):
        t *= np.uint64(MIX_1)
        t ^= t >> np.uint64(32)
        t *= np.uint64(MIX_2)
    t ^= t >> np.uint64(32)
    t >>= np.uint64(11)
    return t


def weights(keys: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Poisson weights of clusters (down) in replicates (across)."""
    t = mixed(keys, reps)
    w = (t >= _CUTS[0]).astype(np.int8)
    for c in _CUTS[1:]:
        more = t >= c
        if not more.any():
            break
        w += more
    return w


def weighted_sums(keys: np.ndarray, values: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """For each replicate the sums of each column of ``values``, whole numbers, over clusters by weight."""
    out = np.zeros((len(reps), values.shape[1]), np.int64)
    step = max(1, BLOCK // max(1, len(reps)))
    for at in range(0, len(keys), step):
        w = weights(keys[at : at + step], reps).astype(np.float64)
        out += np.rint(w.T @ values[at : at + step].astype(np.float64)).astype(np.int64)
    return out


# ---- statistics of values in order


def _runs(items: DataFrame, value: str, seed: int) -> DataFrame:
    """Items (stratum, cluster, value, label) in runs sorted by stratum and value, each with its number, written once.

    Equal values of a stratum are in one run, as one row for each cluster and label.
    """
    spark = items.sparkSession
    named = items.where(F.col("stratum").isNotNull() & F.col("cluster").isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    label = F.col("label").cast("int") if "label" in items.columns else F.lit(1)
    rows = named.select("stratum", F.col(value).cast("double").alias("v"), cluster_key("cluster", seed).alias("key"), label.alias("label")).where("label is not null").groupBy("stratum", "v", "key", "label").agg(F.count("*").alias("n"))
    path = shared_folder(spark, "runs")
    parts = max(1, -(-items.count() // RUN))
    rows.repartitionByRange(parts, "stratum", "v").sortWithinPartitions("stratum", "v").withColumn("run", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def _by_value(t: pa.Table, reps: np.ndarray):
    """For blocks of a sorted run: values, each once, and the weight of their items of label 0 and 1 in each replicate."""
    v, key, label, n = (t[c].to_numpy() for c in ("v", "key", "label", "n"))
    order = np.lexsort((key, label, v))
    v, key, label, n = v[order], key[order], label[order], n[order]
    starts = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    step = max(1, BLOCK // max(1, len(reps)))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + step, "right")) - 1)
        end = starts[to] if to < len(starts) else len(v)
        if end - starts[at] > step:  # one value of many clusters
            held = np.zeros((2, 1, len(reps)), np.int64)
            for a in range(starts[at], end, step):
                z = min(end, a + step)
                w = weights(key[a:z], reps) * n[a:z, None]
                for k in (0, 1):
                    held[k, 0] += w[label[a:z] == k].sum(axis=0)
            yield v[starts[at : at + 1]], held
        else:
            rows = slice(starts[at], end)
            w = weights(key[rows], reps) * n[rows, None]
            firsts = starts[at:to] - starts[at]
            yield v[starts[at:to]], np.array([np.add.reduceat(w * (label[rows] == k)[:, None], firsts, axis=0) for k in (0, 1)])
        at = to


def _passes(items: DataFrame, value: str, replicates: int, seed: int, partial, wide: int, finish) -> DataFrame:
    """(stratum, rep, value) from two passes over sorted runs.

    First each run gives the weight of its items in each replicate; what comes before a run is the sum of those of the
    runs before it. Then ``partial`` gives ``wide`` numbers for each replicate of a run, which are added up over runs.
    """
    runs = _runs(items, value, seed)
    reps = replicate_keys(replicates, seed)
    kind = dict(runs.dtypes)["stratum"]

    def totals(key, t):
        held = sum((w.sum(axis=1) for _, w in _by_value(t, reps)), np.zeros((2, len(reps)), np.int64))
        return pa.table({"stratum": pa.array([key[0].as_py()], t.schema.field("stratum").type), "run": pa.array([key[1].as_py()], pa.int32()), "w": pa.array([held.tobytes()], pa.binary())})

    def before(key, t):
        # a row for each run of a stratum: two long integers for each replicate
        order = np.argsort(t["run"].to_numpy())
        w = np.array([np.frombuffer(x.as_py(), np.int64) for x in t["w"]])[order]
        past = np.cumsum(w, axis=0) - w
        whole = w.sum(axis=0).tobytes()
        return pa.table({"stratum": t["stratum"].take(pa.array(order)), "run": t["run"].take(pa.array(order)), "past": pa.array([p.tobytes() for p in past], pa.binary()), "whole": pa.array([whole] * len(w), pa.binary())})

    def second(key, t, known):
        past, whole = (np.frombuffer(known[c][0].as_py(), np.int64).reshape(2, -1) for c in ("past", "whole"))
        out = np.zeros((len(reps), wide))
        past = past.copy()
        for v, w in _by_value(t, reps):
            out += partial(v, w, past, whole)
            past += w.sum(axis=1)
        done = {"stratum": pa.array([key[0].as_py()] * len(reps), t.schema.field("stratum").type), "rep": pa.array(np.arange(len(reps)), pa.int64())}
        columns = {f"s{k}": pa.array(out[:, k]) for k in range(wide)} | {f"w{k}": pa.array(whole[k]) for k in (0, 1)}
        return pa.table(done | columns)

    first = runs.groupBy("stratum", "run").applyInArrow(totals, f"stratum {kind}, run int, w binary")
    past = first.groupBy("stratum").applyInArrow(before, f"stratum {kind}, run int, past binary, whole binary")
    sums = ", ".join(f"s{k} double" for k in range(wide))
    parts = runs.groupBy("stratum", "run").cogroup(past.groupBy("stratum", "run")).applyInArrow(second, f"stratum {kind}, rep long, {sums}, w0 long, w1 long")
    added = parts.groupBy("stratum", "rep").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(wide)], *[F.min(f"w{k}").alias(f"w{k}") for k in (0, 1)])
    return added.select("stratum", "rep", finish.alias("value")).where("value is not null")


def quantiles(items: DataFrame, value: str, share: float = 0.5, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(stratum, rep, value): in each replicate the smallest value up to which at least ``share`` of the weight lies.

    items: (stratum, cluster, value), nulls and NaN left out. Replicates in which no item has weight are left out too.
    """

    def partial(v, w, past, whole):
        upto = past[1] + np.cumsum(w[1], axis=0)
        from_ = upto - w[1]
        goal = share * whole[1]
        met = (upto >= goal) & (from_ < goal) & (w[1] > 0)
        return np.column_stack([(v[:, None] * met).sum(axis=0), met.sum(axis=0)])

    return _passes(items, value, replicates, seed, partial, 2, F.when(F.col("w1") > 0, F.col("s0") / F.nullif(F.col("s1"), F.lit(0.0))))


def trimmed_means(items: DataFrame, value: str, cut: float = 0.1, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(stratum, rep, value): in each replicate the mean of what is left when ``cut`` of the weight goes at either end."""

    def partial(v, w, past, whole):
        upto = past[1] + np.cumsum(w[1], axis=0)
        low, high = cut * whole[1], (1 - cut) * whole[1]
        held = np.clip(np.minimum(upto, high) - np.maximum(upto - w[1], low), 0, None)
        return np.column_stack([(v[:, None] * held).sum(axis=0), held.sum(axis=0)])

    return _passes(items, value, replicates, seed, partial, 2, F.when(F.col("s1") > 0, F.col("s0") / F.col("s1")))


def aucs(items: DataFrame, value: str, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """(stratum, rep, value): in each replicate the chance that an item of label 1 has a larger value than one of label 0, ties half.

    items: (stratum, cluster, value, label). Replicates without weight on either label are left out.
    """

    def partial(v, w, past, whole):
        below = past[0] + np.cumsum(w[0], axis=0) - w[0]
        return (w[1] * (below + 0.5 * w[0])).sum(axis=0)[:, None].astype(float)

    pairs = F.col("w0").cast("double") * F.col("w1")
    return _passes(items, value, replicates, seed, partial, 1, F.when(pairs > 0, F.col("s0") / pairs))


def intervals(reps: DataFrame, level: float = 0.95) -> DataFrame:
    """(stratum, lo, hi, n_reps): percentiles by place among a stratum's replicates, of which there are as many as were drawn at most."""
    tail = (1 - level) / 2
    v = reps.groupBy("stratum").agg(F.array_sort(F.collect_list("value")).alias("v")).withColumn("n", F.size("v"))
    place = lambda s: F.get("v", F.least(F.col("n") - 1, F.floor(F.lit(s) * F.col("n")).cast("int")))
    return v.select("stratum", place(tail).alias("lo"), place(1 - tail).alias("hi"), F.col("n").alias("n_reps"))
