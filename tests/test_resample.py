"""Weights, resampled sums and order statistics against plain loops."""

import math

import numpy as np
import pytest

from pramana.operators import resample, stats

REPS = 40


def plain_weights(cluster, seed=0):
    """Weights of one cluster in each replicate, number by number."""
    import hashlib

    sixty = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    out = []
    for rep in range(REPS):
        t = (sixty(f"{seed}:{cluster}") ^ sixty(f"{seed}:rep:{rep}")) * resample.MIX_1 % 2**64
        t = (t ^ (t >> 32)) * resample.MIX_2 % 2**64
        u = ((t ^ (t >> 32)) >> 11) / 2**53
        out.append(sum(u >= c for c in resample.poisson_cuts()))
    return out


def items(n, seed, clusters=30, values=None):
    rng = np.random.default_rng(seed)
    pick = (lambda: float(rng.choice(values))) if values else (lambda: float(np.round(rng.normal(), 3)))
    return [(f"s{rng.integers(3)}", int(rng.integers(clusters)), pick(), int(rng.integers(2))) for _ in range(n)]


def expanded(rows, stratum, rep, label=None):
    """The values of a replicate in order, each as often as its cluster weighs."""
    out = []
    for s, c, v, y in rows:
        if s == stratum and (label is None or y == label):
            out += [v] * W[c][rep]
    return sorted(out)


W = {c: plain_weights(c) for c in range(30)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "stratum string, cluster int, v double, label int").repartition(3)


def got(df):
    return {(r.stratum, r.rep): r.value for r in df.collect()}


@pytest.mark.parametrize("values, run, block", [(None, 10**6, 1 << 20), (None, 37, 160), ([1.0, 1.0, 2.0, 5.0], 11, 40)])
def test_order_statistics_equal_plain_ones(spark, monkeypatch, values, run, block):
    """Many short runs, blocks of a few items, and values that all items share."""
    monkeypatch.setattr(resample, "RUN", run)
    monkeypatch.setattr(resample, "BLOCK", block)
    rows = items(300, run, values=values)
    df = frame(spark, rows + [(None, 1, 1.0, 1), ("s0", None, 1.0, 1), ("s0", 1, None, 1), ("s0", 1, float("nan"), 1)])
    pairs = [(s, r) for s in ("s0", "s1", "s2") for r in range(REPS)]
    median = got(resample.quantiles(df.drop("label"), "v", 0.5, REPS))
    trimmed = got(resample.trimmed_means(df.drop("label"), "v", 0.2, REPS))
    auc = got(resample.aucs(df, "v", REPS))
    for s, r in pairs:
        x = expanded(rows, s, r)
        assert median[s, r] == x[math.ceil(len(x) / 2) - 1]
        low, high = 0.2 * len(x), 0.8 * len(x)
        held = [max(0.0, min(k + 1, high) - max(k, low)) for k in range(len(x))]
        assert trimmed[s, r] == pytest.approx(np.dot(x, held) / sum(held))
        ones, zeros = np.array(expanded(rows, s, r, 1)), np.array(expanded(rows, s, r, 0))
        wins = (ones[:, None] > zeros).sum() + 0.5 * (ones[:, None] == zeros).sum()
        assert auc[s, r] == pytest.approx(wins / (len(ones) * len(zeros)))
    assert set(median) == set(pairs)


def test_intervals_and_empty_replicates(spark):
    one = frame(spark, [("a", 3, 1.5, 1)])
    r = resample.intervals(resample.quantiles(one, "v", 0.5, REPS)).first()
    assert (r.lo, r.hi, r.n_reps) == (1.5, 1.5, sum(w > 0 for w in W[3]))
    assert resample.intervals(resample.aucs(one, "v", REPS)).count() == 0
    assert resample.intervals(resample.quantiles(one.limit(0), "v", 0.5, REPS)).count() == 0


def test_resampled_sums_equal_plain_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{k % 3}", c, *map(int, rng.integers(0, 50, 3))) for k, c in enumerate(range(30))] + [("s0", 1, 1, 2, 3)]
    df = spark.createDataFrame(rows, "stratum string, cluster int, n long, sx long, sy long").repartition(4)
    found = {(r.stratum, r.rep): (r.n, r.sx, r.sy) for r in stats.resampled(df, REPS).collect()}
    for (s, rep), value in found.items():
        assert value == tuple(sum(W[r[1]][rep] * r[k] for r in rows if r[0] == s) for k in (2, 3, 4))
    assert len(found) == 3 * REPS


def test_draws_are_refused_beyond_their_bound(spark, monkeypatch):
    df = spark.createDataFrame([("s", c, 1, 1, 0) for c in range(5)], "stratum string, cluster int, n long, sx long, sy long")
    assert {(r.n, r.sx) for r in stats.resampled(df, REPS, method="draws").collect()} == {(5, 5)}
    monkeypatch.setattr(stats, "MOST_SENT", 4)
    with pytest.raises(ValueError, match="poisson"):
        stats.resampled(df, REPS, method="draws")
    assert stats.resampled(df, REPS).count() == REPS
    assert stats.resampled(df.limit(0), REPS).count() == 0


def test_weights_have_the_moments_of_a_poisson_number():
    w = resample.weights(np.random.default_rng(1).integers(0, 2**60, 4000).astype(np.uint64), resample.replicate_keys(200)).astype(float)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and w.sum(axis=0).std() == pytest.approx(4000**0.5, rel=0.2)


def test_numbered_rows_keep_their_order_at_any_cut(spark):
    rows = [(k % 50 if k % 11 else None, k) for k in range(500)]
    for within in (7, 10_000):
        out = stats.numbered(spark.createDataFrame(rows, "v int, k int").repartition(5), "v", within=within).collect()
        assert sorted(r.place for r in out) == list(range(500)) and {r.k for r in out} == set(range(500))
        values = [-1 if r.v is None else r.v for r in sorted(out, key=lambda r: r.place)]
        assert values == sorted(values)
