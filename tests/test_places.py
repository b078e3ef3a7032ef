"""Draws with replacement over more clusters than may be sent to all tasks."""

from pramana.operators import stats


def test_draws_by_place_are_the_draws(spark, monkeypatch):
    df = spark.createDataFrame([(7 * k, 1 + k % 3, k % 2, k % 5) for k in range(50)], "cluster long, n long, fa long, fb long")
    want = {r.rep: r.gap for r in stats.bootstrap(df, 40, method="draws").collect()}
    monkeypatch.setattr(stats, "MOST_SENT", 4)
    assert {r.rep: r.gap for r in stats.bootstrap(df, 40, method="places").collect()} == want


def test_blocks_of_places_add_up(spark):
    df = spark.createDataFrame([(k, 1, k % 2, 1 - k % 2) for k in range(30)], "cluster long, n long, sx long, sy long")
    rows = lambda within: sorted(map(tuple, stats.drawn_by_place(df, 20, within=within).collect()))
    assert rows(7) == rows(100)
    assert all(n == 30 for _, n, _, _ in rows(7))
