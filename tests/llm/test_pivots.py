import numpy as np
import pytest

from pramana.llm import pivots

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows):
    """{(id, vector): (links, component)} by all pairs."""
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        v = v / np.abs(v).max()
        return v / np.sqrt((v * v).sum())

    units = [unit(v) for _, v in rows]
    width = max([len(u) for u in units if u is not None], default=1)
    x = np.array([np.zeros(width) if u is None else np.pad(u, (0, width - len(u))) for u in units]).reshape(-1, width)
    close = x @ x.T >= pivots.COSINE
    np.fill_diagonal(close, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(close)):
        root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return sorted(((name, int(close[i].sum()), least.get(find(i))) for i, (name, _) in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in pivots.near_vectors(df).select("id", "n_links", "component").collect()), key=str)


def clusters(n, dims, seed, sizes, noise):
    rng = np.random.default_rng(seed)
    x = list(rng.normal(size=(n, dims)))
    for size, far in zip(sizes, noise):
        c = rng.normal(size=dims)
        x += [c + far * rng.normal(size=dims) * np.linalg.norm(c) / np.sqrt(dims) for _ in range(size)]
    order = rng.permutation(len(x))
    return [(int(k), [float(v) for v in x[i]]) for k, i in enumerate(order)]


def recall(rows, got):
    want = plain(rows)
    links, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))
    return links / all_ if all_ else 1.0


def test_recall_and_no_false_links(spark):
    rows = clusters(900, 32, 1, [2] * 150 + [15] * 10, [0.2] * 150 + [0.18] * 10)
    got = found(spark.createDataFrame(rows, SCHEMA))
    assert len(got) == len(rows) and recall(rows, got) >= 0.95


@pytest.mark.parametrize("crowd", [16, 60])
def test_crowded_lists_in_tiles_with_cores(spark, monkeypatch, crowd):
    rows = clusters(200, 16, 2, [150, 120, 20], [0.08, 0.25, 0.15])
    rows += [(10_000 + k, rows[k % 7][1]) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = found(df)
    monkeypatch.setattr(pivots, "CROWD", crowd)
    assert found(df) == whole and recall(rows, whole) >= 0.97


def test_all_share_a_list_when_there_are_few(spark):
    rows = clusters(3, 8, 3, [3], [0.1])
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, []), (6, None), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [0.0, 5.0]), (None, None), (None, [-1.0, 0.0]), (10, [1e300, 1e299]), (11, [1e-310, 0.0]), (12, [-0.0, 3.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as node", "3 as v", "'x' as label", "0 as key")
    assert found(df) == plain(rows)


def test_empty_and_single(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(5, [1.0])], SCHEMA)) == [(5, 0, 5)]


def test_query_on_the_table(spark, sf_dir):
    got = pivots.op13_pivots(spark, sf_dir)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == sorted(plain(rows))
