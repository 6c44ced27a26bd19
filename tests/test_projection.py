import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import projection
from tabulon.operators.projection import affinities, conditional, fuzzy_union, neighbours, plot_points, tsne, tsne_forces, umap


def table(spark, n=120, classes=4, width=6):
    draw = np.random.default_rng(3)
    rows = [(i, f"c{i % classes}", (draw.normal(size=width) + 8 * np.eye(width)[i % classes]).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k long, c string, v array<double>")


def test_calibrated_rows_have_the_perplexity():
    squares = np.random.default_rng(0).gamma(2.0, size=(20, 60)) * np.logspace(-3, 3, 20)[:, None]
    p = conditional(squares, 12.0)
    assert np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)) == pytest.approx(np.full(20, 12.0), rel=1e-6)


def test_affinities_equal_brute_force(spark):
    rows, df = table(spark, 40)
    points = plot_points(df, "k", "c", "v")
    x = projection._matrix(points)
    assert np.allclose(x, [r[2] for r in rows])
    got = affinities(points, x, 5.0).collect()
    squares = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(squares, np.inf)
    near = np.argsort(squares, axis=1)[:, :15]
    p = np.zeros((40, 40))
    for i in range(40):
        p[i, near[i]] = conditional(squares[i : i + 1, near[i]], 5.0)[0]
    p = (p + p.T) / 80
    assert sum(r["p"] for r in got) == pytest.approx(1)
    assert {(r["i"], r["j"]) for r in got} == set(zip(*np.nonzero(p), strict=True))
    assert all(r["p"] == pytest.approx(p[r["i"], r["j"]]) for r in got)


def test_forces_are_the_gradient(spark):
    """Against differences of the Kullback-Leibler divergence itself."""
    _, df = table(spark, 24)
    points = plot_points(df, "k", "c", "v")
    edges = affinities(points, projection._matrix(points), 4.0).repartitionByRange(3, "i").cache()
    p = np.zeros((24, 24))
    for r in edges.collect():
        p[r["i"], r["j"]] = r["p"]
    y = np.random.default_rng(1).normal(size=(24, 2))

    def divergence(y):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
        np.fill_diagonal(q, 0)
        q = q / q.sum()
        some = p > 0
        return (p[some] * np.log(p[some] / q[some])).sum()

    pull, push, total = tsne_forces(edges, y)
    gradient = 4 * (pull - push / total)
    for i in (0, 7, 23):
        for c in (0, 1):
            step = np.zeros_like(y)
            step[i, c] = 1e-5
            assert gradient[i, c] == pytest.approx((divergence(y + step) - divergence(y - step)) / 2e-5, abs=1e-7)


def apart(rows, layout):
    """Mean distance to the own class's middle, against that of the middles."""
    at = {r["k"]: np.array([r["x"], r["y"]]) for r in layout}
    names = sorted({c for _, c, _ in rows})
    middles = {c: np.mean([at[k] for k, x, _ in rows if x == c], axis=0) for c in names}
    inside = np.mean([np.linalg.norm(at[k] - middles[c]) for k, c, _ in rows])
    between = np.mean([np.linalg.norm(middles[a] - middles[b]) for a in names for b in names if a < b])
    return between / inside


def test_layouts_keep_classes_apart(spark):
    rows, df = table(spark)
    assert apart(rows, tsne(df, "k", "c", "v", perplexity=10, rounds=90).collect()) > 2
    assert apart(rows, umap(df, "k", "c", "v", k=10, rounds=60).collect()) > 2


@pytest.mark.parametrize("layout", [tsne, umap])
def test_small_and_odd_tables(spark, layout):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "a", [1.0, 2.0]), (3, None, [0.0, 1.0]), (4, "b", None), (None, "b", [0.0, 0.0]), (3, "a", [5.0, 5.0])], "k long, c string, v array<float>")
    got = layout(df, "k", "c", "v", rounds=3).collect()
    assert sorted(r["k"] for r in got) == [1, 2, 3, 3] and all(math.isfinite(r["x"]) and math.isfinite(r["y"]) for r in got)
    assert layout(df.limit(0), "k", "c", "v", rounds=3).count() == 0
    assert layout(df.filter("k = 1"), "k", "c", "v", rounds=3).count() == 1
    with pytest.raises(ValueError):
        layout(df.unionByName(spark.createDataFrame([(9, "a", [1.0])], df.schema)), "k", "c", "v", rounds=3).collect()


def test_the_plot_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(projection, "MOST_POINTS", 50)
    rows, df = table(spark, 400)
    points = plot_points(df.withColumn("c", F.when(F.col("k") == 5, "rare").otherwise(F.col("c"))), "k", "c", "v")
    assert 40 <= points.count() <= 55 and points.filter("k = 5").count() == 1
    with pytest.raises(ValueError):
        plot_points(df.withColumn("c", F.col("k").cast("string")), "k", "c", "v")


def test_neighbours_are_found(spark):
    draw = np.random.default_rng(11)
    x = draw.normal(size=(700, 12))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, v array<double>")
    found = neighbours(points, 10).collect()
    squares = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(squares, np.inf)
    true = {(i, int(j)) for i, row in enumerate(np.argsort(squares, axis=1)[:, :10]) for j in row}
    got = {(r["a"], r["b"]) for r in found}
    assert len(got) == len(found) == 7000 and len(got & true) / 7000 >= 0.9
    assert all(r["d"] == pytest.approx(math.sqrt(squares[r["a"], r["b"]])) for r in found)
    # Weights: the nearest neighbour's is 1 either way, all lie in (0, 1], and both directions agree.
    edges = {(r["i"], r["j"]): r["w"] for r in fuzzy_union(spark.createDataFrame(found), 10).collect()}
    assert all(0 < w <= 1 + 1e-9 and edges[j, i] == pytest.approx(w) for (i, j), w in edges.items())
    first = {}
    for r in found:
        first[r["a"]] = min(first.get(r["a"], (math.inf, 0)), (r["d"], r["b"]))
    assert all(edges[a, b] == pytest.approx(1) for a, (_, b) in first.items())
