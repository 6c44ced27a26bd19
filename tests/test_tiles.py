import numpy as np
import pyarrow as pa
import pytest

from tabulon.operators import tiles, vectors
from tabulon.operators.projection import neighbours


def nearest(x, k):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    return np.sort(far, axis=1)[:, :k]


def test_every_two_rows_meet_once(spark, monkeypatch):
    monkeypatch.setattr(tiles, "NUMBERS", 40)
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(130)], "k long, v array<double>")

    def run(left, right):
        assert left.num_rows * 2 <= 80 and right.num_rows * 2 <= 80  # blocks are of about NUMBERS numbers
        for a in left.column("k").to_pylist():
            yield pa.record_batch([pa.array([a] * right.num_rows), pa.array(right.column("k").to_pylist())], names=["a", "b"])

    assert tiles.blocks(rows, "v") == 7
    got = [(r["a"], r["b"]) for r in tiles.meet(rows, "v", run, "a long, b long").collect()]
    assert len(got) == len(set(got)) == 130 * 130


@pytest.mark.parametrize("numbers", [1 << 22, 64 * 200])
def test_all_neighbours_are_found_in_many_dimensions(spark, monkeypatch, numbers):
    """Rows on a sphere in 64 dimensions, where neighbours of neighbours are hardly nearer than others; copies among them, far from the origin."""
    monkeypatch.setattr(tiles, "NUMBERS", numbers)
    x = np.random.default_rng(2).normal(size=(2600, 64))
    x = x / np.linalg.norm(x, axis=1)[:, None] + 1000
    x[40:80] = x[0]
    want = nearest(x, 15)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, v array<double>")
    found = {}
    for r in neighbours(points).collect():
        found.setdefault(r["a"], []).append((r["d"], r["b"]))
    assert len(found) == 2600 and all(len({b for _, b in v}) == 15 and i not in {b for _, b in v} for i, v in found.items())
    assert np.allclose([sorted(d for d, _ in found[i]) for i in range(2600)], want, atol=1e-9)


def test_odd_vectors_are_no_neighbours(spark):
    rows = [(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [2.0]), (7, []), (8, [0.0, 1.0, 2.0])]
    points = spark.createDataFrame(rows, "pos long, v array<float>")
    assert sorted(tuple(r) for r in neighbours(points).collect()) == [(0, 1, 5.0), (1, 0, 5.0), (5, 6, 1.0), (6, 5, 1.0)]
    assert neighbours(points.limit(0)).count() == 0


def reference(rows):
    """As the SQL has it, over plain lists."""
    means = {}
    for k, c, v in rows:
        for k2, c2, w in rows:
            if k is not None and k2 is not None and k != k2:
                cell = means.setdefault(k, {}).setdefault((c, c2), [])
                if v is not None and w is not None and len(v) == len(w) and None not in [*v, *w]:
                    cell.append(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)))))
    out = []
    for cells in means.values():
        a = [np.mean(d) for (c, c2), d in cells.items() if d and None not in (c, c2) and c == c2]
        b = [np.mean(d) for (c, c2), d in cells.items() if d and None not in (c, c2) and c != c2]
        out.append((min(b) - max(a)) / max(max(a), min(b)) if a and b and max(max(a), min(b)) > 0 else 0.0)
    return float(np.mean(out)) if out else None


@pytest.mark.parametrize("numbers", [1 << 22, 30])
def test_silhouette_of_odd_rows(spark, monkeypatch, numbers):
    """Copies within and across classes, keys that repeat, null classes and vectors, other lengths, clusters far from the origin."""
    monkeypatch.setattr(tiles, "NUMBERS", numbers)
    draw = np.random.default_rng(4)
    rows = [(i, i % 4 if i % 11 else None, [float(x) for x in 1e6 + draw.normal(size=3) * 1e-3 + 1e3 * (i % 2)]) for i in range(90)]
    rows += [(100 + i, i % 3, [1e6, 1e6, 1e6]) for i in range(20)] + [(200 + i // 3, i % 2, [float(i), 2.0, 3.0]) for i in range(15)]
    rows += [(300, 1, None), (301, 2, [1.0, None, 2.0]), (302, 1, [1.0]), (303, 2, [2.5]), (304, 2, [9.0]), (None, 1, [1.0, 2.0, 3.0]), (305, 9, [4.0, 4.0, 4.0])]
    df = spark.createDataFrame(rows, "k long, c long, v array<double>")
    got = vectors.silhouette(df, "k", "c", "v").first()[0]
    assert got == pytest.approx(reference(rows), abs=1e-8)
    same = [(i, i % 2, [5.0, 1e5 * (i % 3 == 0)]) for i in range(40)]
    assert vectors.silhouette(spark.createDataFrame(same, df.schema), "k", "c", "v").first()[0] == pytest.approx(reference(same), abs=1e-9)
    assert vectors.silhouette(df.filter("k = 200"), "k", "c", "v").first()[0] is None


def test_silhouette_sends_no_row_a_pair_of_small_blocks(spark):
    """10,000 rows were dealt into five blocks and met 25 times, with as many rows of sums a row and class; now the blocks hold 4 million numbers."""
    df = spark.range(10_000).selectExpr("id AS k", "id % 2 AS c", "array(rand(1), rand(2)) AS v")
    assert tiles.blocks(df, "v", once=True) == 5 and tiles.blocks(df.unionByName(df).unionByName(df), "v", once=True) == 5
