import pytest

from tabulon.plans import registry

SMALL = "/root/testdata/sf0.001"


def same_as_sql(spark, name, digits=4):
    db = pytest.importorskip("duckdb").connect()
    for table in ("events", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = registry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted(tuple(round(v, digits) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)
    got = key(got.select(columns).collect())
    assert got == key(want)
    return got


def test_format_p_of_all_events(spark):
    shown = {r[1] for r in same_as_sql(spark, "format_p")}
    assert {"p < 0.001", "p < 0.01", "p < 0.05"} < shown


def test_silhouette_takes_all_rows(spark):
    import numpy as np

    from tabulon.operators import vectors

    draw = np.random.default_rng(5)
    label = np.r_[np.arange(6200) % 3, [7, 7, 8]]
    x = draw.normal(size=(len(label), 2)) + label[:, None]
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    classes, want = np.unique(label), []
    sums = np.stack([far[:, label == c].sum(axis=1) for c in classes], axis=1)
    sizes = np.array([(label == c).sum() for c in classes])
    for i, c in enumerate(label):
        own = classes == c
        if sizes[own][0] == 1:
            want.append(0.0)
            continue
        a, b = sums[i][own][0] / (sizes[own][0] - 1), (sums[i] / sizes)[~own].min()
        want.append((b - a) / max(a, b))
    rows = spark.createDataFrame([(i, int(c), [float(v) for v in p]) for i, (c, p) in enumerate(zip(label, x, strict=True))], "k long, c long, v array<double>")
    assert vectors.silhouette(rows, "k", "c", "v").first()[0] == pytest.approx(np.mean(want), abs=1e-9)


def test_silhouette_equals_sql(spark):
    same_as_sql(spark, "silhouette")


def test_fusion_gives_every_component(spark):
    assert {r[0] for r in same_as_sql(spark, "fusion")} == set(range(64))


def test_forest_takes_the_whole_job(spark, monkeypatch):
    from tabulon.operators import forest

    called = {}

    def seen(df, key, label, features, k=5, trees=100, depth=10, seed=42):
        called.update(features=len(features), k=k, trees=trees, depth=depth)
        return spark.createDataFrame([(0, 1, 1, 0)], "vec_id int, truth int, predicted int, fold int")

    monkeypatch.setattr(forest, "cross_validated", seen)
    registry.queries()["forest_scores"](spark, SMALL).collect()
    assert called == {"features": 64, "k": 5, "trees": 100, "depth": 10}
