import math
import random

import pytest

from tabulon.functions import tails
from tabulon.operators import evaluation, ranks
from tabulon.streaming import early_stop


@pytest.fixture(scope="module")
def ties(spark):
    draw = random.Random(3)
    rows = [(draw.choice("abc"), float(draw.randint(0, 6))) for _ in range(60)] + [("a", None), ("b", float("nan"))]
    return rows, spark.createDataFrame(rows, "c string, v double")


def known(rows, *classes):
    return [(c, v) for c, v in rows if v is not None and not math.isnan(v) and c in classes]


def test_kruskal_against_the_definition(ties):
    rows, df = ties
    rows = known(rows, "a", "b", "c")
    values = [v for _, v in rows]
    rank = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values}
    n, h = len(rows), 0.0
    for c in "abc":
        own = [rank[v] for k, v in rows if k == c]
        h += sum(own) ** 2 / len(own)
    h = (12 / (n * (n + 1)) * h - 3 * (n + 1)) / (1 - sum(values.count(v) ** 2 - 1 for v in values) / (n**3 - n))
    got = ranks.kruskal(df, "c", ["v"], ["a", "b", "c"]).first()
    assert got["n"] == n and got["h"] == pytest.approx(h) and got["p"] == pytest.approx(math.exp(-h / 2)) and got["eta2"] == pytest.approx((h - 2) / (n - 3))


def test_delta_equals_brute_force(ties):
    rows, df = ties
    for r in ranks.mann_whitney(df, "c", ["v"], ["a", "b", "c"]).collect():
        x, y = ([v for k, v in known(rows, r[s]) if k == r[s]] for s in ("first", "second"))
        more = sum((a > b) - (a < b) for a in x for b in y)
        assert r["delta"] == pytest.approx(more / (len(x) * len(y)))
        assert r["u"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in x for b in y))


def test_odd_chi_square_tail(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.5,), (7.0,)], "x double")
    for freedom, want in ((1, [0.479500, 0.008151]), (3, [0.918891, 0.071898])):
        assert [r[0] for r in df.select(tails.chi_square_tail(F.col("x"), freedom)).collect()] == pytest.approx(want, abs=1e-5)


def test_standardise_and_clip(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = [tuple(r) for r in ranks.standardise(df, ["a", "b"]).collect()]
    deviation = math.sqrt(14 / 9)
    assert [g[0] for g in got] == pytest.approx([(x - 4 / 3) / deviation for x in (1, 3, 0)]) and {g[1] for g in got} == {0.0}
    clipped = [r[0] for r in ranks.clip_at_quantile(df, "a", 0.5).collect()]
    assert clipped == [1.0, 2.0, None]


def test_pairwise_p_is_corrected_but_not_clipped(ties):
    _, df = ties
    got = ranks.pairwise_table(df, "c", ["v"], ["a", "b", "c"]).collect()
    assert len(got) == 3 and max(r["p_adjusted"] for r in got) <= 3 and all(r["significant"] == "No" for r in got if r["p_adjusted"] > 0.05)


def test_confusion_with_empty_rows_and_columns(spark):
    rows = [("x", "x"), ("x", "y"), ("y", "x"), ("x", "y")]
    df = spark.createDataFrame(rows, "t string, p string")
    grid = evaluation.confusion(df, "t", "p", ["x", "y", "z"])
    cells = {(r["truth"], r["predicted"]): (r["n"], round(r["rate"], 3)) for r in grid.collect()}
    assert cells["x", "y"] == (2, 0.667) and cells["z", "z"] == (0, 0.0) and len(cells) == 9
    assert [tuple(r)[:2] for r in evaluation.top_confusions(grid, ["x", "y", "z"], 2).collect()] == [("y", "x"), ("x", "y")]
    assert [r["class"] for r in evaluation.recall(grid).collect()][0] == "x"
    s = evaluation.scores(df, "t", "p").first()
    assert (s["n"], s["accuracy"], s["n_classes"]) == (4, 0.25, 2) and s["macro_f1"] == pytest.approx((2 / 5 + 0) / 2)


LOSSES = {
    "improving": ([3.0, 2.0, 1.0], None),
    "plateau": ([3.0, 3.0 - 1e-8, 3.0, 2.0], 2),
    "exact": ([3.0, 4.0, 4.0], 2),
    "reset": ([3.0, 4.0, 2.0, 4.0, 1.0], None),
    "nan": ([3.0, float("nan"), 4.0, 4.0, 4.0], 4),  # NaN improves, and so does what follows it
}


def test_early_stopping_fold(spark):
    rows = [(run, e, x) for run, (losses, _) in LOSSES.items() for e, x in enumerate(losses)]
    df = spark.createDataFrame(rows, "run string, epoch long, loss double")
    got = {r["run"]: r["stopped_at"] for r in early_stop.stop_epochs(df, "run", "epoch", "loss", 2).collect()}
    assert got == {run: stop for run, (_, stop) in LOSSES.items()}


def test_early_stopping_on_a_stream(spark, tmp_path):
    rows = [(run, e, x) for run, (losses, _) in LOSSES.items() for e, x in enumerate(losses)]
    source = tmp_path / "losses"
    for e in range(5):
        part = [r for r in rows if r[1] == e]
        spark.createDataFrame(part, "run string, epoch long, loss double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("run string, epoch long, loss double").parquet(str(source))
    query = early_stop.stop_stream(stream, "run", "epoch", "loss", 2).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {(r["run"], r["stopped_at"]) for r in spark.table("stops").collect()} == {("plateau", 2), ("exact", 2), ("nan", 4)}
