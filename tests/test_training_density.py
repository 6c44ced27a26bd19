import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon import cli
from tabulon.functions.dense import Linear
from tabulon.operators import heads
from tabulon.operators.density import densities
from tabulon.streaming.early_stop import stop_epochs


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    out = []
    for i in range(240):
        c = i % 3
        x = [draw.gauss(c, 1.2), draw.gauss(-c, 1.0), draw.gauss(0, 1)]
        out.append((i, x, "abc"[c if draw.random() > 0.15 else draw.randrange(3)], i % 4 == 0))
    return [*out, (900, None, "a", False), (901, [1.0, 2.0], "b", True), (902, [1.0, None, 2.0], "c", False), (903, [0.0, 0.0, 0.0], None, False), (904, [0.5, 0.5, 0.5], "a", None)]


SCHEMA = "id long, x array<double>, c string, held boolean"


def plain(rows, patience, epochs, rate, penalty):
    """Full-batch training in plain NumPy, keeping the best weights."""
    good = [(np.array(x), "abc".index(c), bool(h)) for _, x, c, h in rows if x is not None and len(x) == 3 and None not in x and c is not None]
    x, y, h = np.array([g[0] for g in good]), np.array([g[1] for g in good]), np.array([g[2] for g in good])
    w, b, best, bad, done, kept = np.zeros((3, 3)), np.zeros(3), None, 0, [], None
    for epoch in range(epochs):
        s = x @ w.T + b
        p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
        losses = -np.log(p[np.arange(len(y)), y])
        loss = losses[h].mean()
        improved = best is None or not -loss < best + 1e-7
        bad = 0 if improved else bad + 1
        best = -loss if improved else best
        kept = (w, b) if improved else kept
        done.append((epoch, losses[~h].mean(), loss, improved))
        if bad >= patience:
            return kept, done, epoch
        p[np.arange(len(y)), y] -= 1
        n = (~h).sum()
        w, b = w - rate * (p[~h].T @ x[~h] / n + penalty * w), b - rate * p[~h].sum(axis=0) / n
    return kept, done, None


@pytest.mark.parametrize(("patience", "epochs", "rate", "penalty"), [(2, 40, 3.0, 0.0), (3, 8, 0.3, 0.01), (1, 30, 6.0, 0.0)])
def test_training_stops_where_the_fold_says(spark, rows, tmp_path, patience, epochs, rate, penalty):
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "head")
    got = heads.train_head(df, "x", "c", "held", patience, epochs, rate, penalty, path)
    (w, b), done, stop = plain(rows, patience, epochs, rate, penalty)
    assert got.stopped_at == stop and len(got.epochs) == len(done)
    for mine, other in zip(got.epochs, done, strict=True):
        assert mine == pytest.approx(other)
    assert np.allclose(got.head.weight, w) and np.allclose(got.head.bias, b)
    stored = heads.load_trained(spark, path)
    assert np.array_equal(stored.weight, got.head.weight) and np.array_equal(stored.bias, got.head.bias)
    assert len([p for p in (tmp_path / "head").iterdir() if p.name.startswith("epoch=")]) == 1
    losses = spark.createDataFrame([("r", e, x) for e, _, x, _ in got.epochs], "run string, epoch long, loss double")
    fold = stop_epochs(losses, "run", "epoch", "loss", patience).first()
    assert fold["stopped_at"] == stop and fold["best_loss"] == pytest.approx(min(x for _, _, x, _ in got.epochs), abs=1e-6)


def test_a_head_needs_both_kinds_of_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for odd in (df.limit(0), df.withColumn("held", F.lit(True)), df.withColumn("held", F.lit(None).cast("boolean"))):
        with pytest.raises(ValueError):
            heads.train_head(odd, "x", "c", "held")


def test_applied_head(spark, rows):
    head = Linear(np.eye(3), np.array([0.0, 0.1, 0.2]))
    got = {r["id"]: r["predicted"] for r in heads.apply_linear(head, spark.createDataFrame(rows, SCHEMA), "x").collect()}
    assert (got[900], got[901], got[902], got[903]) == (None, None, None, 2)
    assert all(got[i] == int(np.argmax(np.array(x) + head.bias)) for i, x, *_ in rows[:240])


def test_command_with_patience(spark, rows, tmp_path, capsys):
    spark.createDataFrame([r for r in rows if r[0] < 240], SCHEMA).write.parquet(str(tmp_path / "t"))
    for task in ("downstream", "infer"):
        assert cli.main(["run", str(tmp_path / "t"), "--task_name", task, "--vector", "x", "--label", "c", "--patience", "2", "--epochs", "4", "--checkpoints", str(tmp_path / "c")], spark) == 0
    said = capsys.readouterr().out.strip().splitlines()
    assert len(said) == 2 and said[0] == said[1]


def test_densities_equal_the_definition(spark):
    draw = random.Random(2)
    rows = [(draw.choice("abc"), draw.gauss(0, 1) if draw.random() < 0.97 else 50.0, draw.choice([1.0, 2.0])) for _ in range(400)]
    rows += [("one", 0.5, None), ("same", 0.25, 1.0), ("same", 0.25, 1.0), ("a", None, float("nan")), ("other", 9.0, 9.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "c string, f double, g double")
    got = {(r["feature"], r["class"], r["bin"]): (r["x"], r["density"]) for r in densities(df, "c", ["f", "g"], ["a", "b", "c", "one", "same", "none"], bins=20).collect()}
    assert {(f, c) for f, c, _ in got} == {(f, c) for f in "fg" for c in ("a", "b", "c", "one", "same")} - {("g", "one")}
    for k, f in enumerate("fg", 1):
        known = [(r[0], r[k]) for r in rows if r[0] in ("a", "b", "c", "one", "same") and r[k] is not None and not math.isnan(r[k])]
        cap = float(np.quantile([v for _, v in known], 0.99))
        known = [(c, min(v, cap)) for c, v in known]
        low, width = min(v for _, v in known), (max(v for _, v in known) - min(v for _, v in known)) / 20
        for c in "abc":
            own = [v for x, v in known if x == c]
            band = len(own) ** -0.2 * np.std(own, ddof=1)
            middles = [low + (min(19, int((v - low) / width)) + 0.5) * width for v in own]
            for i in range(20):
                x = low + (i + 0.5) * width
                want = sum(math.exp(-(((x - m) / band) ** 2) / 2) for m in middles) / math.sqrt(2 * math.pi) / len(own) / band
                assert got[f, c, i] == (pytest.approx(x), pytest.approx(want))
    assert all(got["f", c, i][1] is None for c in ("one", "same") for i in range(20))
    assert densities(df.limit(0), "c", ["f"], ["a"]).count() == 0
