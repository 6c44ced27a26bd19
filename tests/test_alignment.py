import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon import cli
from tabulon.operators import align, fusion, training


def slopes(loss, weights, step=1e-6):
    """Central differences of ``loss`` in every number of the weights."""
    flat = training.flatten(weights)
    out = np.zeros_like(flat)
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += step
        down[i] -= step
        out[i] = (loss(training.shaped(up, weights)) - loss(training.shaped(down, weights))) / 2 / step
    return out


def plain_losses(weights, x, y, terms):
    """The losses term by term, from the definition with eigenvalues."""
    g, t = x @ weights["first"].T, y @ weights["second"].T
    u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (g, t))
    s = min(math.exp(weights["scale"][0]), 100) * u @ v.T
    n = len(x)
    near = -sum(s[i, i] - math.log(np.exp(s[i]).sum()) for i in range(n)) / n
    far = -sum(s[i, i] - math.log(np.exp(s[:, i]).sum()) for i in range(n)) / n
    contrastive = (near + far) / 2
    eigenvalues = np.linalg.eigvalsh(u.T @ u / n)
    both = (g - g.mean(0)).T @ (t - t.mean(0)) / (n - 1 + terms.eps)
    isotropy, cross = eigenvalues.var(), (both**2).mean()
    return contrastive, isotropy, cross, contrastive + terms.isotropy * isotropy + terms.cross / (contrastive + terms.eps) * cross


@pytest.mark.parametrize("terms", [align.Terms(), align.Terms(3.0, 2.0), align.Terms(1.0, 0.0), align.Terms(0.0, 0.0)])
@pytest.mark.parametrize("scale", [1.2, 5.0])
def test_losses_and_gradient_of_a_batch(terms, scale):
    draw = np.random.default_rng(3)
    x, y = draw.normal(size=(7, 5)), draw.normal(size=(7, 4))
    weights = training.starting(1, first=(3, 5), second=(3, 4)) | {"scale": np.array([scale])}
    losses, gradient = align.batch_loss(weights, x, y, terms)
    assert losses == pytest.approx(plain_losses(weights, x, y, terms))
    share = terms.cross / (losses[0] + terms.eps)
    want = slopes(lambda w: align.batch_loss(w, x, y, terms, share)[0][-1], weights)
    assert training.flatten(gradient) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("router", [True, False])
def test_gradient_of_the_fusion(router):
    draw = np.random.default_rng(4)
    a, b, y = draw.normal(size=(9, 4)), draw.normal(size=(9, 3)), draw.integers(0, 3, 9)
    weights = fusion.starting_weights((4, 3), 5, 3, router, 2)
    weights = {k: v + draw.normal(0, 0.3, v.shape) for k, v in weights.items()}
    losses, gradient = fusion.fusion_loss(weights, a, b, y)
    scores = fusion.model_of(weights)(a, b)[2]
    assert losses == pytest.approx(np.log(np.exp(scores).sum(axis=1)) - scores[np.arange(9), y])
    assert training.flatten(gradient) == pytest.approx(slopes(lambda w: fusion.fusion_loss(w, a, b, y)[0].sum(), weights), abs=1e-5)


PAIRS = "id long, batch long, a array<double>, b array<double>, c string, held boolean"


def pairs(n=160, size=8):
    draw, turn = np.random.default_rng(5), np.random.default_rng(6).normal(size=(4, 6))
    rows = []
    for i in range(n):
        x = draw.normal(size=4)
        rows.append((i, None if i // size == 3 else i // size, x.tolist(), (x @ turn + draw.normal(0, 0.1, 6)).tolist(), "pqr"[int(np.argmax(x[:3]))], i // size % 4 == 0))
    return [*rows, (900, 1, None, [0.0] * 6, "p", False), (901, 1, [1.0] * 3, [0.0] * 6, "p", True), (902, 1, [1.0, None, 1.0, 1.0], [1.0] * 6, None, False), (903, 70, [1.0] * 4, [1.0] * 6, "q", None)]


def grouped(rows, by):
    found = {}
    for r in rows:
        if r[2] is not None and len(r[2]) == 4 and None not in r[2]:
            found.setdefault(by(r), []).append(r)
    return {k: (np.array([r[2] for r in v]), np.array([r[3] for r in v])) for k, v in found.items() if len(v) > 1}


@pytest.mark.parametrize("arrow", [10000, 3])
def test_losses_of_every_batch(spark, arrow):
    rows, terms = pairs(), align.Terms(2.0, 0.7)
    weights = training.starting(1, first=(3, 4), second=(3, 6)) | {"scale": np.array([1.0])}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow)
    try:
        got = {r["batch"]: r for r in align.batch_losses(spark.createDataFrame(rows, PAIRS), "batch", "a", "b", weights, terms).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = grouped(rows, lambda r: r[1])
    assert set(got) == set(want) and None in got
    for k, (x, y) in want.items():
        assert got[k]["n"] == len(x)
        assert [got[k][c] for c in align.LOSSES] == pytest.approx(plain_losses(weights, x, y, terms))
    assert align.batch_losses(spark.createDataFrame([], PAIRS), "batch", "a", "b", weights).count() == 0


def adam(weights, measure, patience, epochs, rate):
    """Training in plain NumPy."""
    flat, m, v, best, bad, done, kept = training.flatten(weights), 0, 0, None, 0, [], None
    for e in range(epochs):
        now = training.shaped(flat, weights)
        slope, train, held = measure(now)
        improved = best is None or not -held < best + 1e-7
        bad, best, kept = (0, -held, now) if improved else (bad + 1, best, kept)
        done.append((e, train, held, improved))
        if bad >= patience:
            return kept, done, e
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        flat = flat - rate * (m / (1 - 0.9 ** (e + 1))) / (np.sqrt(v / (1 - 0.999 ** (e + 1))) + 1e-8)
    return kept, done, None


def same(got, want):
    weights, epochs, stop = want
    assert got.stopped_at == stop and len(got.epochs) == len(epochs)
    for mine, other in zip(got.epochs, epochs, strict=True):
        assert mine == pytest.approx(other)
    for k, v in weights.items():
        assert np.allclose(got.weights[k], v)


@pytest.mark.parametrize(("patience", "epochs", "rate"), [(5, 12, 0.02), (1, 40, 0.6)])
def test_alignment_equals_training_by_hand(spark, tmp_path, patience, epochs, rate):
    rows, terms, path = pairs(), align.Terms(), str(tmp_path / "w")
    got = align.align(spark.createDataFrame(rows, PAIRS), "batch", "a", "b", "held", 3, terms, patience, epochs, rate, 9, path)
    begin = training.starting(9, first=(3, 4), second=(3, 6)) | {"scale": np.array([math.log(1 / 0.07)])}
    groups = grouped(rows, lambda r: (r[1], bool(r[5])))

    def measure(weights):
        seen = {k: align.batch_loss(weights, x, y, terms) for k, (x, y) in groups.items()}
        learnt = [v for k, v in seen.items() if not k[1]]
        return sum(training.flatten(g) for _, g in learnt) / len(learnt), np.mean([x[-1] for x, _ in learnt]), np.mean([v[0][-1] for k, v in seen.items() if k[1]])

    same(got, adam(begin, measure, patience, epochs, rate))
    assert got.epochs[-1][1] < got.epochs[0][1]
    stored = training.load(spark, path)
    assert set(stored) == set(got.weights) and all(np.array_equal(stored[k], v) for k, v in got.weights.items())
    assert len([p for p in (tmp_path / "w").iterdir() if p.name.startswith("epoch=")]) == 1


@pytest.mark.parametrize("router", [True, False])
def test_fusion_equals_training_by_hand(spark, router):
    rows = pairs()
    got = fusion.train_fusion(spark.createDataFrame(rows, PAIRS), "a", "b", "c", "held", 5, router, 2, 15, 0.05, 7)
    good = [r for r in rows if r[2] is not None and len(r[2]) == 4 and None not in r[2] and r[4] is not None]
    a, b, y, h = np.array([r[2] for r in good]), np.array([r[3] for r in good]), np.array(["pqr".index(r[4]) for r in good]), np.array([bool(r[5]) for r in good])

    def measure(weights):
        losses, gradient = fusion.fusion_loss(weights, a[~h], b[~h], y[~h])
        return training.flatten(gradient) / len(losses), losses.mean(), fusion.fusion_loss(weights, a[h], b[h], y[h])[0].mean()

    same(got, adam(fusion.starting_weights((4, 6), 5, 3, router, 7), measure, 2, 15, 0.05))
    shown = fusion.gated_fusion(spark.createDataFrame(rows[:160], PAIRS), "a", "b", fusion.model_of(got.weights)).collect()
    assert sum("pqr"[r["predicted"]] == r["c"] for r in shown) > 96
    assert ("router" in got.weights) is router


def test_both_kinds_of_rows_are_needed(spark):
    df = spark.createDataFrame(pairs(), PAIRS)
    for odd in (df.limit(0), df.withColumn("held", F.lit(True)), df.withColumn("held", F.lit(None).cast("boolean")), df.withColumn("a", F.lit(None).cast("array<double>"))):
        with pytest.raises(ValueError):
            align.align(odd, "batch", "a", "b", "held", 3, epochs=1)
        with pytest.raises(ValueError):
            fusion.train_fusion(odd, "a", "b", "c", "held", 3, epochs=1)


def test_sums_of_many_chunks(spark):
    rows = spark.range(0, 1000, numPartitions=7)
    got = training.sum_over(rows, 13, lambda batches: sum((np.arange(13.0) * b.num_rows for b in batches), np.zeros(13)), chunk=5, parts=2)
    assert np.array_equal(got, np.arange(13.0) * 1000)


def test_projected_vectors(spark):
    weight = np.array([[1.0, 2.0, 0.0, 0.0], [0.0, 0.0, 0.5, -1.0]])
    rows = pairs(12)
    got = {r["id"]: r["z"] for r in align.project(spark.createDataFrame(rows, PAIRS), "a", weight, "z").collect()}
    for i, _, x, *_ in rows:
        whole = x is not None and len(x) == 4 and None not in x
        assert got[i] == (pytest.approx((weight @ np.array(x)).tolist()) if whole else None)
    with pytest.raises(ValueError):
        align.project(spark.createDataFrame(rows, PAIRS), "a", weight, "b")


@pytest.mark.parametrize("terms", ["all", "no_cross", "contrastive"])
def test_pretraining_and_fusion_by_command(spark, tmp_path, capsys, terms):
    spark.createDataFrame(pairs()[:160], PAIRS).write.parquet(str(tmp_path / "t"))
    given = ["run", str(tmp_path / "t"), "--vector", "a", "--second", "b", "--label", "c", "--epochs", "3", "--patience", "2", "--hidden_dim", "3", "--output_dim", "4", "--checkpoints", str(tmp_path / "c")]
    assert cli.main([*given, "--task_name", "pretrain", "--terms", terms, "--batch_size", "16"], spark) == 0
    assert training.load(spark, str(tmp_path / "c" / "aligned"))["first"].shape == (3, 4)
    for model, pattern in (("fused", "pretrain"), ("halves", "none")):
        for task in ("downstream", "infer"):
            assert cli.main([*given, "--task_name", task, "--model", model, "--pattern", pattern], spark) == 0
    said = capsys.readouterr().out.strip().splitlines()
    assert len(said) == 5 and said[1] == said[2] and said[3] == said[4] and "macro_f1" in said[1]
    with pytest.raises(ValueError):
        cli.main([*given[:2], "--task_name", "pretrain"], spark)
