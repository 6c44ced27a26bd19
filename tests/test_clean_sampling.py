from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulon.operators import clean, sampling


def test_null_counts_as_different(spark):
    df = spark.createDataFrame([("m", None), ("m", "cpp"), (None, "python"), ("m", "java")], "model string, language string")
    assert [tuple(r) for r in clean.known_and_not(df, "model", "language", "cpp").collect()] == [("m", None), ("m", "java")]


def test_subset_checks_its_columns(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    assert clean.subset(df, k="a", v=None).count() == 1
    assert clean.subset(df).count() == 2
    with pytest.raises(ValueError):
        clean.subset(df, nope=1)


def test_null_profile_counts_nan(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x"), (None, "y")], "v double, s string")
    assert {r["column_name"]: r["n_null"] for r in clean.null_profile(df).collect()} == {"v": 2, "s": 1}


def test_keep_last_row_of_a_key(spark):
    df = spark.createDataFrame([(-1, 0, "a"), (-1, 1, "b"), (5, 2, "c")], "idx int, line int, v string")
    assert sorted(tuple(r) for r in clean.keep_last(df, "idx", "line").collect()) == [(-1, 1, "b"), (5, 2, "c")]


def test_labels_are_dense_and_null_is_a_word(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "l string")
    assert {r["l"]: r["label_id"] for r in clean.encode_labels(df, "l").collect()} == {None: 0, "a": 1, "b": 2}


@pytest.fixture(scope="module")
def strata(spark):
    rows = [(i, "s%d" % (0 if i < 50 else 1 if i < 95 else 2), "en" if i % 2 else "de") for i in range(100)]
    return spark.createDataFrame(rows, "id long, source string, lang string")


def test_proportional_rounds_half_even_and_keeps_all_of_a_small_table(strata):
    got = Counter(r["source"] for r in sampling.proportional(strata, "source", 10, "id").collect())
    assert got == {"s0": 5, "s1": 4, "s2": 1}  # 5, 4.5 -> 4, 0.5 -> at least 1
    assert sampling.proportional(strata, "source", 100, "id").count() == 100


def test_quota_takes_test_whole_and_drops_other_splits(spark):
    rows = [(i, "en", ("train", "val", "test", "dev")[i % 4], "m%d" % (i % 8 // 4), "s%d" % (i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, language string, split string, model string, source string")
    got = Counter((r["split"], r["model"]) for r in sampling.quota_sample(df, {"train": 21, "val": 1000}, "id").collect())
    assert got[("test", "m0")] + got[("test", "m1")] == 100
    assert got[("val", "m0")] + got[("val", "m1")] == 100
    assert 8 <= got[("train", "m0")] <= 10 and ("dev", "m0") not in got


def test_split_and_folds_are_stratified(strata):
    parts = Counter((r["lang"], r["part"]) for r in sampling.split(strata, "lang", "id").collect())
    assert parts == {("en", "train"): 10, ("en", "test"): 40, ("de", "train"): 10, ("de", "test"): 40}
    assert set(Counter((r["lang"], r["fold"]) for r in sampling.folds(strata, "lang", "id").collect()).values()) == {10}


def test_episodes_nest(strata):
    rows = sampling.episodes(strata, "source", "id", tasks=3, max_shot=6).collect()
    drawn = {}
    for r in rows:
        drawn.setdefault((r["task_id"], r["class_id"], r["k"]), set()).add(r["member"])
    assert {c for _, c, _ in drawn} == {"s0", "s1"}  # the third class is too small
    for (task, c, k), members in drawn.items():
        assert len(members) == k and (k == 6 or members < drawn[task, c, k + 1])


def test_mini_batches_are_full_but_for_the_last(strata):
    sizes = Counter(r["batch_id"] for r in sampling.mini_batches(strata, "id").collect())
    assert sizes == {0: 32, 1: 32, 2: 32, 3: 4}


def test_floor_sample(strata):
    got = Counter(r["source"] for r in sampling.floor_sample(strata, "source", 10, "id").collect())
    assert got == {"s0": 5, "s1": 4, "s2": 1}
    assert strata.filter(F.col("id") < 0).count() == 0
