import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tabulon.operators import ranks, sampling
from tabulon.operators.order import running


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_totals_equal_plain_ones(spark, parts):
    draw = random.Random(1)
    rows = [(draw.choice(["hot"] * 6 + ["b", None]), i, draw.randint(0, 9)) for i in range(500)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at long, n long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["at"]: r["sum"] for r in running(df, ["g"], ["at"], "sum", F.col("n")).collect()}
        place = {r["at"]: r["place"] for r in running(df, [], ["at"], "place").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {at: sum(n for h, b, n in rows if h == g and b < at) for g, at, _ in rows}
    assert place == {at: at for _, at, _ in rows}
    assert running(df.limit(0), ["g"], ["at"], "sum").count() == 0


def test_seeded_places_of_a_hot_group(spark):
    rows = [("hot" if i % 10 else None, i) for i in range(2000)]
    got = {(r["g"], r["__place"]): r["i"] for r in sampling.in_seeded_order(spark.createDataFrame(rows, "g string, i long"), ["g"], "i", 42).collect()}
    for g in ("hot", None):
        order = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for h, i in rows if h == g)
        assert [got[g, k + 1] for k in range(len(order))] == [i for _, i in order]


def test_episodes_with_few_and_with_many_members(spark):
    rows = [("big", i) for i in range(3000)] + [("small", i) for i in range(5)] + [("less", 1), ("less", 2)]
    got = {}
    for r in sampling.episodes(spark.createDataFrame(rows, "c string, i long"), "c", "i", tasks=3, max_shot=4).filter("k = 4").collect():
        got.setdefault((r["task_id"], r["class_id"]), {})[r["rank"]] = r["member"]
    assert {c for _, c in got} == {"big", "small"}
    for (task, c), drawn in got.items():
        order = sorted((hashlib.md5(f"42:{task}:{c}:{i}".encode()).hexdigest(), i) for h, i in rows if h == c)
        assert [drawn[k] for k in range(1, 5)] == [i for _, i in order[:4]]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.99, 1.0])
def test_quantile_is_exact(spark, q):
    import numpy as np

    values = [random.Random(2).choice([1.0, 2.5, 7.0]) * i for i in range(101)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    assert ranks.quantile(df, "v", q).first()[0] == pytest.approx(float(np.quantile(values, q)))
    assert ranks.quantile(df.filter("v < -1"), "v", q).first()[0] is None


def test_significant_and_capped(spark):
    table = spark.createDataFrame([("f", "Yes"), ("g", "No")], "feature string, significant string")
    assert [r[0] for r in ranks.significant(table).collect()] == ["f"] and ranks.significant(table.limit(0)).count() == 0
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1)], "c string, i long")
    assert {r["c"]: r["count"] for r in ranks.capped(df, "c", "i", 10).groupBy("c").count().collect()} == {"a": 10, "b": 1}
