import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tabulon.functions import code, tails
from tabulon.operators import clean, graph, ranks, sampling


def test_samples_keep_null_strata(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "b")], "k long, s string")
    assert sampling.proportional(df, "s", 10, "k").count() == 4
    assert sampling.floor_sample(df, "s", 10, "k").count() == 4
    assert Counter(r["s"] for r in sampling.floor_sample(df, "s", 3, "k").collect()) == {"a": 1, None: 1, "b": 1}
    assert sampling.proportional(df.limit(0), "s", 10, "k").count() == 0


def test_quota_counts_null_models_and_languages(spark):
    rows = [(i, None, "train", "m", "x") for i in range(8)] + [(20 + i, None, "train", None, None) for i in range(8)] + [(50, "py", "train", "m", None), (60, "py", "test", None, None), (70, "py", "other", "m", "x")]
    df = spark.createDataFrame(rows, "k long, language string, split string, model string, source string")
    got = Counter((r["language"], r["split"], r["model"]) for r in sampling.quota_sample(df, {"train": 6}, "k").collect())
    assert got == {(None, "train", "m"): 3, (None, "train", None): 3, ("py", "train", "m"): 1, ("py", "test", None): 1}


def test_keep_last_with_null_orders(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (2, 3, None), (2, 1, "z"), (None, 5, "w")], "k long, o long, v string")
    assert {tuple(r) for r in clean.keep_last(df, "k", "o").collect()} == {(1, None, "x"), (2, 3, None), (None, 5, "w")}


def test_dangling_edges_of_one_place(spark):
    nodes = spark.createDataFrame([("g", "1", "t", 0), ("g", "2", "t", 1), ("h", "1", "t", 0)], "graph string, node string, type string, pos long")
    edges = spark.createDataFrame([("g", "1", "2", "r", 0), ("g", "1", "9", "r", 0), ("h", "1", "1", "r", None), ("h", "1", None, "r", 3), ("g", "1", "9", "r", 0)], "graph string, source string, target string, rel string, epos long")
    assert sorted(map(str, graph.dangling_edges(nodes, edges).collect())) == sorted(map(str, [r for r in edges.collect() if r["target"] in ("9", None)]))


TEXTS = ["éx = total", "x² y①z a‿b _q", "naïve äb 变量x x变", "for i in x: print(i)", "", "́abc abć", "9a a9 __init__ ẞb", "Ⅳz zⅣ", "a" * 50_000 + "́"]


@pytest.mark.parametrize("language", ["python", "java"])
def test_identifiers_beside_marks(spark, language):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", code.identifiers(F.col("t"), language).alias("names"), code.obfuscate(F.col("t"), language).alias("hidden"))

    def fnv(m):
        h = code.FNV_OFFSET
        for b in m[0].encode():
            h = ((h ^ b) * code.FNV_PRIME) % 2**32
        return m[0] if m[0] in code.RESERVED[language] else f"h{h:08x}"

    pattern = r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"
    for r in df.collect():
        assert set(r["names"]) == set(re.findall(pattern, r["t"])) - set(code.RESERVED[language])
        assert r["hidden"] == re.sub(pattern, fnv, r["t"])


def test_an_empty_class_is_no_group(spark):
    draw = random.Random(4)
    rows = [(c, float(draw.randint(0, 9))) for c in "ab" for _ in range(10)] + [("c", None)]
    df = spark.createDataFrame(rows, "c string, v double")
    assert ranks.kruskal(df, "c", ["v"], ["a", "b", "c", "d"]).first() == ranks.kruskal(df, "c", ["v"], ["a", "b"]).first()
    alone = ranks.kruskal(df, "c", ["v"], ["a", "c"]).first()
    assert (alone["n"], alone["h"], alone["p"], alone["eta2"]) == (10, None, None, None)
    one = ranks.kruskal(spark.createDataFrame([("a", 1.0)], "c string, v double"), "c", ["v"], ["a", "b"]).first()
    assert (one["n"], one["h"], one["eta2"]) == (1, None, None)
    assert ranks.kruskal(df.limit(0), "c", ["v"], ["a", "b"]).count() == 0


def test_erfc_as_columns(spark):
    xs = [0.0, 1e-9, 0.3, 1.0, 1.7, 1.999999, 2.0, 2.1, 3.0, 5.5, 12.0, 26.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(tails.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=1e-12)
    edges = spark.createDataFrame([(None,), (-3.0,), (40.0,)], "x double").select(tails.normal_two_sided(F.col("x"))).collect()
    assert edges[0][0] is None and edges[1][0] == 1.0 and 0 <= edges[2][0] < 1e-300


def test_chi_square_tail_for_any_freedom(spark):
    # Upper points of 5, 1 and 0.1 per cent from printed tables.
    known = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (9.487729036781154, 4, 0.05), (11.070497693516351, 5, 0.05), (6.634896601021213, 1, 0.01), (15.086272469388987, 5, 0.01), (16.26623619623813, 3, 0.001)]
    df = spark.createDataFrame([(x, k) for x, k, _ in known], "x double, k int")
    assert [r[0] for r in df.select(tails.chi_square_tail(F.col("x"), F.col("k"))).collect()] == pytest.approx([p for *_, p in known], rel=1e-9)
    odd = spark.createDataFrame([(0.0, 3), (-1.0, 2), (None, 3), (2.0, None), (900.0, 7)], "x double, k int").select(tails.chi_square_tail(F.col("x"), F.col("k"))).collect()
    assert [r[0] for r in odd[:4]] == [1.0, 1.0, None, None] and 0 < odd[4][0] < 1e-180


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (2, 3), (4, 4), (3, 7), (8, 1)])
def test_exact_p_equals_all_orders(n1, n2):
    every = Counter(sum(x - i for i, x in enumerate(chosen)) for chosen in combinations(range(n1 + n2), n1))
    for u in range(n1 * n2 + 1):
        least = min(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(n for x, n in every.items() if x <= least) / sum(every.values()))
        assert ranks.u_tail(n1, n2, float(u)) == pytest.approx(want, rel=1e-12)


def test_exact_and_approximate_p_of_one_table(spark):
    rows = [("a", float(3 * i)) for i in range(6)] + [("b", 3.0 * i + 1) for i in range(200)] + [("c", 2.0 + 3 * i) for i in range(30)] + [("d", 0.0), ("e", None)]
    got = {(r["first"], r["second"]): r for r in ranks.mann_whitney_p(spark.createDataFrame(rows, "c string, v double"), "c", ["v"], list("abcde")).collect()}
    assert {k for k, r in got.items() if r["method"] == "exact"} == {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")}
    assert got["a", "b"]["p"] == pytest.approx(ranks.u_tail(6, 200, got["a", "b"]["u"]))
    assert got["a", "d"]["method"] == "normal"  # they share a value
    assert got["a", "e"]["p"] is None
    # With many values either way of telling p agrees.
    assert ranks.u_tail(8, 5000, 16_000.0) == pytest.approx(math.erfc((8 * 5000 / 2 - 16_000 - 0.5) / math.sqrt(8 * 5000 * 5009 / 12) / math.sqrt(2)), rel=0.02)
