import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tabulon.llm import mixing
from tabulon.llm.mixing import hypergeometric, mix, multivariate, source_targets, split_quotas, write_mix

DOCS = "doc_id long, text string, source string, rank int, size string"


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again, sources given in order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    whole, capped = sum(sizes), set()
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        rest = whole - sum(most * sizes[i] for i in capped)
        target = [most * s if i in capped else rest * w[i] / sum(w[k] for k in open_) for i, s in enumerate(sizes)]
        above = {i for i in open_ if target[i] > most * sizes[i]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("sizes", [[100, 10, 1000], [1, 1, 1, 1, 5000], [7] * 9, [0, 0, 5, 0], [3, 900, 20, 1, 60, 2, 10**9], [0, 0], [12]])
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = [(f"s{i:03}", s) for i, s in enumerate(sizes)] + [("s000", 0)]
    got = {r["rank"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    assert [got[i] for i in range(len(sizes))] == pytest.approx(fill(sizes), rel=1e-12)


def test_hypergeometric_follows_its_law(spark):
    n, k, d, draws = 30, 11, 9, 40_000
    rows = spark.range(draws).select(hypergeometric(F.lit(n), F.lit(k), F.lit(d), (F.col("id") + 0.5) / draws).alias("x"))
    got = {r["x"]: r["count"] / draws for r in rows.groupBy("x").count().collect()}
    for x in range(d + 1):
        assert got.get(x, 0) == pytest.approx(math.comb(k, x) * math.comb(n - k, d - x) / math.comb(n, d), abs=1.5 / draws)


@pytest.mark.parametrize(("n", "k", "d", "x"), [(10, 10, 4, 4), (10, 0, 4, 0), (10, 3, 10, 3), (10, 3, 0, 0), (0, 0, 0, 0), (1, 1, 1, 1), (10**9, 1, 10**9, 1)])
def test_certain_draws(spark, n, k, d, x):
    assert spark.range(1).select(hypergeometric(F.lit(n), F.lit(k), F.lit(d), F.lit(0.37)).alias("x")).first()["x"] == x


def test_large_draws_are_near_the_mean(spark):
    rows = spark.range(200).select(hypergeometric(F.lit(3_000_000), F.lit(1_000_000), F.lit(1_500_000), (F.col("id") + 0.5) / 200).alias("x")).collect()
    spread = math.sqrt(1_500_000 / 3 * 2 / 3 * 1_500_000 / 2_999_999)
    xs = sorted(r["x"] for r in rows)
    assert abs(xs[100] - 500_000) < 0.1 * spread
    assert 2 * spread < xs[-1] - 500_000 < 4 * spread


def test_parts_of_a_draw_add_up(spark):
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("at"), F.lit(q).cast("long").alias("quota")) for i, q in enumerate([5, 0, 70, 1, 24])])
    rows = spark.range(300).select(multivariate(parts, F.lit(40).cast("long"), lambda at: (F.pmod(F.xxhash64("id", at), F.lit(1 << 30)) + 0.5) / float(1 << 30)).alias("out")).collect()
    for r in rows:
        x = [p["draws"] for p in r["out"]]
        assert sum(x) == 40
        assert all(0 <= a <= q for a, q in zip(x, [5, 0, 70, 1, 24], strict=True))
    assert sum(r["out"][2]["draws"] for r in rows) / 300 == pytest.approx(28, abs=0.6)


@pytest.mark.parametrize(("sources", "shards"), [(3, 8), (150, 5), (1, 1), (200, 3)])
def test_split_is_exact(spark, sources, shards):
    quotas = {i: (i * 37) % 11 + 1 for i in range(sources)}
    got = split_quotas(spark.createDataFrame(list(quotas.items()), "rank long, quota long"), shards, 3).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r["rank"]] += r["quota"]
        by_shard[r["shard"]] += r["quota"]
    assert by_source == quotas
    assert max(by_shard.values()) - min(by_shard[s] for s in range(shards)) <= 1


def rows(long=3000):
    out = [(i, " ".join(f"d{i}w{k}" for k in range(i % 23)), f"s{i % 4}", i, "x") for i in range(300)]
    out += [(1000 + i, f"tiny{i}", "tiny", 0, None) for i in range(5)] + [(2000 + i, None if i % 2 else "  \n ", None, 0, None) for i in range(4)]
    out += [(3000, " ".join(f"l{k}" for k in range(long)), "s1", 0, "y"), (None, "no id here", None, 1, ""), (5, "other text of five", "s1", 1, ""), (5, "other text of fivE", "s1", 1, "")]
    return [*out, *[(7777, "all the same", "s3", 0, "")] * 3]


def brute(docs, pieces_of):
    """Checks of a mix from its own pieces: every piece is within its document and no word of a document is taken more than three times."""
    sizes = Counter()
    for _, text, source, *_ in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    targets = dict(zip(names, fill([sizes[s] for s in names]), strict=True))
    taken, times = Counter(), defaultdict(Counter)
    for p in pieces_of:
        assert 0 <= p["first"] and p["first"] + p["words"] <= p["size"]
        taken[p["source"]] += p["words"]
        for w in range(p["first"], p["first"] + p["words"]):
            times[p["rank"], p["place"]][w] += 1
    for s in names:
        assert abs(taken[s] - targets[s]) <= 0.5 + 1e-9
    least, most = defaultdict(lambda: 3), Counter()
    for (rank, _), c in times.items():
        most[rank] = max(most[rank], max(c.values()))
    assert max(most.values()) <= 3
    return times


@pytest.mark.parametrize("least", [256, 16])
def test_mix_takes_targets(spark, monkeypatch, least):
    monkeypatch.setattr(mixing, "LEAST_WORDS", least)
    docs = rows()
    placed, pieces = mix(spark.createDataFrame(docs, DOCS), shards=5)
    assert placed.count() == len(docs)
    found = pieces.join(placed.select("rank", "place", "source", "size", "start"), ["rank", "place"]).collect()
    times = brute(docs, found)
    # Of a source all words are taken as often as its target holds it, and some once more.
    for rank in {r for r, _ in times}:
        sizes = {r["place"]: r["size"] for r in placed.filter(f"rank = {rank} AND size > 0").collect()}
        counts = [times[rank, place][w] for place, size in sizes.items() for w in range(size)]
        assert max(counts) - min(counts) <= 1
    # A block goes to one shard; shards differ by one block.
    blocks = {(p["rank"], p["number"]): p["shard"] for p in found}
    assert all(blocks[p["rank"], p["number"]] == p["shard"] for p in found)
    dealt = Counter(blocks.values())
    assert max(dealt.values()) - min(dealt[s] for s in range(5)) <= 1


def test_mix_is_the_same_again(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    once = sorted(map(tuple, mix(docs)[1].collect()))
    assert once == sorted(map(tuple, mix(docs.repartition(7))[1].collect()))
    assert once != sorted(map(tuple, mix(docs, seed=5)[1].collect()))


def test_written_mix_has_the_words(spark):
    docs = [r for r in rows(700) if r[0] != 5]
    out = write_mix(spark.createDataFrame(docs, DOCS), shards=3)
    words = {(r[0], r[2]): (r[1] or "").split() for r in docs}
    got = out.collect()
    assert {r["shard"] for r in got} == {0, 1, 2}
    for r in got:
        assert r["text"].split(" ") == words[r["doc_id"], r["source"]][r["first"] : r["first"] + r["words"]]
    whole = sum(map(len, words.values())) + 2 * 3  # three copies of one row
    assert abs(sum(r["words"] for r in got) - whole) <= 6


def test_empty_and_wordless_tables(spark):
    for docs in ([], [(1, None, None, 0, ""), (2, " ", "a", 0, "")]):
        placed, pieces = mix(spark.createDataFrame(docs, DOCS))
        assert placed.count() == len(docs)
        assert pieces.count() == 0
        assert all(r["target"] == 0 for r in placed.collect())
