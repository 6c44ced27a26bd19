import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabulon.llm.importance import drawn, feature_buckets, resample

DOCS = "doc_id long, text string, n_features string, copies int"


def features(text, longest=1):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, buckets=10_000, longest=1, least=20, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    for counts, texts in ((s, [r[1] for r in docs]), (t, target)):
        for text in texts:
            for f in features(text, longest):
                counts[bucket(f)] += 1
    gains = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text, *_ in docs:
        fs = features(text, longest)
        weight = sum(gains[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(order, 1):
        r.append(place if place <= percent * len(order) // 100 else None)
    return sorted(map(str, (r if len(r) == 5 else [*r, None] for r in out)))


def rows():
    some = ["Das Haus Über dem Fluss 12-34", "the cat sat on the mat", "naïve café n°5 x_y [z]", "Ünïcode ÄÖÜ ÀB ab", "\x7f\x00@`{a}"]
    out = [(i, " ".join(some[(i + k) % 5] for k in range(i % 13)), "clash", 1) for i in range(200)]
    out += [(500 + i, "copied words of a text " * 6, None, 2) for i in range(300)] + [(900, None, "", 0), (901, "", "", 0), (902, "...", "", 0), (None, "the cat " * 30, "", 0)]
    return [*out, (903, "long " * 20_000, "", 0), (3, "the cat sat again " * 9, "", 0), (3, "the cat sat again " * 9, "", 0)]


@pytest.mark.parametrize("options", [{}, {"percent": 50, "buckets": 97, "longest": 3, "least_features": 5, "seed": 1}, {"percent": 100, "least_features": 0}])
def test_resample_equals_brute_force(spark, options):
    target = ["The cat sat on a mat", None, "", "Haus am Fluss", "Haus am Fluss"]
    given = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, doc_id int")
    got = sorted(str(list(r)) for r in resample(spark.createDataFrame(rows(), DOCS), given, **options).collect())
    named = {"least": options.get("least_features", 20)} | {k: v for k, v in options.items() if k != "least_features"}
    assert got == brute(rows(), target, **named)


def test_features_of_words(spark):
    texts = [t for _, t, *_ in rows()]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", feature_buckets(F.col("text"), 10_000, 2).alias("b")).collect()
    for r in got:
        assert r["b"] == [zlib.crc32(f.encode()) % 10_000 for f in features(r["text"], 2)]


def test_ties_go_to_the_smaller_id(spark):
    scored = spark.createDataFrame([(i, 30, 0, 7 if i % 2 else 9) for i in range(20)] + [(None, 30, 0, 9), (99, 1, 0, 100)], "doc_id long, n_features long, weight long, score long")
    got = {r["doc_id"]: r["rank"] for r in drawn(scored, 60, 20).collect()}
    assert [got[i] for i in range(0, 20, 2)] == list(range(1, 11))
    assert got[None] == 11
    assert got[1] == 12
    assert got[99] is None
    assert sum(r is not None for r in got.values()) == 12


def test_empty_tables(spark):
    empty, texts = spark.createDataFrame([], DOCS), spark.createDataFrame([("a b c",)], "text string")
    assert resample(empty, texts).count() == 0
    got = resample(spark.createDataFrame(rows(), DOCS), spark.createDataFrame([], "text string")).collect()
    assert sorted(str(list(r)) for r in got) == brute(rows(), [])
