import random
import re

import numpy as np
import pytest
import xxhash

from tabulon.llm import simhash
from tabulon.llm.components import connected_components


def brute_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, distance):
    parent = {i: i for i, _ in items}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in items:
        for j, b in items:
            if (a ^ b).bit_count() <= distance:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in items}


@pytest.mark.parametrize("text", [None, "", "  ", "one", "Two WORDS", "a b c d", "a b c d e f a b c d e", "É é É é x", "w " * 70000, " vertical\x0btab\x0cfeed"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_print(text)


@pytest.mark.parametrize(("distance", "segments"), [(4, 3), (4, 2), (11, 6), (11, 4), (3, 3), (5, 2), (0, 3)])
def test_plan_misses_no_pair(distance, segments):
    plan, draw = simhash.segment_plan(distance, segments), np.random.default_rng(0)
    for _ in range(2000):
        x = sum(1 << int(b) for b in draw.choice(64, draw.integers(0, distance + 1), replace=False))
        assert any((x >> s & ((1 << w) - 1)).bit_count() <= r for s, w, r in plan)


@pytest.mark.parametrize("dense_rows", [131072, 12])
@pytest.mark.parametrize(("distance", "segments"), [(4, 3), (4, 2), (11, 6)])
def test_groups_equal_brute_force(spark, dense_rows, distance, segments):
    draw = random.Random(distance)
    centres = [draw.getrandbits(64) for _ in range(4)]
    prints = {draw.getrandbits(64) for _ in range(40)}
    for c in centres:
        for _ in range(25):
            prints.add(c ^ sum(1 << draw.randrange(64) for _ in range(1)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    signed = {fp - (1 << 64) if fp >> 63 else fp: fp for fp in prints}
    frame = spark.createDataFrame([(fp,) for fp in signed], "fp bigint")
    got = {r["fp"]: r["label"] for r in simhash.near_groups(frame, distance, segments, dense_rows).collect()}
    want = brute_components(list(signed.items()), distance)
    assert {i: got.get(i, i) for i in signed} == want


def test_documents_null_empty_repeated(spark):
    base = [f"w{i}" for i in range(300)]
    near = base[:150] + ["other"] + base[151:]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, None), (7, ""), (7, ""), (11, "alone in the world"), (None, "alone in the world"), (12, " ".join(base).upper())]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, component_id string")
    got = sorted(((r["doc_id"] or -1), r["component_id"]) for r in simhash.simhash_components(df).collect())
    linked = (brute_print(" ".join(base)) ^ brute_print(" ".join(near))).bit_count() <= 4
    assert got == sorted([(5, 3 if linked else 5), (3, 3), (9, 7), (7, 7), (7, 7), (11, 11), (-1, 11), (12, 3 if linked else 5)])
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {3, 7, 11, None}
    assert simhash.simhash_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("local_edges", [1 << 19, 30])
def test_components_of_paths_and_stars(spark, local_edges):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (None, 5)] + [(400 + i, 400 + j) for i in range(12) for j in range(i)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), local_edges=local_edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300} | {400 + i: 400 for i in range(12)}


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def family(draw, tag, size=150, copies=20, most=5):
    base, texts = [f"{tag}w{draw.randrange(4000)}" for _ in range(size)], []
    for _ in range(copies):
        words = list(base)
        for at in draw.sample(range(size), draw.randrange(0, most + 1)):
            words[at] = f"x{draw.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def pair_links(texts, least=0.8):
    sets = [shingles(t) for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


def grouped(n, links):
    label = list(range(n))
    for _ in range(n):
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return label
    return label


@pytest.mark.parametrize(("block", "dense"), [(1 << 17, 131072), (600, 131072), (1 << 17, 12), (600, 12)])
def test_near_copies_are_verified_by_words(spark, block, dense):
    draw = random.Random(8)
    texts = [t for f in range(5) for t in family(draw, f, most=6)]
    links = pair_links(texts)
    assert 100 < len(links) < 5 * 190  # some pairs of a family are linked, others are not
    got = simhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), recall=0.9999, distance=40, block=block, dense_rows=dense).collect()
    assert [r["component_id"] for r in sorted(got)] == grouped(len(texts), links)


def test_recall_at_the_threshold(spark):
    """Pairs of a similarity just above the threshold, each pair by itself."""
    draw, texts = random.Random(5), []
    for f in range(400):
        base = [f"{f}w{draw.randrange(9000)}" for _ in range(200)]
        other = list(base)
        for at in draw.sample(range(200), 4):
            other[at] = "y"
        texts += [" ".join(base), " ".join(other)]
    sets = [shingles(t) for t in texts]
    near = [k for k in range(0, 800, 2) if 0.8 <= len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) < 0.86]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert len(near) > 150 and sum(got[k + 1] == k for k in near) >= 0.9 * len(near)
    assert all(got[k] == k for k in range(0, 800, 2))


def test_near_copies_null_empty_short(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(1, "one two"), (2, "ONE  two"), (3, "one two three"), (4, None), (5, ""), (None, "one two"), (6, long), (7, long + " end"), (8, "é É"), (2, "ONE  two")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, component_id string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_components(df).collect())
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (-1, 1), (6, 6), (7, 6), (8, 8), (2, 1)])
    assert simhash.near_components(df.limit(0)).count() == 0


def test_one_text_of_a_repeated_id_goes(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:299], "other"])), (2, " ".join(reversed(base)))]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in kept) == sorted([rows[0], rows[2]])
