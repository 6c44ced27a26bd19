import random
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from test_queries import brute_statistics, held, lowered, words_of
from test_substring_chat import brute_spans
from tokenizers import Tokenizer

import corpus_pipeline
from tabulon.llm import rules
from tabulon.llm.packing import cut_pieces
from tabulon.llm.text import text_key
from tabulon.llm.tokens import ByteBPE, default_vocabulary

SMALL = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = docs, {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and len(left) == docs.count() and set(left) <= set(rows)
        if name != "substring_dedup":
            assert all(rows[i] == t for i, t in left.items())
        if name == "exact_dedup":
            assert len({t.lower() for t in left.values()}) == len(left) and {t.lower() for t in rows.values()} == {t.lower() for t in left.values()}
    assert before is not None
    own, want = ByteBPE.at(default_vocabulary()), Counter()
    for i, text in left.items():
        for k, piece in enumerate(cut_pieces(len(own.encode(text)) // 4 + 1, 2048)):
            want[i, k, *piece] += 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in packed) == want


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]


def corpus():
    draw = random.Random(21)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(900)]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    passage, line = some(64), " ".join(some(24))
    rows = []
    for i in range(120):
        words = some(draw.randint(60, 200))
        if i % 3 == 0:
            words = [w + "%%" for w in words]
        if i % 7 == 1:
            words[20:20] = passage
        text = " ".join(words)
        rows.append((i, f"{line}\n{text}" if i % 11 == 1 else text))
    for k, i in enumerate((1, 2, 4, 5, 7)):  # exact copies, some in capitals, and near copies of them
        rows += [(200 + k, rows[i][1].upper()), (210 + k, rows[i][1] + " " + draw.choice(vocabulary)), (220 + k, draw.choice(vocabulary) + " " + rows[i][1])]
    return [*rows, (300, None), (301, ""), (302, " \n "), (303, "w" * 10**6), (None, rows[4][1]), (None, " ".join(some(80))), (8, " ".join(some(90))), (8, rows[8][1])]


def brute_pipeline(rows, learned):
    kept = []
    for i, t in rows:
        counts, features = brute_statistics(t)
        rejected = any(all(c.holds(features[rules.FEATURES.index(c.feature)]) for c in rule) for rule in learned)
        if not (counts[0] < 20 or 100 * counts[4] > 30 * counts[0] or rejected):
            kept.append((i, t))
    yield kept
    null_last = lambda i: -1 if i is None else i
    best = {}
    for i, t in kept:
        best[lowered(t)] = max(best.get(lowered(t), -2), null_last(i))
    exact = list(dict.fromkeys((i, t) for i, t in kept if best[lowered(t)] == null_last(i)))
    yield exact
    sets = []
    for _, t in exact:
        words = words_of(lowered(t))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))})
    label = list(range(len(exact)))
    for a in range(len(exact)):
        for b in range(a):
            share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert share < 0.7 or share > 0.9  # nothing near the threshold, where the search may miss a pair
            if share >= 0.8:
                label = [label[b] if x == label[a] else x for x in label]
    least = {}
    for (i, _), c in zip(exact, label, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    near = [(i, t) for (i, t), c in zip(exact, label, strict=True) if i is None or i == least[c]]
    yield near
    marked = brute_spans([r for r in near if r[0] is not None], 50, 36, 5)
    yield [(i, "".join(c for k, c in enumerate(t) if k not in marked.get(i, ()))) for i, t in near]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    labels = [(i, int(i % 3 != 0), 0) for i in range(120)]
    kind = "doc_id bigint, text string, digest string, n_chars bigint, kept string"
    spark.createDataFrame([(i, t, "d", len(t or ""), "k") for i, t in rows], kind).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sample = sorted((brute_statistics(t)[1], y) for j, y, _ in labels if not held(j) for i, t in rows if i == j)
    learned = rules.learn(np.array([x for x, _ in sample]), np.array([y for _, y in sample]) == 1)
    docs, steps = spark.read.parquet(str(tmp_path / "documents.parquet")), brute_pipeline(rows, learned)
    for (name, stage), want in zip(corpus_pipeline.STAGES, steps, strict=False):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        assert docs.columns == before.columns and Counter((r["doc_id"], r["text"]) for r in got) == Counter(want), name
        assert all(r["n_chars"] == len(r["text"]) and (r["digest"], r["kept"]) == ("d", "k") for r in got)
    own, want = ByteBPE.at(default_vocabulary()), Counter()
    for r in got:
        for k, piece in enumerate(cut_pieces(len(own.encode(r["text"])) // 4 + 1, 2048)):
            want[r["doc_id"], k, *piece] += 1
    run = str(tmp_path / "run")
    result = corpus_pipeline.run(spark, str(tmp_path), run).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in result) == want
    assert len({r["sequence_id"] for r in result}) == -(-sum(r["length"] for r in result) // 2048)
    rebuilt(spark, run, result)


def rebuilt(spark, run, result):
    """Every sequence can be built from the run's own folders: its ids are those of its documents' texts, repeated and null ids included."""
    assert sorted(p.name for p in Path(run).iterdir()) == ["best_fit_packing", "substring_dedup"]
    texts = {(r["doc_id"], r["key"]): r["text"] for r in spark.read.parquet(f"{run}/substring_dedup").withColumn("key", text_key(F.col("text"))).collect()}
    assert None in {i for i, _ in texts} and len({i for i, _ in texts}) < len(texts)
    library = Tokenizer.from_file(default_vocabulary())
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    got, seen = corpus_pipeline.training_sequences(spark, run).collect(), Counter()
    assert {r["sequence_id"] for r in got} == {r["sequence_id"] for r in result}
    places = {(r["doc_id"], r["text_key"], r["piece"], r["sequence_id"], r["offset"]): r for r in result}
    for r in got:
        want = []
        for d in r["documents"]:
            place = places[d["doc_id"], d["text_key"], d["piece"], r["sequence_id"], d["offset"]]
            assert d["offset"] == len(want)
            want += ids[d["doc_id"], d["text_key"]][place["start"] : place["start"] + place["length"]]
            seen[d["doc_id"], d["text_key"]] += place["length"]
        assert r["input_ids"] == want and len(want) <= 2048
    assert all(seen[k] % len(x) == 0 and seen[k] for k, x in ids.items())


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []
