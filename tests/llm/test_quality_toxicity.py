import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabulon.llm import ensemble, rules, toxicity
from tabulon.llm.statistics import COUNTS, with_statistics

TEXTS = [None, "", "   ", "one two", "a b c d e f g h " * 3, "x " * 9, "line with words\nline with words\n\n \nother", "# $ % a|b <c>", "a b c d e f g h 1 a b c d e f g h", "\x0btab words\x0c\r\n é É", "w" * 5000 + " end", " ".join(str(i % 50) for i in range(3000))]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force_and_clashing_columns_go(spark):
    df = spark.createDataFrame([(i, t, 1.5, "kept") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, n_words double, other string")
    out = with_statistics(df)
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in out.collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert "other" in out.columns and with_statistics(df.limit(0), shares=False).count() == 0


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def corpus(spark):
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 0
        words = [f"word{(i * 7 + k * k) % 97}{'' if k % 3 else 'x' * (k % 5)}" for k in range(30 + i % 40)]
        if bad:
            words = [w + "%%%" for w in words]
        if toxic:
            words[len(words) // 2] = "dreadful"
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None, None), (1001, "", "s"), (None, "x y", None), (4, "repeated id", "s")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string"), spark.createDataFrame([*labels, (1000, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_decision_list(spark, corpus):
    docs, labels = corpus
    out = {r["doc_id"]: r for r in rules.apply_rules(docs, labels).filter("doc_id >= 5").collect()}
    assert all(out[i]["kept"] == (i % 4 != 0) for i in range(5, 400))
    assert out[1000]["base_failed"] and not out[1000]["kept"]
    kept = rules.keep_by_rules(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 300
    assert rules.apply_rules(docs.limit(0), labels).count() == 0
    assert rules.apply_rules(docs, labels.limit(0)).filter("kept").count() == 400


def test_list_of_one_class_is_empty():
    assert rules.learn(np.zeros((5, 2)), np.ones(5, bool), ("a", "b")) == [] and rules.learn(np.zeros((0, 2)), np.zeros(0, bool), ("a", "b")) == []


def test_rule_ensemble(corpus):
    docs, labels = corpus
    out = {r["doc_id"]: r for r in ensemble.score_quality(docs, labels).filter("doc_id >= 5").collect()}
    assert all(out[i]["predicted"] == int(i % 4 != 0) and out[i]["held_out"] == held(i) and 0 <= out[i]["score"] <= 1 for i in range(5, 400))
    assert 0 <= out[1000]["score"] <= 1
    assert ensemble.score_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_lasso_drops_idle_rules():
    draw = np.random.default_rng(0)
    r = (draw.random((400, 12)) < 0.5).astype(float)
    _, w = ensemble.lasso(r, r[:, 3], 0.02)
    assert w[3] > 1 and np.abs(np.delete(w, 3)).max() < 0.05


def test_toxicity(corpus):
    docs, labels = corpus
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).filter("doc_id >= 5").collect()}
    assert all(out[i]["predicted"] == int(i % 5 == 0) and out[i]["held_out"] == held(i) for i in range(5, 400))
    assert out[1000]["score"] == out[1001]["score"]
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_long_texts_are_scored_over_block_borders(monkeypatch):
    model = toxicity.fit(["plain words", "dreadful thing"] * 40, np.array([0, 1] * 40), least=1.0)
    texts = ["plain " * 30 + "dreadful thing " + "words " * 30, "plain words " * 40]
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity, "_BLOCK", 16)
    assert np.allclose(model.scores(texts), whole) and whole[0] > 0.7 > whole[1]
