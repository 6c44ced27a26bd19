"""Every registered query over one table of ordinary and odd rows, held against plain Python."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from test_audit import brute as brute_audit
from test_importance import brute as brute_importance
from tokenizers import Tokenizer

from tabulon.llm import ensemble, queries, rules, toxicity
from tabulon.llm.audit import EDGE_COUNTS
from tabulon.llm.packing import cut_pieces
from tabulon.llm.tokens import default_vocabulary

BLANK = r"\x20\x09-\x0D"
ODD = [None, None, "", "", "  ", "one", "Two WORDS", "É é É é", " " * 10**6, "w" * 10**6, "\n" * 10**6, "<|endoftext|>", "naïve 😀 中文 ½"]


def words_of(text):
    return re.findall(f"[^{BLANK}]+", text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(600)]
    out = []
    for i in range(240):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(25, 160))]
        if i % 4 == 0:
            words = [w + draw.choice(["%%", "#", ""]) for w in words]
        if i % 5 == 0:
            words[len(words) // 2] = "dreadful"
        if i % 9 == 0:
            words[5:5] = words[20:30] * 3
        out.append((i, draw.choice([" ", "\n"]).join(words)))
    for i in range(240, 260):  # exact and near copies
        text = out[i - 240][1]
        out.append((i, text.upper() if i % 2 else text + " " + draw.choice(vocabulary)))
    out += [(300 + k, t) for k, t in enumerate(ODD)] + [(7, out[8][1]), (7, out[7][1]), (None, "lost row"), (None, out[3][1])]
    return out


@pytest.fixture(scope="module")
def labelled(rows):
    return [(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(240)] + [(300, 0, 0), (999, 1, 1), (None, 1, 1), (12, None, None)]


BENCHMARK = ["Some words of a Target text", None, "", "words again, words again"]


@pytest.fixture(scope="module")
def results(spark, rows, labelled, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    clash = "digest string, kept string, score string, shard string, component_id string, length string, n_words string"
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcdefg") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + clash)
    frame.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(t,) for t in BENCHMARK], "text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(0, 0, "user", "a"), (1, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{where}/conversations.parquet")
    found = {}

    def run(name):
        if name not in found:
            out = queries.queries()[name](spark, where)
            found[name] = out.columns, dict(out.dtypes), [tuple(r) for r in out.collect()]
        return found[name]

    return run


def test_op1(results, rows):
    columns, kinds, got = results("op1_exact_dedup")
    assert columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and kinds["group_size"] == "bigint" and kinds["kept"] == "boolean"
    want, same = Counter(), {}
    digests = [hashlib.sha256(lowered(t).encode()).hexdigest() for _, t in rows]
    for (i, _), h in zip(rows, digests, strict=True):
        same.setdefault(h, []).append(i)
    for (i, _), h in zip(rows, digests, strict=True):
        keep = max((j for j in same[h] if j is not None), default=None)
        want[i, keep, len(same[h]), i == keep, h] += 1
    assert Counter(r[:5] for r in got) == want


def brute_statistics(text):
    words = words_of(text)
    text = text or ""
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    repeated = len({j for k, w in enumerate(windows) if often[w] > 1 for j in range(k, k + 8)})
    lines = [x for x in text.split("\n") if re.search(f"[^{BLANK}]", x)]
    chars, symbols, duplicates = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    over = lambda a, b: a / b if b else 0.0
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    counts = len(words), chars, symbols, duplicates, repeated
    features = (len(words), len(lines), over(chars, len(words)), over(symbols, chars), over(duplicates, len(lines)), over(repeated, len(words)), over(upper, chars), over(len(re.findall("[0-9]", text)), chars), over(len(re.findall("[!?]", text)), chars), over(len(set(words)), len(words)), over(len(words), len(lines)))
    return counts, [float(x) for x in features]


@pytest.fixture(scope="module")
def statistics(rows):
    return [brute_statistics(t) for _, t in rows]


def drawn(rows, labelled, place, value):
    """What may be learned from: a row for every label that is known and not held out."""
    return [(value(k), own[place]) for own in labelled if own[place] is not None and not held(own[0]) for k, (i, _) in enumerate(rows) if i == own[0]]


def test_op2(results, rows, labelled, statistics):
    columns, kinds, got = results("op2_quality")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and kinds["score"] == "double" and kinds["predicted"] == "int"
    sample = sorted((statistics[k][1], y) for k, y in drawn(rows, labelled, 1, lambda k: k))
    model = ensemble.fit(np.array([x for x, _ in sample]), np.array([y for _, y in sample]))
    want = []
    for (i, _), (_, features) in zip(rows, statistics, strict=True):
        margin = model.bias + sum(w for rule, w in model.weighted if all(c.holds(features[rules.FEATURES.index(c.feature)]) for c in rule))
        want.append((i, held(i), 1 / (1 + np.exp(-margin))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    assert all(r[3] == int(r[2] >= 0.5) for r in got)
    unseen = [(r[3], int(r[0] % 4 != 0)) for r in got if r[0] is not None and r[0] < 240 and r[0] != 7 and r[1]]
    assert np.mean([a == b for a, b in unseen]) > 0.95


def test_op7(results, rows, labelled, statistics):
    columns, kinds, got = results("op7_quality_rules")
    assert columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] and kinds["n_words"] == "bigint"
    sample = sorted((statistics[k][1], y) for k, y in drawn(rows, labelled, 1, lambda k: k))
    learned = rules.learn(np.array([x for x, _ in sample]), np.array([y for _, y in sample]) == 1)
    want = Counter()
    for (i, _), (counts, features) in zip(rows, statistics, strict=True):
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        rejected = any(all(c.holds(features[rules.FEATURES.index(c.feature)]) for c in rule) for rule in learned)
        want[i, *counts, failed, not failed and not rejected] += 1
    assert Counter(got) == want and learned


def test_op3_spans_lie_within_texts(results, rows):
    _, _, got = results("op3_substring")
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(" ".join(lowered(t).split()))
    assert got and len(got) == len(set(got))
    for i, _, start, end, first in got:
        assert 0 <= start < end and any(len(u or "") >= end for j, u in rows if j == i) and (first < i or first == i)


def test_op4(results):
    assert len(results("op4_chat")[2]) == 1


def test_op5(results, rows):
    _, _, got = results("op5_pieces")
    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "")
        text = library.decode(ids)
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(text.encode()), text == (t or "")] += 1
    assert Counter(got) == want


def test_op6(results, rows):
    columns, kinds, got = results("op6_simhash")
    assert columns[:3] == ["doc_id", "fingerprint", "component_id"] and kinds["component_id"] == "bigint"
    prints = []
    for _, t in rows:
        words = words_of(lowered(t))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        before = list(label)
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    assert Counter(got) == Counter((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, label, strict=True))


def test_op8(results, rows):
    columns, kinds, got = results("op8_packing")
    assert columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and kinds["piece"] == "int" and kinds["offset"] == "bigint"
    library = Tokenizer.from_file(default_vocabulary())
    library.encode_special_tokens = True
    want, total = Counter(), 0
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k, (start, length) in enumerate(cut_pieces(len(ids), 2048)):
            want[i, k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert Counter(r[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-total // 2048)


def test_op9(results, rows, labelled):
    columns, kinds, got = results("op9_toxicity")
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"] and kinds["predicted"] == "int"
    sample = sorted((t or "", y) for t, y in drawn(rows, labelled, 2, lambda k: rows[k][1]))
    model = toxicity.fit([t for t, _ in sample], np.array([y for _, y in sample], float))
    mask, want = (1 << 64) - 1, []
    for i, t in rows:
        points, found = [ord(c) for c in f" {(t or '').lower()} "], set()
        if len(points) > 100_000:
            found = None  # the same sum, without a Python loop over a million characters
        else:
            for k in range(len(points)):
                for n in model.orders:
                    if k + n <= len(points):
                        h = 0
                        for x in points[k : k + n]:
                            h = (h * 0x9E3779B97F4A7C15 + x + 1) & mask
                        found.add((((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask) >> (64 - model.bits))
        margin = model.margins([t])[0] if found is None else model.bias + sum(float(model.weights[f]) for f in found)
        want.append((i, held(i), 1 / (1 + np.exp(-margin))))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-5)
    assert all(r[3] == int(r[2] >= 0.7) for r in got)
    unseen = [(r[3], int(r[0] % 5 == 0)) for r in got if r[0] is not None and r[0] < 240 and r[0] != 7 and r[1]]
    assert np.mean([a == b for a, b in unseen]) > 0.95


def test_op10(results, rows):
    columns, kinds, got = results("op10_shards")
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and kinds["slot"] == "bigint" and kinds["shard"] == "int"
    null_first = lambda x: (x is not None, x or 0)
    ordered = sorted(rows, key=lambda r: (null_first(r[0]), null_first(None if r[1] is None else zlib.crc32(r[1].encode()))))
    order = np.random.default_rng([0, 0]).permutation(len(rows))  # one bucket holds them all
    starts, want = [len(rows) * s // 8 for s in range(9)], Counter()
    for place, k in enumerate(order):
        i, t = ordered[k]
        shard = max(s for s in range(8) if starts[s] <= place)
        want[i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", shard, place - starts[shard], None] += 1
    assert Counter(r[:7] for r in got) == want


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    for table, kind in {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string", "conversations": "conv_id bigint, turn bigint, role string, text string"}.items():
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).collect() == []


def test_op11(results, rows, labelled):
    columns, kinds, got = results("op11_filter_audit")
    assert columns == ["part", "filter_order", "step", *EDGE_COUNTS, "shapley"] and kinds["step"] == "int" and {kinds[c] for c in columns[3:]} == {"bigint"}
    assert {r[:3]: list(r[3:]) for r in got} == brute_audit([(i, t, "en") for i, t in rows], labelled) and len(got) == 600


def test_op12(results, rows):
    columns, kinds, got = results("op12_mixing")
    assert columns == ["doc_id", "size", "source_size", "target", "taken"] and kinds["target"] == "double" and kinds["taken"] == "bigint"
    whole = sum(len(words_of(t)) for _, t in rows)
    assert Counter(r[:4] for r in got) == Counter((i, len(words_of(t)), whole, float(whole)) for i, t in rows)  # one source gets all there is
    assert all(r[4] == r[1] for r in got)


def test_op13(results, rows):
    columns, kinds, got = results("op13_importance")
    assert columns == ["doc_id", "n_features", "weight", "score", "rank"] and set(kinds.values()) == {"bigint"}
    assert sorted(str(list(r)) for r in got) == brute_importance(rows, BENCHMARK)
