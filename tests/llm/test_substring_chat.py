import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tabulon.llm import chat, substring

DRAW = random.Random(7)


def words(n):
    return ["".join(DRAW.choice("abcdeé") for _ in range(DRAW.randint(2, 7))) for _ in range(n)]


def test_shared_passages_go_from_later_documents(spark):
    passage, line = words(55), " ".join(words(25))
    one, two = words(80), words(90)
    rows = [
        (1, " ".join(one[:40] + passage + one[40:])),
        (2, "start  " + " ".join(two[:10]) + "\n" + "\t".join(w.upper() if w.isascii() else w for w in passage) + " " + " ".join(two[10:])),
        (3, f"first\n{line}\nlast"),
        (4, f"{line.upper() if line.isascii() else line}"),
        (5, f"x\n{line}\n{line}\ny"),
        (6, None),
        (7, ""),
        (None, " ".join(passage)),
        (8, " ".join(words(70))),
        (9, " ".join(["again"] * 200)),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_chars int, digest string")
    spans = {}
    for r in substring.repeated_spans(df).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["first_doc_id"]))
    texts = dict(rows)
    assert set(spans) == {2, 4, 5}
    cut_away = " ".join(texts[2][a:b] for a, b, _ in spans[2]).lower().split()
    assert len(cut_away) >= 36 and all(w.lower() in passage for w in cut_away) and {f for *_, f in spans[2]} == {1}
    out = substring.drop_repeats(df)
    after = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == df.columns and out.count() == len(rows)
    assert after[5]["text"] == "x\ny" and after[4]["text"] == "" and after[4]["n_chars"] == 0
    assert all(after[i]["text"] == texts[i] for i in (1, 3, 6, 7, None, 8, 9))
    assert substring.drop_repeats(df.limit(0)).count() == 0


def test_no_run_of_the_guaranteed_length_stays(spark):
    pool = [words(50) for _ in range(6)]
    rows = []
    for i in range(40):
        body = words(DRAW.randint(0, 120))
        at = DRAW.randint(0, len(body))
        rows.append((i, " ".join(body[:at] + DRAW.choice(pool) + body[at:])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    seen = {}
    for r in substring.drop_repeats(df).collect():
        own = r["text"].split()
        for j in range(len(own) - 49):
            assert seen.setdefault(tuple(own[j : j + 50]), r["doc_id"]) == r["doc_id"]


def test_no_repeated_line_of_five_words_stays(spark):
    """Over a given table: of lines of five words or more only the earliest is left untouched, and every repeated one is covered whole."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spans = {}
    for r in substring.repeated_spans(docs).collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    seen, repeated = set(), 0
    for i, text in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        at = 0
        for line in text.split("\n"):
            own = re.findall(r"[^\x20\x09-\x0D]+", line)
            if len(own) >= 5:
                if (key := tuple(low_line(own))) in seen:
                    repeated += 1
                    assert any(a <= at and at + len(line) <= b for a, b in spans.get(i, ()))
                seen.add(key)
            at += len(line) + 1
    assert repeated > 20


def test_cutting_spans(spark):
    df = spark.createDataFrame([("abcdéfgh", [0, 2, 4, 5]), ("ab", [0, 2]), ("kept", None), (None, [0, 1]), ("😀é end", [1, 3])], "t string, s array<int>")
    assert [r[0] for r in df.select(substring.without(F.col("t"), F.col("s"))).collect()] == ["cdfgh", "", None, None, "😀end"]


def test_rows_that_share_an_id_keep_their_own_text(spark):
    passage, other = words(60), " ".join(words(90))
    repeat = "start of it " + " ".join(passage) + " and its end"
    rows = [(1, " ".join(passage)), (5, repeat), (5, other), (7, other.upper() if other.isascii() else other), (7, "tail")]
    out = sorted(tuple(r) for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert len(out) == 5 and (5, other) in out and (1, rows[0][1]) in out and (7, "tail") in out
    assert [t for i, t in out if i == 5 and t not in (other, repeat)] and (5, repeat) not in out and (7, "") in out
    twice = [(3, repeat), (3, repeat), (1, " ".join(passage)), (1, " ".join(passage))]
    again = sorted(tuple(r) for r in substring.drop_repeats(spark.createDataFrame(twice, "doc_id bigint, text string")).collect())
    assert again[:2] == twice[2:] and again[2] == again[3] != twice[0]


def brute_spans(rows, passage, span, line_words):
    """The units of every text by plain loops, and what of them an earlier text or line has."""
    units = []  # (what, document, start, end, is it a line)
    mask = (1 << 64) - 1
    for doc, text in rows:
        found = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for _, _, w in found]
        hashes = [xxhash.xxh3_64_intdigest(w.encode()) for w in low]
        runs = []
        for k in range(len(low) - span + 1):
            h = 0
            for x in hashes[k : k + span]:
                h = (h * 0x9E3779B97F4A7C15 + x) & mask
            h = ((h ^ (h >> 32)) * 0x9E3779B97F4A7C15) & mask
            runs.append(h ^ (h >> 29))
        width, chosen = passage - span + 1, set()
        for k in range(len(runs)):  # windows over either end of a text hold what there is
            if any(runs[k] == min(runs[max(0, a) : a + width]) for a in range(k - width + 1, k + 1)):
                chosen.add(k)
        units += [(tuple(low[k : k + span]), doc, found[k][0], found[k + span - 1][1], False) for k in chosen]
        at = 0
        for line in (text or "").split("\n"):
            own = re.findall(r"[^\x20\x09-\x0D]+", line)
            if len(own) >= line_words:
                units.append((("line", *low_line(own)), doc, at, min(at + len(line) + 1, len(text)), True))
            at += len(line) + 1
    first = {}
    for what, doc, start, _, _ in units:
        first[what] = min(first.get(what, (doc, start)), (doc, start))
    marked = {}
    for what, doc, start, end, line in units:
        if doc > first[what][0] or line and doc == first[what][0] and start > first[what][1]:
            marked.setdefault(doc, set()).update(range(start, end))
    return marked


def low_line(own):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in own]


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_brute_force(spark, tmp_path, seed):
    draw = random.Random(seed)
    pool = [words(draw.randint(30, 70)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "\n" * 1000)]
    for i in range(4, 40):
        parts = []
        for _ in range(draw.randint(1, 4)):
            parts += [draw.choice([" ", "\n", "  ", "\t"]).join(draw.choice([words(draw.randint(1, 40)), draw.choice(pool)])), draw.choice(["\n", " ", "\n\n"])]
        rows.append((i, "".join(parts)))
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id bigint, text string, text_key string, start int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in substring.op3_substring(spark, str(tmp_path)).collect():
        here = set(range(r["start"], r["end"]))
        assert not here & got.setdefault(r["doc_id"], set())
        got[r["doc_id"]] |= here
    assert got == brute_spans(rows, 50, 36, 5) and got


@pytest.mark.parametrize("text", [" " * 10**6, "w" * 10**6, "\n" * 10**6, "a b\n" * 250_000])
def test_very_long_texts(spark, text):
    tail = " ".join(words(60))
    rows = [(1, tail), (2, text + "\nq " + tail + " z"), (3, text)]
    got = {r["doc_id"]: r["text"] for r in substring.drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == tail and got[2].startswith(text + "\nq") and got[2].endswith(" z") and len(got[2]) < len(rows[1][1])
    assert got[3] == text if len(text.split()) < 50 else len(got[3]) < 50


CONVERSATIONS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hello"), (0, 2, "user", "more"), (0, 3, "assistant", "yes"),
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "less"), (1, 3, "assistant", "nö"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"),
    (4, 0, None, None), (4, 0, None, None), (None, 0, "user", "lost"),
]


def test_preference_pairs(spark):
    df = spark.createDataFrame([(*r, "x") for r in CONVERSATIONS], "conv_id bigint, turn bigint, role string, text string, pair_id string")
    got = {r["pair_id"]: r for r in chat.format_pairs(chat.pair_conversations(df)).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0]["n_prefix"] == 2 and got[0]["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n"
    learned = [got[0][f"{side}_spans"] for side in ("chosen", "rejected")]
    assert [got[0][side][a:b] for side, spans in zip(("chosen", "rejected"), learned, strict=True) for a, b in spans] == ["yes<|end|>", "nö<|end|>"]
    assert (got[1]["n_prefix"], got[1]["chosen"], got[1]["rejected"], got[1]["chosen_spans"]) == (2, "", "", [])
    assert (got[2]["n_prefix"], got[2]["rejected"]) == (0, "") and got[2]["chosen"] == "<|user|>\n<|end|>\n" * 2
    assert chat.format_pairs(chat.pair_conversations(df.limit(0))).count() == 0


def test_very_long_turns(spark):
    long = "é" * 10**6 + "\n" * 10**6
    rows = [(0, 0, "user", long), (1, 0, "user", long), (0, 1, "assistant", " " * 10**6), (1, 1, "assistant", "short")]
    got = chat.format_pairs(chat.pair_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert len(got) == 1 and got[0]["n_prefix"] == 1 and long in got[0]["prompt"] and " " * 10**6 in got[0]["chosen"]


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001"])
def test_chat_against_sql(spark, table):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{table}/conversations.parquet'")
    got = chat.op4_chat(spark, table)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({chat.OP4_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
