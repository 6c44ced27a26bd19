import re
from collections import Counter
from itertools import permutations

import pytest

from tabulon.llm.audit import EDGE_COUNTS, audit, edges, flagged_documents, profiles

DOCS = "doc_id long, text string, lang string, n int, first string"
LONG = " ".join(f"w{i}" for i in range(220))
TEXTS = [None, "", LONG, LONG + " #", LONG.upper(), " ".join(["a", "b"] * 150), "Same Same", "Same Same", LONG, "é " * 210, "A" * 5000, "x y " * 199 + "z"]


def rows():
    out = [(i, t, [None, "en", "fr", ""][i % 4], i, "clash") for i, t in enumerate(TEXTS)]
    out += [(i + 20, t, "en", 0, None) for i, t in enumerate(TEXTS)] + [(100 + i, "Same Same", "en", 0, "c") for i in range(40)]
    return out + [(2, LONG, "de", 0, "twice"), (None, LONG, "fr", 0, None), (None, "Same Same", None, 0, None)]


def brute(docs, labels):
    out = {}
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    flagged = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        flagged.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    for part in {p for p, *_ in flagged}:
        removed = Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                c = Counter()
                for p, failed, g, x in flagged:
                    if p != part:
                        continue
                    before, mine = failed & set(order[: step - 1]), f in failed
                    c["kept"] += not before and not mine
                    c["removed"] += mine and not before
                    c["redundant"] += mine and bool(before)
                    c["unique_fails"] += failed == {f}
                    c["good_lost"] += mine and not before and g
                    c["toxic_lost"] += mine and not before and x
                removed[f] += c["removed"]
                out[part, "".join(order), step] = [c[k] for k in EDGE_COUNTS]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed[order[step - 1]])
    return out


def test_audit_equals_brute_force(spark):
    labels = [(0, 1, 0), (2, 1, None), (2, 0, 1), (22, None, 1), (105, 1, 1), (None, 1, 1), (7, 0, 0)]
    flagged = flagged_documents(spark.createDataFrame(rows(), DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): [r[k] for k in (*EDGE_COUNTS, "shapley")] for r in audit(flagged, "part", list("ABCDE")).collect()}
    assert got == brute(rows(), labels)
    assert len(got) == 600 * 4


def test_edges_of_a_part(spark):
    flagged = flagged_documents(spark.createDataFrame(rows(), DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    found = edges(profiles(flagged, "part", list("ABCDE")), list("ABCDE")).collect()
    assert len(found) == 80 * 4
    assert all(r["good_lost"] == r["toxic_lost"] == 0 for r in found)
    # All orders pass as many edges as they have steps.
    assert sum(r["weight"] for r in found if r["part"] == "en") == 600


@pytest.mark.parametrize("names", [["A"], ["A", "B", "C"]])
def test_other_numbers_of_filters(spark, names):
    rows = [(None, True, False, True, True, None), ("x", None, True, True, False, True), ("x", False, False, None, True, True)]
    flagged = spark.createDataFrame(rows, "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    got = audit(flagged, "part", names).collect()
    assert len(got) == 2 * len(list(permutations(names))) * len(names)
    for r in got:
        assert r["kept"] + r["removed"] + r["redundant"] <= (1 if r["part"] is None else 2)


def test_empty_table(spark):
    flagged = flagged_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit(flagged, "part", list("ABCDE")).count() == 0
