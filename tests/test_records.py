import os
import sys

import pytest
from pyspark.sql import functions as F

from tabulon.functions import code
from tabulon.operators import vectors
from tabulon.sources import graphml, records


def test_an_analyser_has_a_folder_that_goes(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def analyse(text, suffix, folder):
        path = f"{folder}/source{suffix}"
        with open(path, "w") as out, open(f"{seen}-{text}", "w") as note:
            out.write(text)
            note.write(folder)
        if text == "bad":
            raise RuntimeError("no")
        with open(path) as back:
            return back.read() + suffix

    df = spark.createDataFrame([("x", "java"), ("bad", "cpp")], "code string, language string")
    got = {r["code"]: (r["graphml"], r["status"]) for r in records.with_analysis(df, records.in_temp_folder(analyse)).collect()}
    assert got == {"x": ("x.java", "success"), "bad": (None, "error: no")}
    assert not any(os.path.exists(open(f"{seen}-{t}").read()) for t in ("x", "bad"))


def test_a_table_is_written_once_unless_forced(spark, tmp_path):
    where = str(tmp_path / "t")
    make = lambda n: spark.createDataFrame([(1, "a", n), (2, "b", n)], "idx long, node_type string, n long")
    assert {r["n"] for r in records.materialise(make(1), where).collect()} == {1}
    assert {r["n"] for r in records.materialise(make(2), where).collect()} == {1}
    assert {r["n"] for r in records.materialise(make(3), where, force=True).collect()} == {3}


def test_a_cache_must_have_the_same_keys(spark):
    df, cache = spark.createDataFrame([(1, "x"), (2, "y")], "idx long, t string"), spark.createDataFrame([(2, [1.0]), (1, [0.0])], "idx long, v array<double>")
    assert sorted(tuple(r) for r in records.attach(df, cache, "idx").collect()) == [(1, "x", [0.0]), (2, "y", [1.0])]
    for other in (cache.limit(1), cache.withColumn("idx", F.col("idx") + 1)):
        with pytest.raises(ValueError):
            records.attach(df, other, "idx")


def test_files_and_their_inventory(spark, tmp_path):
    (tmp_path / "A.java").write_text("class A {}\n")
    (tmp_path / "b.py").write_text("x = 1\n")
    got = {r["path"].rsplit("/", 1)[1]: (r["code"], r["language"]) for r in records.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"A.java": ("class A {}\n", "java"), "b.py": ("x = 1\n", "python")}
    assert {(r["path"].rsplit("/", 1)[1], r["length"]) for r in records.inventory(spark, str(tmp_path)).collect()} == {("A.java", 11), ("b.py", 6)}


def test_small_sinks_and_peeks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "idx long, t string")
    assert records.peek(df, 3, "idx").first()["t"] == "r3"
    records.write_csv(df, str(tmp_path / "csv"))
    records.write_json(df, str(tmp_path / "json"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 5 and spark.read.json(str(tmp_path / "json")).count() == 5
    counted = graphml.element_counts(spark.createDataFrame([("<node id='1'/><node id='2'/><edge a='b'/>",)], "x string"), "x").first()
    assert (counted["n_nodes"], counted["n_edges"]) == (2, 1)
    symbols = spark.createDataFrame([("b a for b",)], "t string").select(code.symbol_map(F.col("t"), "python")).first()[0]
    assert list(symbols) == ["a", "b"] and all(v.startswith("h") for v in symbols.values())


def test_vector_columns(spark):
    df = spark.createDataFrame([(1, [0.2, 0.8]), (1, [0.4, 0.6]), (2, [1.0, 0.0])], "b long, w array<double>")
    got = {(r["b"], r["expert"]): round(r["weight"], 6) for r in vectors.mean_routing(df, "b", "w").collect()}
    assert got == {(1, 0): 0.3, (1, 1): 0.7, (2, 0): 1.0, (2, 1): 0.0}
    assert df.select(vectors.side_by_side(F.col("w"), F.col("w"))).first()[0] == [0.2, 0.8, 0.2, 0.8]


def test_covariances_of_ragged_vectors(spark):
    import numpy as np

    rows = [([1.0, 2.0], [1.0, 0.5]), ([3.0, 1.0, 5.0], [2.0, 1.0]), (None, [1.0, 1.0]), ([2.0, 7.0], [4.0, 3.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    cells = {(r["i"], r["j"]): r["value"] for r in vectors.cross_covariance(df, "a", "b", eps=0.0).filter("i < 2").collect()}
    x, y = np.array([r[0][:2] for r in rows if r[0]]), np.array([r[1] for r in rows if r[0]])
    want = (x - x.mean(0)).T @ (y - y.mean(0)) / 2
    assert all(cells[i, j] == pytest.approx(want[i, j]) for i in (0, 1) for j in (0, 1))
    gram = {(r["i"], r["j"]): r["value"] for r in vectors.gram(df, "a").collect()}
    assert gram[0, 0] == pytest.approx(14 / 3) and gram[2, 2] == pytest.approx(25 / 3) and gram[0, 2] == pytest.approx(15 / 3)
    assert vectors.isotropy_penalty(df.limit(0), "a").first()[0] == 0.0


ANALYSER = """
import os, subprocess, sys, time
code, out = sys.argv[1:]
text = open(code).read()
open(text.split()[0] + ".seen", "w").write(os.path.dirname(code)) if "/" in text else None
if "fail" in text:
    sys.exit("no such syntax") if "message" in text else sys.exit(3)
if "hang" in text:
    child = subprocess.Popen(["sleep", "600"])
    open(text.split()[0] + ".pid", "w").write(str(child.pid))
    time.sleep(600)
if "folder" in text:
    os.mkdir(out)
    open(out + "/b", "w").write("second"), open(out + "/a", "w").write("first" + os.path.splitext(code)[1])
elif "nothing" not in text:
    open(out, "w").write("" if "blank" in text else text.upper())
"""


def test_a_process_for_each_row(spark, tmp_path):
    script, mark = tmp_path / "analyser.py", f"{tmp_path}/mark"
    script.write_text(ANALYSER)
    texts = [f"{mark} fine", "fail", "fail message", f"{mark}2 hang", "nothing", "blank", "folder", None, "ümlaut"]
    df = spark.createDataFrame([(i, t, "java", "x") for i, t in enumerate(texts)], "id long, code string, language string, graph string").repartition(4)
    got = {r["id"]: (r["graphml"], r["status"], r["exit_status"], r["out_bytes"]) for r in records.with_processes(df, [sys.executable, str(script), "{code}", "{out}"], limit=4.0).collect()}
    upper = f"{mark} fine".upper()
    assert got == {
        0: (upper, "success", 0, len(upper)),
        1: (None, "error: exit status 3", 3, 0),
        2: (None, "error: exit status 1: no such syntax", 1, 0),
        3: (None, "error: no end after 4 s", None, 0),
        4: (None, "empty", 0, 0),
        5: (None, "empty", 0, 0),
        6: ("first.java", "success", 0, 10),
        7: (None, "empty", 0, 0),
        8: ("ÜMLAUT", "success", 0, 7),
    }
    # Folders go, and so does what a hanging process has started.
    assert not any(os.path.exists(open(f"{m}.seen").read()) for m in (mark, f"{mark}2"))
    child = open(f"{mark}2.pid").read()
    assert not os.path.exists(f"/proc/{child}") or "Z" in open(f"/proc/{child}/stat").read().split()[2]


def test_a_command_that_is_not_there(spark):
    df = spark.createDataFrame([(1, "x", None)], "id long, code string, language string")
    assert [tuple(r)[3:] for r in records.with_processes(df, ["/no/such/command"]).collect()] == [(None, "error: No such file or directory", None, 0)]
    assert records.with_processes(df.limit(0), ["/no/such/command"]).count() == 0


def test_what_a_process_says_is_not_read_whole(tmp_path):
    import tracemalloc

    script = tmp_path / "loud.py"
    script.write_text("import sys\nfor _ in range(20): sys.stderr.write('x' * 1_000_000)\nsys.stderr.write('\\nthe end')\nsys.exit(4)")
    tracemalloc.start()
    try:
        got = records.analyse_by_process([sys.executable, str(script)], "x", ".py", 60.0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[0] is None and got[1].endswith("x\nthe end") and len(got[1]) == len("error: exit status 4: ") + 200 and got[2:] == (4, 0)
    assert peak < 1_000_000


def test_a_folder_with_nothing_unforeseen_is_not_listed(tmp_path, monkeypatch):
    import tempfile

    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    listed, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda *a: listed.append(a) or scan(*a))
    assert records.analyse_by_process(["cp", "{code}", "{out}"], "a", ".py", 60.0) == ("a", "success", 0, 1)
    assert records.analyse_by_process(["sh", "-c", "exit 3"], "a", ".py", 60.0) == (None, "error: exit status 3", 3, 0)
    assert records.analyse_by_process(["/no/such/command"], "a", ".py", 60.0) == (None, "error: No such file or directory", None, 0)
    assert not listed and not os.listdir(tmp_path)
    more = ["sh", "-c", 'mkdir -p "$0/sub" && echo b > "$0/sub/b" && mkdir other && echo c > other/c', "{out}"]
    assert records.analyse_by_process(more, "a", ".py", 60.0) == ("b\n", "success", 0, 2)
    assert listed and not os.listdir(tmp_path)
