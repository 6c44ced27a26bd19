import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon import cli
from tabulon.functions.embed import hashing_embedder, hashing_tokens, token_ids
from tabulon.operators import encoder, heads
from tabulon.plans.graph_dataset import GraphDataset, HomoDataset, feature_width
from tabulon.plans.ingest import chosen_samples, ingest
from tabulon.sources import records
from tabulon.sources.graphml import NAMESPACE


def analyser():
    """A stand-in: a node per word, typed by length, each linked to the next. A closure, so that workers need not import this file."""

    def xml(code, suffix):
        if code == "fails":
            raise RuntimeError("no graph")
        words = code.split()
        nodes = "".join(f'<node id="{i}"><data key="labelV">L{len(w) % 2}</data><data key="w">{w}</data></node>' for i, w in enumerate(words))
        return f'<graphml xmlns="{NAMESPACE}"><graph>{nodes}' + "".join(f'<edge source="{i}" target="{i + 1}"><data key="labelE">NEXT</data></edge>' for i in range(len(words) - 1)) + "</graph></graphml>"

    return xml


SAMPLES = [(3, "a bb c", "x y", "1", "m", "python", "train", "s"), (1, "fails", "f", "1", "m", "java", "test", "s"), (2, "q", "int foo = a;", "2", None, "java", "test", "s"), (4, "z", "z", "2", "m", "cpp", "test", "s"), (5, "one two", "def foo(a): pass", "2", "n", "python", "test", "s"), (6, "k", "k", "1", "m", None, "val", "s")]
COLUMNS = "id long, code string, cleaned_code string, target string, model string, language string, split string, source string"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("CPG")
    ingest(spark.createDataFrame(SAMPLES, COLUMNS), analyser(), str(where), "id")
    return where


def test_ingestion_writes_a_record_for_every_chosen_sample(spark, root):
    got = {r["idx"]: r for r in spark.read.json(f"{root}/raw/cpg_dataset.jsonl").collect()}
    assert [got[i]["code"] for i in range(4)] == ["fails", "a bb c", "one two", "k"] and len(got) == 4
    assert got[0]["graphml"] is None and got[0]["status"] == "error: no graph" and got[1]["status"] == "success"
    assert got[1]["hash"] == hashlib.md5(b"a bb c").hexdigest()


def test_obfuscation_takes_the_test_split_and_limits_come_first(spark):
    df = spark.createDataFrame(SAMPLES, COLUMNS)
    hidden = chosen_samples(df, "id", obfuscate=True).orderBy("idx").collect()
    assert [r["id"] for r in hidden] == [1, 5] and hidden[1]["code"].startswith("def h") and "foo" not in hidden[1]["code"]
    assert [r["id"] for r in chosen_samples(df, "id", limit=2).orderBy("idx").collect()] == [1, 3]
    assert chosen_samples(df.limit(0), "id").count() == 0


def test_both_datasets_with_hooks_and_embeddings(spark, root, tmp_path):
    seen = []
    hook = lambda t: seen.append(type(t).__name__) or t.subset(language="python")
    hetero = GraphDataset.build(spark, str(root), pre_transform=hook).embed(hashing_embedder(8))
    hetero.write(str(tmp_path / "hetero"))
    back = GraphDataset.load(spark, str(tmp_path / "hetero"), transform=lambda t: t.subset(split="train"))
    assert seen == ["GraphDataset"] and back.graphs.count() == 1
    assert sorted((r["type"], r["type_pos"]) for r in back.nodes.collect()) == [("L0", 0), ("L1", 0), ("L1", 1)]
    assert feature_width(back.nodes) == 8
    homo = HomoDataset.build(spark, str(root)).embed(hashing_embedder(4))
    homo.write(str(tmp_path / "homo"))
    homo = HomoDataset.load(spark, str(tmp_path / "homo"))
    assert sorted((r["graph"], r["pos"], r["text"], len(r["x"])) for r in homo.nodes.filter("graph = 1").collect()) == [(1, 0, "[L1] w='a'", 4), (1, 1, "[L0] w='bb'", 4), (1, 2, "[L1] w='c'", 4)]
    assert sorted((r["src"], r["dst"], r["text"], len(r["attr"])) for r in homo.edges.filter("graph = 1").collect()) == [(0, 1, "[NEXT]", 4), (1, 2, "[NEXT]", 4)]
    assert {r["status"]: r["n"] for r in homo.skipped.collect()} == {"empty": 1, "error: missing language": 1}


def test_feature_width(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([],)], "x array<double>")
    assert feature_width(df) == 2 and feature_width(df.limit(0)) == 768
    with pytest.raises(ValueError):
        feature_width(df.unionByName(spark.createDataFrame([([1.0],)], "x array<double>")))


def test_encoder_against_plain_loops(spark):
    draw = np.random.default_rng(2)
    nodes = [(g, t, i, draw.normal(size=3).tolist()) for g in (1, 2) for t, n in (("a", 4), ("b", 3 if g == 1 else 0)) for i in range(n)]
    edges = [(g, "a", int(draw.integers(4)), "r", "b", int(draw.integers(3))) for g in (1,) for _ in range(6)] + [(2, "a", 0, "s", "a", 1), (2, "a", 2, "s", "a", 1), (1, "a", 3, "s", "a", 3), (1, "a", 1, "other", "a", 0)]
    make = lambda o, i: encoder.Linear(draw.normal(size=(o, i)), draw.normal(size=o))
    model = encoder.GraphEncoder({"a": make(2, 3), "b": make(2, 3)}, [{("a", "r", "b"): encoder.Convolution(make(2, 2), draw.normal(size=(2, 2))), ("a", "s", "a"): encoder.Convolution(make(2, 2), draw.normal(size=(2, 2)))} for _ in range(2)], make(3, 2))
    state = {(g, t, i): model.projections[t](np.array(x)) for g, t, i, x in nodes}
    for layer in model.layers:
        new = {}
        for (g, t, i), x in state.items():
            total = 0
            for (src, rel, dst), conv in layer.items():
                if dst == t:
                    near = [state[g, src, e[2]] for e in edges if (e[0], e[1], e[3], e[4], e[5]) == (g, src, rel, t, i)]
                    total = total + conv.neighbours(np.mean(near, axis=0) if near else np.zeros(2)) + conv.own @ x
            new[g, t, i] = np.maximum(total, 0) + x
        state = new
    want = {}
    for g in (1, 2, 3):
        means = [np.mean([x for (h, t, _), x in state.items() if (h, t) == (g, kind)], axis=0) if any(k[:2] == (g, kind) for k in state) else np.zeros(2) for kind in "ab"]
        want[g] = model.output(np.mean(means, axis=0))
    frames = spark.createDataFrame(nodes, "graph long, type string, pos int, x array<double>"), spark.createDataFrame(edges, "graph long, src_type string, src_pos int, rel string, dst_type string, dst_pos int")
    got = {r["graph"]: r["x"] for r in encoder.encode(*frames, model, spark.createDataFrame([(1,), (2,), (3,)], "graph long")).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(list(want[g])) for g in want)


def test_head_is_stored_and_read(spark, tmp_path):
    rows = [(i, [float(i % 3 == k) + 0.01 * i for k in range(3)], "xyz"[i % 3]) for i in range(60)] + [(99, None, "x"), (98, [0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, v array<float>, c string")
    heads.save_head(heads.fit_head(df, "v", "c"), str(tmp_path / "head"))
    got = {r["id"]: r["predicted"] for r in heads.apply_head(heads.load_head(str(tmp_path / "head")), df, "v").collect()}
    assert all(got[i] == i % 3 for i in range(60)) and 99 not in got and 98 in got


def test_token_ids_are_cut_and_padded(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a"), (3, None)], "id long, t string").coalesce(1)
    got = {r["id"]: r["input_ids"] for r in token_ids(df, "t", hashing_tokens(), max_length=3, pad=0).collect()}
    assert len(got[1]) == len(got[2]) == len(got[3]) == 3 and got[2][0] == got[1][0] and got[2][1:] == [0, 0] and got[3] == [0, 0, 0]


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).write_text("\n".join(f"{name}{i}" for i in range(300)) + "\n")
    lines = [r["line"] for r in records.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert lines == [f"{name}{i}" for name in ("a", "b") for i in range(300)]
    assert [r["line"] for r in records.read_lines(spark, str(tmp_path), first=2).collect()] == ["a0", "a1"]


def test_command_lines(spark, root, tmp_path, capsys):
    source = tmp_path / "x.py"
    source.write_text("def foo(a):\n    return a\n")
    assert cli.main(["obfuscate", str(source), "--map"], spark) == 0
    shown = capsys.readouterr().out
    assert "foo ->" in shown and "def h" in shown
    with pytest.raises(ValueError):
        cli.obfuscate_file(spark, str(tmp_path / "x.txt"))
    assert cli.main(["build", "--path", str(root), "--kind", "homo"], spark) == 0
    assert (root / "processed_homo" / "nodes").exists()
    spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(40)], "id long, embedding array<double>, label int").write.parquet(str(tmp_path / "e"))
    for task in ("downstream", "infer"):
        assert cli.main(["run", str(tmp_path / "e"), "--task_name", task, "--checkpoints", str(tmp_path / "c")], spark) == 0
        assert "'accuracy': 1.0" in capsys.readouterr().out
    assert json.loads(json.dumps({"n": spark.read.parquet(str(root / "processed_homo" / "nodes")).filter(F.col("graph") == 1).count()})) == {"n": 3}


def test_words_beyond_the_cut_are_not_hashed(spark):
    """Ids are made as they are asked for, and words met before are remembered; blanks are the six of ASCII only."""
    asked = []

    def encoder(texts):
        return [(asked.append(w) or int(w) for w in t.split()) for t in texts]

    df = spark.createDataFrame([(1, "4 5 6 7 8"), (2, None), (3, "9")], "id long, t string").coalesce(1)

    def kept(rows):
        return {r["id"]: r["input_ids"] for r in rows.collect()}

    assert kept(token_ids(df, "t", encoder, max_length=2, pad=None)) == {1: [4, 5], 2: [], 3: [9]}
    assert kept(token_ids(df, "t", encoder, max_length=2, pad=7)) == {1: [4, 5], 2: [7, 7], 3: [9, 7]}
    ids = hashing_tokens(97)(["a\x1cb  a\u00a0b\x0b\tc a\x1cb"])[0]
    assert next(ids) == 1 + int(hashlib.md5(b"a\x1cb").hexdigest()[:8], 16) % 97  # one by one
    assert len(list(ids)) == 3
