import json
import random

from pyspark.sql import functions as F

from tabulon.functions.embed import embed_texts, hashing_embedder
from tabulon.plans.analysis import analyse, few_shot, report, write_few_shot
from tabulon.plans.graph_dataset import GraphDataset
from tabulon.sources.graphml import NAMESPACE


def test_dataset_is_built_stored_and_subset(spark, tmp_path):
    xml = lambda n: f'<graphml xmlns="{NAMESPACE}"><graph>' + "".join(f'<node id="{i}"><data key="labelV">T{i % 2}</data></node>' for i in range(n)) + '<edge source="0" target="1"/></graph></graphml>'
    rec = lambda idx, language, graph: json.dumps(dict(idx=idx, hash="h", target="t", model="m", language=language, split="s", source="x", code="c", graphml=graph))
    (tmp_path / "cpg_dataset.jsonl").write_text("\n".join([rec(1, "java", xml(2)), rec(2, "python", xml(3)), rec(1, "java", xml(4)), rec(3, "java", None), rec(4, "java", "<bad")]))
    built = GraphDataset.build(spark, str(tmp_path))
    built.write(str(tmp_path / "out"))
    data = GraphDataset.load(spark, str(tmp_path / "out"))
    assert {r["status"]: r["n"] for r in data.skipped.collect()} == {"empty": 1, "parse_failed": 1}
    assert data.graphs.count() == 2 and data.nodes.count() == 7
    java = data.subset(language="java")
    assert {r["graph"] for r in java.nodes.collect()} == {1} and java.nodes.count() == 4
    assert [(r["src_type"], r["dst_type"], r["src_pos"], r["dst_pos"]) for r in java.edges.collect()] == [("T0", "T1", 0, 0)]


def test_analysis_and_report(spark):
    draw = random.Random(0)
    rows = [(i, "abc"[i % 3], float(i % 3 + draw.random()), draw.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, c string, f double, g double")
    tables = analyse(df, "id", "c", ["a", "b", "c"], ["f", "g", "absent"], folds=2, trees=5)
    assert {r["feature"]: r["effect"] for r in tables["kruskal"].collect()}["f"] == "Large"
    text = report(tables)
    assert "missing values: none" in text and "| f |" in text
    assert tables["pairwise"].filter("feature = 'f' AND significant = 'Yes'").count() == 3


def joined(folder):
    """The document of a folder's parts, which its manifest lists with their sizes."""
    parts = json.loads((folder / "_manifest.json").read_text())["parts"]
    assert [p["name"] for p in parts] == sorted(p.name for p in folder.iterdir() if p.name.startswith("part-"))
    texts = [(folder / p["name"]).read_bytes() for p in parts]
    assert [len(t) for t in texts] == [p["bytes"] for p in parts]
    return json.loads(b"".join(texts))


def test_few_shot_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(100)], "id long, l string")
    names = write_few_shot(*few_shot(df, "id", "l", tasks=2, max_shot=3), str(tmp_path), "model")
    assert names == ["2way_2tasks_model.json", "2way_base_split_model.json"]
    base, tasks = (joined(tmp_path / n) for n in reversed(names))
    assert base["label_map"] == {"x": 0, "y": 1} and base["id_map"] == {"0": "x", "1": "y"} and len(base["train_indices"]) == 20 and len(base["test_indices"]) == 80
    assert base["train_indices"] == sorted(base["train_indices"]) and sorted(base["train_indices"] + base["test_indices"]) == list(range(100))
    one = tasks[0]["data"]
    assert one["3_shot"]["0"][:2] == one["2_shot"]["0"] and set(one["3_shot"]["1"]) <= set(base["train_indices"])


def test_few_shot_files_equal_their_tables(spark, tmp_path):
    rows = [(f'k"{i}\n é', ["ü,", None, 'q"'][i % 3]) for i in range(160)]
    labels, parts, drawn = few_shot(spark.createDataFrame(rows, "id string, l string"), "id", "l", tasks=12, max_shot=4)
    base, tasks = (joined(tmp_path / n) for n in reversed(write_few_shot(labels, parts, drawn, str(tmp_path), "t")))
    assert base["label_map"] == {"None": 0, 'q"': 1, "ü,": 2} and base["id_map"] == {"0": "None", "1": 'q"', "2": "ü,"}
    for part in ("train", "test"):
        assert base[f"{part}_indices"] == sorted(r["id"] for r in parts.filter(F.col("part") == part).collect())
    want = {}
    for r in drawn.orderBy("task_id", "k", "class_id", "rank").collect():
        want.setdefault(r["task_id"], {}).setdefault(f"{r['k']}_shot", {}).setdefault(str(r["class_id"]), []).append(r["member"])
    assert tasks == [{"task_id": t, "data": want[t]} for t in range(12)]
    assert list(tasks[0]["data"]) == ["1_shot", "2_shot", "3_shot", "4_shot"]


def test_few_shot_files_of_nothing(spark, tmp_path):
    names = write_few_shot(*few_shot(spark.createDataFrame([], "id long, l string"), "id", "l", tasks=2, max_shot=3), str(tmp_path), "t")
    assert names == ["0way_0tasks_t.json", "0way_base_split_t.json"]
    assert [joined(tmp_path / n) for n in names] == [[], {"label_map": {}, "id_map": {}, "train_indices": [], "test_indices": []}]


def test_each_text_is_embedded_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, t string")
    got = {r["id"]: r["embedding"] for r in embed_texts(df, "t", hashing_embedder(4)).collect()}
    assert got[1] == got[2] and got[3] is None and len(got[1]) == 4
    assert df.filter(F.col("id") > 9).count() == 0
