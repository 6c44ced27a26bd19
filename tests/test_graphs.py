import ast
import json

import pytest
from pyspark.sql import functions as F

from tabulon.operators import graph, vectors
from tabulon.sources import graphml, records, syntax

NS = f'xmlns="{graphml.NAMESPACE}"'


def doc(body, ns=NS):
    return f"<graphml {ns}><graph>{body}</graph></graphml>"


OK = doc('<node id="1"><data key="labelV">CALL</data><data key="b">it\'s\nso</data><data key="a">1</data></node><node id="2"/><node id="3"><data key="labelV"></data></node><edge source="1" target="2"><data key="labelE">ARG</data></edge><edge source="1" target="9"/>')
CASES = {
    1: OK,
    2: "",
    3: None,
    4: "<broken",
    5: doc("", NS),
    6: doc('<node id="1"/>', ""),
    7: f'<graphml {NS}><graph><node id="a"/></graph><graph><node id="b"/><node id="c"/></graph></graphml>',
    8: doc('<node id="1"><data key="k"><![CDATA[<x>]]></data></node><node id="1"><data key="labelV">LATER</data></node><edge source="1" target="1"/>'),
}


@pytest.mark.parametrize("exact", [False, True])
def test_graphml(spark, exact):
    parsed = graphml.parse(spark.createDataFrame(list(CASES.items()), "idx long, xml string"), "xml", exact)
    status = {r["idx"]: r["status"] for r in parsed.collect()}
    assert status == {1: "success", 2: "empty", 3: "empty", 4: "parse_failed", 5: "parse_failed", 6: "parse_failed", 7: "success", 8: "success"}
    nodes, edges = graphml.node_rows(parsed, "idx"), graphml.edge_rows(parsed, "idx")
    shown = {(r["graph"], r["pos"]): (r["type"], r["text"], r["labelled_text"]) for r in nodes.collect()}
    assert shown[1, 0] == ("CALL", "a='1', b='it\\'s\\nso'", "[CALL] a='1', b='it\\'s\\nso'")
    assert shown[1, 1] == ("UNKNOWN", "", "[UNKNOWN]") and shown[1, 2][0] is None
    assert shown[8, 0][1] == "k='<x>'" and (7, 1) not in shown
    typed = {(r["graph"], r["rel"]): (r["src_type"], r["dst_type"], r["labelled_text"]) for r in graph.typed_edges(nodes, edges).collect()}
    assert typed == {(1, "ARG"): ("CALL", "UNKNOWN", "[ARG]"), (8, "edge"): ("LATER", "LATER", "[edge]")}  # edges bind to the last of equal ids
    assert [r["target"] for r in graph.dangling_edges(nodes, edges).collect()] == ["9"]


def test_exact_parsing_keeps_white_space(spark):
    df = spark.createDataFrame([(1, doc('<node id="1"><data key="k"> </data></node>'))], "idx long, xml string")
    assert graphml.node_rows(graphml.parse(df, "xml", True), "idx").first()["text"] == "k=' '"


def test_records_have_a_status(spark, tmp_path):
    full = dict(idx=1, hash="h", target="t", model="m", language="l", split="s", source="", code="c", graphml="<g/>")
    lines = [full, full | {"graphml": None}, {k: v for k, v in full.items() if k != "model"}, {k: v for k, v in full.items() if k != "idx"}, {k: v for k, v in full.items() if k != "graphml"}]
    path = tmp_path / "raw" / "x.jsonl"
    path.parent.mkdir()
    path.write_text("\n".join([*map(json.dumps, lines), "{not json"]) + "\n")
    where = records.resolve(spark, str(tmp_path), "x.jsonl")
    decoded = records.decode_records(records.read_lines(spark, where)).orderBy("line_no").collect()
    assert [r["status"] for r in decoded] == ["success", "empty", "error: missing model", "success", "empty", "error: invalid JSON"]
    assert decoded[3]["idx"] == -1 and records.count_lines(spark, where) == 6
    with pytest.raises(FileNotFoundError):
        records.resolve(spark, str(tmp_path), "y.jsonl")


def test_a_failing_analyser_leaves_a_row(spark):
    def analyse(code, suffix):
        if code == "bad":
            raise RuntimeError("no")
        return None if code == "none" else code + suffix

    df = spark.createDataFrame([("x", "java"), ("bad", None), ("none", "python")], "code string, language string")
    assert [(r["graphml"], r["status"]) for r in records.with_analysis(df, analyse).collect()] == [("x.java", "success"), (None, "error: no"), (None, "empty")]


def test_tree_is_pre_order_with_fields(spark):
    source = "def f(a):\n    return g(a, 'x' * 3, 'a long constant, more than twenty')\n"
    rows = syntax.tree_rows(source)
    order = []

    def visit(node, parent, field):
        at = len(order)
        order.append((at, syntax.label(node), parent, field))
        for name, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    visit(child, at, name)

    visit(ast.parse(source), None, None)
    assert rows == order and "[FunctionDef] name='f'" in {r[1] for r in rows} and "[Constant] value='a long constant, mor...'" in {r[1] for r in rows}
    assert syntax.tree_rows("def (") is None
    df = spark.createDataFrame([(1, source), (2, "def ("), (3, None)], "id long, code string")
    assert {r["id"] for r in syntax.tree(df, "id", "code").collect()} == {1, 3}


def test_sage_layer_drops_types_without_edges(spark):
    states = spark.createDataFrame([("a", "a1", 0, 2.0), ("a", "a2", 0, 4.0), ("b", "b1", 0, -1.0), ("b", "b2", 0, 5.0)], "type string, node string, dim int, value double")
    edges = spark.createDataFrame([("a", "a1", "r", "b", "b1"), ("a", "a2", "r", "b", "b1")], "src_type string, source string, rel string, dst_type string, target string")
    weights = spark.createDataFrame([("r", 0, 0, 2.0, -1.0)], "rel string, out_dim int, in_dim int, w_l double, w_r double")
    got = {r["node"]: r["value"] for r in graph.sage_layer(states, edges, weights).collect()}
    assert got == {"b1": 2 * 3 + 1 - 1, "b2": 5.0}


def test_pool_counts_absent_types_as_zero(spark):
    df = spark.createDataFrame([(1, "a", 0, 2.0), (1, "a", 0, 4.0), (2, "a", 0, 1.0), (2, "b", 0, 5.0)], "graph long, type string, dim int, value double")
    assert {r["graph"]: r["value"] for r in graph.type_pool(df).collect()} == {1: 1.5, 2: 3.0}


def test_routing_stays_within_bounds(spark):
    df = spark.createDataFrame([([50.0, -50.0],), ([1.0, 1.0],)], "s array<double>")
    got = [r[0] for r in df.select(vectors.routing(F.col("s"))).collect()]
    assert got[0] == pytest.approx([0.99, 0.01]) and got[1] == pytest.approx([0.5, 0.5])


def test_isotropy_of_orthogonal_vectors_is_zero(spark):
    df = spark.createDataFrame([([2.0, 0.0],), ([0.0, 3.0],)], "v array<double>")
    assert vectors.isotropy_penalty(df, "v").first()[0] == pytest.approx(0)
    assert vectors.total_loss(2.0, 0.5, 0.1, 1.0, use_isotropy=False, use_cross=False) == 2.0


def test_a_layer_sends_only_edges_it_uses_and_averages_them_once(spark):
    import numpy as np

    from tabulon.functions.dense import Linear
    from tabulon.operators import encoder

    one = lambda w: encoder.Convolution(Linear(np.eye(2) * w, np.zeros(2)), np.zeros((2, 2)))
    nodes = spark.createDataFrame([("g", "a", 0, [1.0, 2.0]), ("g", "a", 1, [3.0, 4.0]), ("g", "b", 0, [5.0, 6.0]), ("g", "b", 1, [0.0, 1.0])], "graph string, type string, pos long, x array<double>")
    edges = spark.createDataFrame([("g", "a", 0, "r", "b", 0), ("g", "a", 1, "r", "b", 0), ("g", "b", 0, "s", "b", 1), ("g", "b", 1, "unused", "a", 0), ("g", "b", 1, "r", "b", 0)], "graph string, src_type string, src_pos long, rel string, dst_type string, dst_pos long")
    convolutions = {("a", "r", "b"): one(1.0), ("b", "s", "b"): one(10.0)}
    out = encoder.convolve(nodes, edges, convolutions)
    assert {(r["type"], r["pos"]): r["x"] for r in out.collect()} == {("b", 0): [7.0, 9.0], ("b", 1): [50.0, 61.0]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "unused" not in plan and "(rel" in plan  # one pass, with the edge types as a filter
    wide = nodes.select("graph", "type", "pos", F.expr("concat(x, array_repeat(0.0D, 38))").alias("x"))
    far = {e: encoder.Convolution(Linear(np.eye(40) * c.neighbours.weight[0, 0], np.zeros(40)), np.zeros((40, 40))) for e, c in convolutions.items()}
    assert {(r["type"], r["pos"]): r["x"][:2] for r in encoder.convolve(wide, edges, far).collect()} == {("b", 0): [7.0, 9.0], ("b", 1): [50.0, 61.0]}
