"""Work that is dealt by rows, not by the bytes of small files."""

import pytest

import __spark_entry__
from tabulon.session import spread
from tabulon.sources import records, syntax

SMALL = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    db = pytest.importorskip("duckdb").connect()
    for table in "nation customer supplier part orders documents embeddings".split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted((tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert key(got.select(columns).collect()) == key(want)


def test_spread_deals_rows_to_all_cores(spark):
    one = spark.range(1000).coalesce(1)
    sizes = [len(p) for p in spread(one, 100).rdd.glom().collect()]
    assert len(sizes) == 10 and max(sizes) <= 110 and sum(sizes) == 1000
    assert spread(one).rdd.getNumPartitions() == 4 and spread(one.limit(0)).count() == 0


def test_trees_of_one_file_are_made_by_all_cores(spark, monkeypatch):
    docs = spark.range(300).coalesce(1).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'def (' ELSE 'x = ' || id END AS code")
    made = syntax.tree(docs, "id", "code")
    assert made.rdd.getNumPartitions() == 4
    rows = made.collect()
    assert len(rows) == 200 * 5 and {r["label"] for r in rows if r["pos"] == 4} == {f"[Constant] value='{i}'" for i in range(300) if i % 3}
    same_as_sql(spark, "ast_graph")


def test_processes_of_one_file_run_on_all_cores(spark, monkeypatch):
    rows = spark.range(40).coalesce(1).selectExpr("id", "CASE WHEN id % 4 = 0 THEN 'fail' WHEN id % 4 = 1 THEN '' ELSE 'text ' || id END AS code", "'python' AS language")
    made = records.with_processes(rows, ["sh", "-c", 'grep -q "^fail$" "$0" && exit 1; cp "$0" "$1"', "{code}", "{out}"])
    assert made.rdd.getNumPartitions() == 4
    got = {r["id"]: (r["graphml"], r["status"], r["exit_status"], r["out_bytes"]) for r in made.collect()}
    kinds = [lambda i: (None, "error: exit status 1", 1, 0), lambda i: (None, "empty", 0, 0)] + [lambda i: (f"text {i}", "success", 0, len(f"text {i}"))] * 2
    assert got == {i: kinds[i % 4](i) for i in range(40)}


def test_the_end_of_a_process_is_told_at_once():
    import subprocess

    slow, quick = subprocess.Popen(["sleep", "60"]), subprocess.Popen(["sh", "-c", "exit 3"])
    assert records._end(quick, 10.0) == 3 and records._end(slow, 0.1) is None
    slow.kill()
    assert slow.wait() == -9


def test_graphs_of_one_file_are_parsed_by_all_cores(spark):
    from tabulon.plans import registry

    assert registry.queries()["xml_nodes"](spark, SMALL).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["homo_edges", "xml_graph", "xml_nodes", "node_embeddings"])
def test_graphs_equal_sql(spark, name):
    same_as_sql(spark, name)


def test_file_inventory_sends_no_language_to_one_task(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a language would go through one task")

    monkeypatch.setattr(type(spark.range(1)), "repartition", refuse)
    same_as_sql(spark, "file_inventory")


def test_obfuscation_remembers_names():
    import pyarrow as pa

    from tabulon.functions import code

    code._hidden.cache_clear()
    assert code._obfuscator("python")(pa.array(["a a a if", None, "é_a á"])).to_pylist() == ["he40c292c he40c292c he40c292c if", None, "é_a he40c292ć"]
    assert code._hidden.cache_info().hits == 3
