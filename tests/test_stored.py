import pytest

import __spark_entry__
from tabulon.plans import registry, stored

SMALL = "/root/testdata/sf0.001"

CHECKED = ["decoded_records", "record_metadata", "first_lines", "csv_sink", "text_files", "cached_embeddings", "split_file", "analysed_rows", "analyser_processes", "graph_store_edges", "graph_store_nodes", "homo_store_nodes", "mean_routing", "hidden_by_language"]
NEW = ["quota_sample_nulls", "dedup_last_nulls", "kruskal_missing_class", "mann_whitney_exact", "dangling_edges_repeated", "marked_identifiers", "gated_fusion", "text_encoder", "token_vectors", "feature_densities"]


@pytest.mark.parametrize("name", CHECKED + NEW)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages labels conversations".split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = __spark_entry__.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted((tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert key(got.select(columns).collect()) == key(want)


def test_names_are_registered_once():
    assert not set(registry.queries()) & set(stored.queries())
    assert set(stored.oracle_sql()) <= set(stored.queries())
