import pytest

import __spark_entry__
from tabulon.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 1


@pytest.mark.parametrize("name", ["kruskal", "quota_sample", "hetero_edges", "scores", "contrastive", "obfuscate", "gram", "episodes"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages labels".split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got = registry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted(tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in r) for r in rows)
    assert key(got.select(columns).collect()) == key(want)
