import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabulon.llm.exact import DigestIndex, _stored_order, digest, drop_exact_copies, exact_groups
from tabulon.llm.sharding import external_shuffle
from tabulon.session import cut

ROWS = [(1, "Same", "x"), (5, "sAME", "y"), (3, "same", None), (2, None, "z"), (4, "", None), (6, "É", "e"), (7, "é", "e"), (8, "long " * 5000, None), (9, "solo", "s"), (None, "solo", None), (9, "solo", "twice")]
SCHEMA = "doc_id bigint, text string, keep_id string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_groups_of_equal_texts(spark):
    got = exact_groups(spark.createDataFrame(ROWS, SCHEMA)).select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("h"))
    want = Counter()
    for i, text, _ in ROWS:
        own = [j for j, t, _ in ROWS if lowered(t) == lowered(text)]
        want[i, max(j for j in own if j is not None), len(own), hashlib.sha256(lowered(text).encode()).hexdigest()] += 1
    assert Counter(map(tuple, got.collect())) == want


def test_index_persists_and_takes_only_what_is_new(spark, tmp_path):
    where = str(tmp_path / "index")
    batch = lambda first, *texts: spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").select("doc_id", digest(F.col("text")).alias("digest"))
    known = lambda: {(r["keep_id"], r["group_size"]) for r in DigestIndex(spark, where, 4).current().collect()}
    assert DigestIndex(spark, where, 4).add(batch(0, "a", "b", "A")).count() == 2
    assert known() == {(2, 2), (1, 1)}
    assert DigestIndex(spark, where, 4).add(batch(9, "A", "c")).count() == 1
    assert known() == {(9, 3), (1, 1), (10, 1)}
    index = DigestIndex(spark, where, 4)
    index.close()
    index = DigestIndex(spark, where, 4)
    assert known() == {(9, 3), (1, 1), (10, 1)} and index.rows().filter("entry").count() == 3
    plan = batch(0, "a").join(index.rows().filter("entry").select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    index.close(remove=True)
    assert not (tmp_path / "index").exists()


def test_segments_are_read_in_their_order_and_compacted(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4)
    batch = lambda ids: spark.createDataFrame([(i, f"t{i % 30}") for i in ids], "doc_id bigint, text string").select("doc_id", digest(F.col("text")).alias("digest"))
    made = [index.add(batch(ids)).count() for ids in (range(20), range(10, 45), range(40, 90), [])]
    assert made == [20, 10, 0, 0] and index.segments() == [0, 1, 2]
    files = [p.name for p in (tmp_path / "index" / "segment=0").iterdir() if p.name.endswith(".parquet")]
    assert len({name.split("_")[-1].split(".")[0] for name in files}) == len(files) <= 4
    with _stored_order(spark):
        plan = index.unknown(cut(batch(range(100, 140)))).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Sort [") == 1 and plan.count("Exchange") == 1
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"
    small = index.compact(str(tmp_path / "small"), 2)
    rows = lambda i: sorted(map(tuple, i.current().collect()))
    assert rows(small) == rows(index) and len(rows(small)) == 30 and small.segments() == [0] and small.rows().count() == 30
    with pytest.raises(ValueError):
        index.compact(str(tmp_path / "small"))
    assert small.add(batch([7, 1000])).count() == 0 and small.segments() == [0, 1]
    small.close(), index.close()
    every = [*range(20), *range(10, 45), *range(40, 90), 7, 1000]
    got = DigestIndex(spark, str(tmp_path / "small"), 2).current().collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in got) == sorted((max(i for i in every if i % 30 == k), sum(i % 30 == k for i in every)) for k in range(30))


def test_a_continued_index_covers_earlier_calls(spark, tmp_path):
    where = str(tmp_path / "index")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id bigint, text string")
    exact_groups(rows((1, "a"), (5, "b")), location=where, buckets=3, batches=2)
    got = exact_groups(rows((9, "A"), (3, "b"), (4, "c")), location=where, buckets=3, batches=2)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got.collect()) == [(3, 5, 2), (4, 4, 1), (9, 9, 2)]


def test_later_batches_are_dropped_by_the_index(spark, tmp_path, monkeypatch):
    made, add = [], DigestIndex.add
    monkeypatch.setattr(DigestIndex, "add", lambda self, d: made.append((d.count(), (new := add(self, d)).count())) or new)
    exact_groups(spark.createDataFrame([(i, f"t{i % 10}") for i in range(400)], "doc_id bigint, text string")).collect()
    assert len(made) == 4 and sum(n for n, _ in made) == 400 and sum(n for _, n in made) == 10 and made[0][1] == 10


def test_temporary_index_leaves_nothing(spark):
    before = spark.catalog.listTables()
    exact_groups(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert spark.catalog.listTables() == before


def test_rows_equal_but_for_case_or_not_at_all(spark):
    rows = [(5, "Same", "x"), (5, "sAME", "y"), (5, "Same", "z"), (2, "same", None), (None, "other", None), (None, "OTHER", None), (7, None, "n"), (7, "", "e")]
    kept = drop_exact_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [sum(1 for r in kept if r["doc_id"] == i) for i in (5, 2, None, 7)] == [1, 0, 1, 1] and len(kept) == 3


def test_drop_keeps_columns_and_one_row_of_a_group(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7, 8, 9]
    assert drop_exact_copies(df.limit(0)).count() == 0 and exact_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_bytes", [1 << 25, 40])
def test_shuffle_is_whole_even_and_repeatable(spark, bucket_bytes):
    df = spark.createDataFrame([(i, f"text {i % 7}" if i % 11 else None, i) for i in range(203)], "doc_id bigint, text string, size int")
    first, second = ([tuple(r) for r in external_shuffle(df, 8, bucket_bytes=bucket_bytes).select("doc_id", "text", "size", "shard", "slot").collect()] for _ in range(2))
    assert sorted(first) == sorted(second)
    assert Counter(r[:3] for r in first) == Counter(map(tuple, df.collect()))
    slots = {}
    for r in first:
        slots.setdefault(r[3], []).append(r[4])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r[0] for r in sorted(first, key=lambda r: r[3:])]
    assert order != sorted(order)


def test_shuffle_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id bigint, text string")
    assert external_shuffle(df, 8).count() == 3 and external_shuffle(df.limit(0), 8).count() == 0
    with pytest.raises(ValueError):
        external_shuffle(df.withColumnRenamed("text", "slot"), 8, text_col="slot")


def test_checksums_match(spark):
    got = spark.createDataFrame([("é",)], "t string").select(F.crc32(F.col("t").cast("binary"))).first()[0]
    assert got == zlib.crc32("é".encode())
