"""The operators as named queries over the star schema, events, documents and embeddings, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import code, effects, embed
from tabulon.functions.dense import Linear, Norm
from tabulon.operators import align, clean, density, encoder, evaluation, forest, graph, heads, order, projection, ranks, sampling, transformer, vectors
from tabulon.operators import fusion as fusions
from tabulon.plans import graph_dataset, ingest
from tabulon.sources import graphml, syntax
from tabulon.session import cut, spread
from tabulon.streaming import early_stop

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LANGUAGES = ["en", "fr", "de", "es"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Documents without their texts, with labels where there are any."""
    return _table(spark, d, "documents").drop("text").join(_table(spark, d, "labels"), "doc_id", "left")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c, kind in df.dtypes if kind == "double"})  # + 0.0: no negative zero


# Counts, filters, deduplication


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def class_counts(spark, d):
    return clean.class_counts(_table(spark, d, "documents"), "lang").orderBy(F.desc("n"), "lang")


@query("SELECT c.lang, count(d.doc_id) AS n FROM (VALUES ('en'), ('de'), ('it')) c(lang) LEFT JOIN documents d ON d.lang = c.lang GROUP BY c.lang")
def class_counts_fixed_list(spark, d):
    return clean.class_counts(_table(spark, d, "documents"), "lang", ["en", "de", "it"])


@query("""
WITH t AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'doc_id' AS column_name, count(*) FILTER (doc_id IS NULL) AS n_null FROM t UNION ALL
SELECT 'lang', count(*) FILTER (lang IS NULL) FROM t UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM t UNION ALL
SELECT 'n_chars', count(*) FILTER (n_chars IS NULL) FROM t UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL) FROM t UNION ALL
SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM t""")
def null_profile(spark, d):
    return clean.null_profile(_labelled(spark, d))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IS NOT DISTINCT FROM 'en' AND source IS NOT DISTINCT FROM 'src0'")
def subset_kw(spark, d):
    return clean.subset(_table(spark, d, "documents").drop("text"), lang="en", source="src0")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND d.lang IS DISTINCT FROM 'de'")
def known_and_not(spark, d):
    return clean.known_and_not(_labelled(spark, d), "quality", "lang", "de").select("doc_id", "lang", "quality")


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view')")
def membership(spark, d):
    return _table(spark, d, "events").filter(F.col("event_type").isin("click", "view")).select("event_id", "event_type", "value")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def dedup_last(spark, d):
    return clean.keep_last(_table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("""SELECT user_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS seen, max(event_id) AS event_id FROM events GROUP BY user_id, seen
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seen DESC NULLS LAST) = 1 AND (seen IS NOT NULL OR count(*) OVER (PARTITION BY user_id) = 1)""")
def dedup_last_nulls(spark, d):
    """Half the orders are null; users with no other have a row too."""
    seen = F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
    rows = _table(spark, d, "events").groupBy("user_id", seen.alias("seen")).agg(F.max("event_id").alias("event_id"))
    return clean.keep_last(rows, "user_id", "seen")


@query("SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS label_id FROM documents")
def label_encode(spark, d):
    return clean.encode_labels(_table(spark, d, "documents").select("doc_id", "source"), "source")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 130)")
def valid_classes(spark, d):
    return clean.valid_classes(_table(spark, d, "documents").select("doc_id", "lang"), "lang", 130)


@query("SELECT count(*) AS n, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, 1.0::DOUBLE / count(DISTINCT lang) AS baseline FROM documents")
def shape(spark, d):
    langs = F.count_distinct("lang")
    return _table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), langs.alias("n_langs"), (F.lit(1.0) / langs).alias("baseline"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def top_documents(spark, d):
    return _table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(15)


# Sampling

_SPLIT = "CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END"


def _samples(spark, d):
    docs = _table(spark, d, "documents")
    return docs.select("doc_id", F.col("lang").alias("language"), F.expr(_SPLIT).alias("split"), F.concat(F.lit("m"), F.expr("doc_id % 3")).alias("model"), "source")


def _quota_sql(language: str = "lang", model: str = "'m' || (doc_id % 3)", source: str = "source") -> str:
    return f"""
WITH s AS (SELECT doc_id, {language} AS language, {_SPLIT} AS split, {model} AS model, {source} AS source, md5('42:' || doc_id) AS h FROM documents),
m AS (SELECT language, split, count(DISTINCT model) + max((model IS NULL)::INT) AS models FROM s GROUP BY language, split),
q AS (SELECT s.*, CASE s.split WHEN 'train' THEN 120 ELSE 30 END // models AS target,
  count(*) OVER (PARTITION BY s.language, s.split, model) AS total, count(*) OVER (PARTITION BY s.language, s.split, model, source) AS own,
  row_number() OVER (PARTITION BY s.language, s.split, model, source ORDER BY h, doc_id) AS place FROM s JOIN m ON m.language IS NOT DISTINCT FROM s.language AND m.split = s.split WHERE s.split <> 'test'),
k AS (SELECT *, row_number() OVER (PARTITION BY language, split, model ORDER BY source NULLS FIRST, h, doc_id) AS rank FROM q
  WHERE total <= target OR place <= greatest(1, round_even(target * own / total, 0)))
SELECT doc_id, language, split, model, source FROM k WHERE total <= target OR rank <= target
UNION ALL SELECT doc_id, language, split, model, source FROM s WHERE split = 'test'"""


@query(_quota_sql())
def quota_sample(spark, d):
    return sampling.quota_sample(_samples(spark, d), {"train": 120, "val": 30}, "doc_id")


@query(_quota_sql("nullif(lang, 'en')", "CASE WHEN doc_id % 3 > 0 THEN 'm' || (doc_id % 3) END", "nullif(source, 'src3')"))
def quota_sample_nulls(spark, d):
    """One language, model and source are null."""
    rows = _samples(spark, d).withColumns({"language": F.nullif("language", F.lit("en")), "model": F.nullif("model", F.lit("m0")), "source": F.nullif("source", F.lit("src3"))})
    return sampling.quota_sample(rows, {"train": 120, "val": 30}, "doc_id")


def _proportional_sql(source: str) -> str:
    return f"""
WITH q AS (SELECT doc_id, {source} AS source, md5('42:' || doc_id) AS h, count(*) OVER () AS total, count(*) OVER (PARTITION BY {source}) AS own FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS place FROM q),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, h, doc_id) AS rank FROM k WHERE total <= 150 OR place <= greatest(1, round_even(150 * own / total, 0)))
SELECT doc_id, source FROM r WHERE total <= 150 OR rank <= 150"""


@query(_proportional_sql("source"))
def proportional_sample(spark, d):
    return sampling.proportional(_table(spark, d, "documents").select("doc_id", "source"), "source", 150, "doc_id")


@query(_proportional_sql("nullif(source, 'src5')"))
def proportional_sample_nulls(spark, d):
    return sampling.proportional(_table(spark, d, "documents").select("doc_id", F.nullif("source", F.lit("src5")).alias("source")), "source", 150, "doc_id")


def _plot_sql(lang: str) -> str:
    return f"""
WITH q AS (SELECT doc_id, {lang} AS lang, count(*) OVER () AS total, count(*) OVER (PARTITION BY {lang}) AS own, row_number() OVER (PARTITION BY {lang} ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents)
SELECT doc_id, lang FROM q WHERE total <= 150 OR place <= greatest(1, floor(150 * own / total))"""


@query(_plot_sql("lang"))
def plot_sample(spark, d):
    return sampling.floor_sample(_table(spark, d, "documents").select("doc_id", "lang"), "lang", 150, "doc_id")


@query(_plot_sql("nullif(lang, 'de')"))
def plot_sample_nulls(spark, d):
    return sampling.floor_sample(_table(spark, d, "documents").select("doc_id", F.nullif("lang", F.lit("de")).alias("lang")), "lang", 150, "doc_id")


@query("""
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= round_even(0.2 * count(*) OVER (PARTITION BY lang), 0) THEN 'train' ELSE 'test' END AS part FROM documents""")
def split_20_80(spark, d):
    return sampling.split(_table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM documents")
def kfold(spark, d):
    return sampling.folds(_table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("""
WITH m AS (SELECT label AS class_id, vec_id AS member FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 10)),
t AS (SELECT *, unnest(range(0, 5))::INT AS task_id FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id, class_id ORDER BY md5('42:' || task_id || ':' || class_id || ':' || member), member)::INT AS rank FROM t)
SELECT task_id, unnest(range(rank, 11))::INT AS k, class_id, rank, member FROM r WHERE rank <= 10""")
def episodes(spark, d):
    return sampling.episodes(_table(spark, d, "embeddings"), "label", "vec_id", tasks=5, max_shot=10)


@query("SELECT vec_id, ((row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1) // 32)::BIGINT AS batch_id FROM embeddings")
def mini_batches(spark, d):
    return sampling.mini_batches(_table(spark, d, "embeddings").select("vec_id"), "vec_id")


# Statistics


def _kruskal_sql(table: str, label: str, features: list[str], classes: list[str], tail: str, groups: int | None = None) -> str:
    groups = groups or len(classes)
    rows = " UNION ALL ".join(f"SELECT {label} AS c, '{f}' AS feature, {f}::DOUBLE AS v FROM {table} WHERE {label} IN ({', '.join(repr(c) for c in classes)}) AND {f} IS NOT NULL" for f in features)
    return f"""
WITH r AS ({rows}),
k AS (SELECT feature, c, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY feature, v) AS t FROM r),
g AS (SELECT feature, c, sum(rk::DOUBLE) AS s, count(*)::DOUBLE AS n FROM k GROUP BY ALL),
a AS (SELECT feature, count(*)::DOUBLE AS n, sum(t::DOUBLE * t - 1) AS ties FROM k GROUP BY feature),
h AS (SELECT feature, a.n, (12.0::DOUBLE / (a.n * (a.n + 1)) * sum(s * s / g.n) - 3 * (a.n + 1)) / (1 - ties / (a.n * a.n * a.n - a.n)) AS h FROM g JOIN a USING (feature) GROUP BY feature, a.n, ties),
e AS (SELECT feature, n::BIGINT AS n, h, {tail} AS p, (h - {groups} + 1) / (n - {groups}) AS eta2 FROM h)
SELECT feature, n, round(h, 6) AS h, round(p, 6) AS p, round(eta2, 6) AS eta2, CASE WHEN eta2 > 0.06 THEN 'Large' WHEN eta2 >= 0.01 THEN 'Medium' WHEN eta2 > 0 THEN 'Small' ELSE 'Negligible' END AS effect FROM e"""


_LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_kruskal_sql("events", "event_type", ["value"], EVENT_TYPES, "exp(-h / 2) * (1 + h / 2)"))
def kruskal(spark, d):
    return _rounded(ranks.kruskal(_table(spark, d, "events"), "event_type", ["value"], EVENT_TYPES))


@query(_kruskal_sql("lineitem", "l_returnflag", _LINE_FEATURES, ["A", "N", "R"], "exp(-h / 2)"))
def kruskal_multi(spark, d):
    return _rounded(ranks.kruskal(_table(spark, d, "lineitem"), "l_returnflag", _LINE_FEATURES, ["A", "N", "R"])).orderBy(F.desc("eta2"), "feature")


#: The error function as its power series, which serves for the deviates of these tables.
_ERF_SQL = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 100), lambda n: (1 - 2 * (n % 2)) * pow(z / sqrt(2), 2 * n + 1) / (exp(lgamma(n + 1)) * (2 * n + 1))))"


@query(_kruskal_sql("events", "event_type", ["value"], EVENT_TYPES[:4], f"1 - {_ERF_SQL.replace('z /', 'sqrt(h) /')} + sqrt(2 * h / pi()) * exp(-h / 2)", 4))
def kruskal_missing_class(spark, d):
    """Two of the six classes have no values, which leaves an odd number of degrees of freedom."""
    return _rounded(ranks.kruskal(_table(spark, d, "events"), "event_type", ["value"], ["refund", *EVENT_TYPES[:4], "return"]))


_PAIRS_SQL = f"""
WITH c AS (SELECT unnest({EVENT_TYPES}) AS c, unnest(range(0, {len(EVENT_TYPES)})) AS ord),
p AS (SELECT a.c AS first, b.c AS second FROM c a JOIN c b ON a.ord < b.ord),
r AS (SELECT first, second, event_type = first AS mine, value, rank() OVER w + (count(*) OVER (PARTITION BY first, second, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY first, second, value) AS t
  FROM p JOIN events ON event_type IN (first, second) WHERE value IS NOT NULL WINDOW w AS (PARTITION BY first, second ORDER BY value)),
s AS (SELECT first, second, count(*) FILTER (mine) AS n1, count(*) FILTER (NOT mine) AS n2, sum(rk::DOUBLE) FILTER (mine) - count(*) FILTER (mine) * (count(*) FILTER (mine) + 1) / 2.0::DOUBLE AS u, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY ALL),
z AS (SELECT *, (abs(u - n1 * n2 / 2.0::DOUBLE) - 0.5) / sqrt(n1::DOUBLE * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS z, 2 * u / (n1::DOUBLE * n2) - 1 AS delta FROM s),
e AS (SELECT *, CASE WHEN abs(delta) >= 0.474 THEN 'Large' WHEN abs(delta) >= 0.33 THEN 'Medium' WHEN abs(delta) >= 0.147 THEN 'Small' ELSE 'Negligible' END AS effect FROM z)
"""


@query(_PAIRS_SQL + "SELECT 'value' AS feature, first, second, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(delta, 6) AS delta, effect FROM e")
def mann_whitney(spark, d):
    return _rounded(ranks.mann_whitney(_table(spark, d, "events"), "event_type", ["value"], EVENT_TYPES))


@query("""
WITH RECURSIVE x AS (SELECT s_nationkey AS c, s_acctbal AS v FROM supplier WHERE s_acctbal IS NOT NULL),
p AS (SELECT a.c AS first, b.c AS second, count(DISTINCT a.v) AS n1, count(DISTINCT b.v) AS n2, sum((a.v > b.v)::INT + (a.v = b.v)::INT / 2) AS u, max((a.v = b.v)::INT) AS tied FROM x a JOIN x b ON a.c < b.c GROUP BY a.c, b.c),
w AS (
  SELECT 0 AS m, 0 AS n, 0 AS u, 1::DOUBLE AS ways UNION ALL
  SELECT m, n, u, sum(ways) FROM (SELECT m + s AS m, n + 1 - s AS n, u + s * n AS u, ways FROM w, (SELECT unnest([0, 1]) AS s) WHERE m + n < 16) GROUP BY m, n, u)
SELECT 's_acctbal' AS feature, first::VARCHAR AS first, second::VARCHAR AS second, n1, n2, u,
  round(least(1, 2 * (SELECT sum(ways) FROM w WHERE m = n1 AND n = n2 AND w.u <= least(p.u, n1 * n2 - p.u)) / (SELECT sum(ways) FROM w WHERE m = n1 AND n = n2)), 9) AS p
FROM p WHERE n1 <= 8 AND n2 <= 8 AND tied = 0""")
def mann_whitney_exact(spark, d):
    """The pairs of nations with few suppliers, whose p is exact."""
    rows = _table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("nation"), "s_acctbal")
    out = ranks.mann_whitney_p(rows, "nation", ["s_acctbal"], [str(i) for i in range(25)]).filter("method = 'exact' AND n1 <= 8 AND n2 <= 8")
    return _rounded(out.select("feature", "first", "second", "n1", "n2", "u", "p"), 9)


@query(_PAIRS_SQL + f"""
SELECT 'value' AS feature, first || ' vs ' || second AS pair, round_even(u, 0) AS u, round_even(p * 10, 6) AS p_adjusted, CASE WHEN p < 0.005 THEN 'Yes' ELSE 'No' END AS significant, round_even(delta, 3) + 0 AS delta, effect
FROM (SELECT *, least(1, 1 - {_ERF_SQL}) AS p FROM e)""")
def pairwise_table(spark, d):
    out = ranks.pairwise_table(_table(spark, d, "events"), "event_type", ["value"], EVENT_TYPES)
    return out.withColumn("delta", F.col("delta") + 0.0)


@query("SELECT o_orderkey, round((coalesce(o_totalprice, 0) - avg(coalesce(o_totalprice, 0)) OVER ()) / stddev_pop(coalesce(o_totalprice, 0)) OVER (), 6) AS o_totalprice FROM orders")
def standardise(spark, d):
    return _rounded(ranks.standardise(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query("SELECT doc_id, round(least(n_chars, (SELECT quantile_cont(n_chars, 0.99) FROM documents)), 6) AS n_chars FROM documents")
def clip99(spark, d):
    return _rounded(ranks.clip_at_quantile(_table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars"))


@query("""SELECT event_id, CASE WHEN value / 1000 < 0.001 THEN 'p < 0.001' WHEN value / 1000 < 0.01 THEN 'p < 0.01' WHEN value / 1000 < 0.05 THEN 'p < 0.05' ELSE printf('p = %.3f', value / 1000) END AS shown FROM events WHERE value IS NOT NULL""")
def format_p(spark, d):
    return _table(spark, d, "events").filter("value IS NOT NULL").select("event_id", effects.format_p(F.col("value") / 1000).alias("shown"))


@query(f"SELECT event_id, event_type FROM events WHERE event_type IN ({', '.join(map(repr, EVENT_TYPES))}) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) <= 300")
def capped_sample(spark, d):
    rows = _table(spark, d, "events").select("event_id", "event_type").filter(F.col("event_type").isin(EVENT_TYPES))
    return ranks.capped(rows, "event_type", "event_id", 300)


# Evaluation: the language told from its letters, against the language given

_GUESS_SQL = "CASE WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[ñó]') THEN 'es' WHEN regexp_matches(text, '[éèç]') THEN 'fr' ELSE 'en' END"
_GRID_SQL = f"""
WITH p AS (SELECT lang AS truth, {_GUESS_SQL} AS predicted FROM documents), l AS (SELECT unnest({LANGUAGES}) AS c, unnest(range(0, 4)) AS ord),
g AS (SELECT a.c AS truth, b.c AS predicted, a.ord AS i, b.ord AS j, (SELECT count(*) FROM p WHERE p.truth = a.c AND p.predicted = b.c) AS n FROM l a, l b),
x AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY truth) > 0 THEN n::DOUBLE / sum(n) OVER (PARTITION BY truth) ELSE 0 END AS rate FROM g)"""


def _guessed(spark, d):
    text = F.col("text")
    guess = F.when(text.rlike("[äöüß]"), "de").when(text.rlike("[ñó]"), "es").when(text.rlike("[éèç]"), "fr").otherwise("en")
    return _table(spark, d, "documents").select("doc_id", F.col("lang").alias("truth"), guess.alias("predicted"))


@query(_GRID_SQL + " SELECT truth, predicted, n, round(rate, 6) AS rate FROM x")
def confusion(spark, d):
    return _rounded(evaluation.confusion(_guessed(spark, d), "truth", "predicted", LANGUAGES))


@query(_GRID_SQL + " SELECT truth AS class, round(rate, 6) AS recall FROM x WHERE truth = predicted")
def recall(spark, d):
    return _rounded(evaluation.recall(evaluation.confusion(_guessed(spark, d), "truth", "predicted", LANGUAGES)))


@query(_GRID_SQL + " SELECT truth, predicted, round(rate, 6) AS rate FROM x WHERE truth <> predicted ORDER BY rate DESC, i, j LIMIT 5")
def top_confusions(spark, d):
    return _rounded(evaluation.top_confusions(evaluation.confusion(_guessed(spark, d), "truth", "predicted", LANGUAGES), LANGUAGES))


@query(f"""
WITH p AS (SELECT lang AS t, {_GUESS_SQL} AS p FROM documents WHERE lang IS NOT NULL), c AS (SELECT DISTINCT unnest([t, p]) AS c FROM p),
f AS (SELECT c, 2.0::DOUBLE * (SELECT count(*) FROM p WHERE t = c AND p.p = c) / ((SELECT count(*) FROM p WHERE t = c) + (SELECT count(*) FROM p WHERE p.p = c)) AS f1 FROM c)
SELECT count(*) AS n, round(avg((t = p)::INT), 6) AS accuracy, (SELECT round(avg(f1), 6) FROM f) AS macro_f1, count(DISTINCT t) AS n_classes, round(1.0::DOUBLE / count(DISTINCT t), 6) AS baseline FROM p""")
def scores(spark, d):
    return _rounded(evaluation.scores(_guessed(spark, d), "truth", "predicted"))


# Code text


@query("SELECT doc_id AS idx, md5(text) AS hash, source AS target, lang AS model FROM documents")
def md5_record(spark, d):
    return _table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.md5(F.col("text").cast("binary")).alias("hash"), F.col("source").alias("target"), F.col("lang").alias("model"))


@query("""
SELECT p_partkey, 'h' || printf('%08x', list_reduce(list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)) AS name_hash FROM part WHERE length(p_name) > 0""")
def fnv_hash(spark, d):
    return _table(spark, d, "part").filter("length(p_name) > 0").select("p_partkey", code.fnv1a(F.col("p_name")).alias("name_hash"))


@query("""
SELECT p_partkey, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(p_name || ' for ' || p_type || ' in x_1', '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\b', 1), lambda w: w NOT IN ('for', 'in')))), ' '), '') AS names FROM part""")
def identifiers(spark, d):
    text = F.concat_ws(" ", "p_name", F.lit("for"), "p_type", F.lit("in x_1"))
    return _table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(code.identifiers(text, "python")), " ").alias("names"))


@query(r"""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name || ' = ' || p_type, '(\w+|\W+)'), lambda w: CASE WHEN regexp_matches(w, '^[a-zA-Z_][a-zA-Z0-9_]*$')
  THEN 'h' || printf('%08x', list_reduce(list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)) ELSE w END), '') AS hidden FROM part""")
def obfuscate(spark, d):
    text = F.concat_ws(" = ", "p_name", "p_type")
    return _table(spark, d, "part").select("p_partkey", code.obfuscate(text, "python").alias("hidden"))


_RUNS_SQL = r"regexp_extract_all(text, '([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)')"


def _words_sql(language: str) -> str:
    return ", ".join(f"'{w}'" for w in code.RESERVED[language])


@query(f"""
SELECT doc_id, md5(coalesce(array_to_string(list_sort(list_distinct(list_filter({_RUNS_SQL}, lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*') AND w NOT IN ({_words_sql("python")})))), ' '), '')) AS names FROM documents WHERE text IS NOT NULL""")
def document_identifiers(spark, d):
    docs = _table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.md5(F.array_join(F.array_sort(code.identifiers(F.col("text"), "python")), " ").cast("binary")).alias("names"))


@query(f"""
SELECT doc_id, md5(array_to_string(list_transform({_RUNS_SQL}, lambda w: CASE WHEN regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*') AND w NOT IN ({_words_sql("java")})
  THEN 'h' || printf('%08x', list_reduce(list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)) ELSE w END), '')) AS hidden FROM documents WHERE text IS NOT NULL""")
def document_obfuscation(spark, d):
    docs = _table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.md5(code.obfuscate(F.col("text"), "java").cast("binary")).alias("hidden"))


#: Combining marks after the letters e and o, a superscript and a connector, which not all engines take for parts of words.
_MARKS = [("e", "e\u0301"), ("o", "o\u0308 x\u00b2"), (" a", " a\u203fb")]


@query(f"""
WITH d AS (SELECT doc_id, replace(replace(replace(text, 'e', 'e\u0301'), 'o', 'o\u0308 x\u00b2'), ' a', ' a\u203fb') AS text FROM documents)
SELECT doc_id, md5(coalesce(array_to_string(list_sort(list_distinct(list_filter({_RUNS_SQL}, lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*') AND w NOT IN ({_words_sql("python")})))), ' '), '')) AS names,
  md5(array_to_string(list_transform({_RUNS_SQL}, lambda w: CASE WHEN regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*') AND w NOT IN ({_words_sql("python")})
  THEN 'h' || printf('%08x', list_reduce(list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)) ELSE w END), '')) AS hidden FROM d WHERE text IS NOT NULL""")
def marked_identifiers(spark, d):
    """Names and obfuscation of texts with combining marks, superscripts and connectors."""
    text = reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), _MARKS, F.col("text"))
    docs = _table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", text.alias("text"))
    return docs.select("doc_id", F.md5(F.array_join(F.array_sort(code.identifiers(F.col("text"), "python")), " ").cast("binary")).alias("names"), F.md5(code.obfuscate(F.col("text"), "python").cast("binary")).alias("hidden"))


@query("""
SELECT p_partkey, concat_ws(', ', 'p_brand=''' || replace(p_brand, '''', '\\''') || '''', 'p_name=''' || replace(replace(p_name, chr(10), '\\n'), '''', '\\''') || '''', 'p_size=''' || p_size || '''') AS shown,
  '[' || p_type || '] p_brand=''' || p_brand || '''' AS labelled, CASE WHEN length(p_name) > 20 THEN left(p_name, 20) || '...' ELSE p_name END AS short FROM part""")
def attr_string(spark, d):
    pair = lambda c: F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))
    every = F.array(pair("p_size"), pair("p_name"), pair("p_type"), pair("p_brand"))
    return _table(spark, d, "part").select("p_partkey", code.attributes(every, "p_type").alias("shown"), code.labelled(F.col("p_type"), code.attributes(F.array(pair("p_brand")), "")).alias("labelled"), code.shorten(F.col("p_name")).alias("short"))


@query("SELECT page_id, (length(html) - length(replace(html, '<p', ''))) // 2 AS n_p, (length(html) - length(replace(html, '<a ', ''))) // 3 AS n_a FROM pages")
def substring_counts(spark, d):
    count = lambda s: F.regexp_count("html", F.lit(s)).cast("long")
    return _table(spark, d, "pages").select("page_id", count("<p").alias("n_p"), count("<a ").alias("n_a"))


# Typed graphs: one graph a nation, of the nation, its customers and their orders. Edges from suppliers are dangling.

_NODES_SQL = """
WITH nodes AS (
  SELECT n_nationkey AS graph, 'n' || n_nationkey AS node, 'nation' AS type, 0::BIGINT AS pos FROM nation UNION ALL
  SELECT c_nationkey, 'c' || c_custkey, 'customer', 10000000000 + c_custkey FROM customer UNION ALL
  SELECT c_nationkey, 'o' || o_orderkey, 'order', 20000000000 + o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
edges AS (
  SELECT c_nationkey AS graph, 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'lives_in' AS rel, c_custkey AS epos FROM customer UNION ALL
  SELECT c_nationkey, 'o' || o_orderkey, 'c' || c_custkey, 'placed_by', 10000000000 + o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL
  SELECT s_nationkey, 's' || s_suppkey, 'n' || s_nationkey, 'lives_in', 20000000000 + s_suppkey FROM supplier),
placed AS (SELECT *, row_number() OVER (PARTITION BY graph, type ORDER BY pos, node) - 1 AS type_pos, row_number() OVER (PARTITION BY graph ORDER BY pos, node) - 1 AS pos0 FROM nodes)
"""


def _star(spark: SparkSession, d: str, vectors: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes, with a vector ``x`` each on demand, and edges of the nations, their customers and these' orders."""
    nation, customer, supplier = (_table(spark, d, t) for t in ("nation", "customer", "supplier"))
    orders = _table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    orders = cut(orders.select("c_nationkey", "o_orderkey", "c_custkey", "o_totalprice")) if vectors else orders  # for the sample of ranges, the nodes and the edges
    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    late = lambda n, key: (F.lit(n * 10_000_000_000) + F.col(key)).cast("long")
    x = lambda a, b: [F.array(F.col(a).cast("double") if isinstance(a, str) else a.cast("double"), F.lit(b).cast("double")).alias("x")] if vectors else []
    nodes = [
        nation.select(F.col("n_nationkey").alias("graph"), name("n", "n_nationkey").alias("node"), F.lit("nation").alias("type"), F.lit(0).cast("long").alias("pos"), *x("n_regionkey", 1)),
        customer.select("c_nationkey", name("c", "c_custkey"), F.lit("customer"), late(1, "c_custkey"), *x(F.col("c_acctbal") / 1000, 0.5)),
        orders.select("c_nationkey", name("o", "o_orderkey"), F.lit("order"), late(2, "o_orderkey"), *x(F.col("o_totalprice") / 100000, -1)),
    ]
    edges = [
        customer.select(F.col("c_nationkey").alias("graph"), name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"), F.lit("lives_in").alias("rel"), F.col("c_custkey").alias("epos")),
        orders.select("c_nationkey", name("o", "o_orderkey"), name("c", "c_custkey"), F.lit("placed_by"), late(1, "o_orderkey")),
        supplier.select("s_nationkey", name("s", "s_suppkey"), name("n", "s_nationkey"), F.lit("lives_in"), late(2, "s_suppkey")),
    ]
    return reduce(DataFrame.union, nodes), reduce(DataFrame.union, edges)


@query(_NODES_SQL + "SELECT graph, node, type, type_pos, pos0 FROM placed")
def hetero_index(spark, d):
    return graph.index_nodes(_star(spark, d)[0]).drop("pos")


@query(_NODES_SQL + """SELECT e.graph, e.source, e.target, e.rel, s.type AS src_type, t.type AS dst_type, s.type_pos AS src_pos, t.type_pos AS dst_pos
FROM edges e JOIN placed s ON s.graph = e.graph AND s.node = e.source JOIN placed t ON t.graph = e.graph AND t.node = e.target""")
def hetero_edges(spark, d):
    return graph.typed_edges(*_star(spark, d)).select("graph", "source", "target", "rel", "src_type", "dst_type", "src_pos", "dst_pos")


@query(_NODES_SQL + "SELECT graph, source, target, rel FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph = e.graph AND n.node = e.source) OR NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph = e.graph AND n.node = e.target)")
def dangling_edges(spark, d):
    return graph.dangling_edges(*_star(spark, d)).select("graph", "source", "target", "rel")


@query(_NODES_SQL + """, r AS (SELECT graph, source, target, rel, CASE WHEN epos % 3 > 0 THEN 7 END AS epos FROM edges)
SELECT graph, source, target, rel, epos FROM r e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph = e.graph AND n.node = e.source) OR NOT EXISTS (SELECT 1 FROM nodes n WHERE n.graph = e.graph AND n.node = e.target)""")
def dangling_edges_repeated(spark, d):
    """The places of all edges are equal or null."""
    nodes, edges = _star(spark, d)
    return graph.dangling_edges(nodes, edges.withColumn("epos", F.when(F.col("epos") % 3 > 0, 7))).select("graph", "source", "target", "rel", "epos")


@query(_NODES_SQL + "SELECT DISTINCT type FROM nodes")
def type_catalog(spark, d):
    return graph.type_catalog(_star(spark, d)[0])


@query(_NODES_SQL + "SELECT g.graph, t.type, (SELECT count(*) FROM nodes n WHERE n.graph = g.graph AND n.type = t.type) AS n FROM (SELECT DISTINCT graph FROM nodes) g, (SELECT DISTINCT type FROM nodes) t")
def padded_catalog(spark, d):
    return graph.padded_counts(_star(spark, d)[0])


@query("""
WITH m AS (SELECT o_custkey, avg(o_totalprice) AS mean FROM orders GROUP BY o_custkey)
SELECT 'customer' AS type, 'c' || c_custkey AS node, 0 AS dim, round(greatest(0.5 * coalesce(mean, 0) - 2.0 * c_acctbal, 0) + c_acctbal, 6) AS value FROM customer LEFT JOIN m ON o_custkey = c_custkey""")
def sage_layer(spark, d):
    customer, orders = _table(spark, d, "customer"), _table(spark, d, "orders")
    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    states = customer.select(F.lit("customer").alias("type"), name("c", "c_custkey").alias("node"), F.lit(0).alias("dim"), F.col("c_acctbal").alias("value"))
    states = states.union(orders.select(F.lit("order"), name("o", "o_orderkey"), F.lit(0), "o_totalprice"))
    edges = orders.select(F.lit("order").alias("src_type"), name("o", "o_orderkey").alias("source"), F.lit("placed_by").alias("rel"), F.lit("customer").alias("dst_type"), name("c", "o_custkey").alias("target"))
    weights = spark.createDataFrame([("placed_by", 0, 0, 0.5, -2.0)], "rel string, out_dim int, in_dim int, w_l double, w_r double")
    return _rounded(graph.sage_layer(states, edges, weights))


# Vectors

_UNNESTED = "(SELECT *, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS dim FROM embeddings)"


@query(f"SELECT label, dim, round(sum(x * (vec_id % 3 > 0)::INT) / greatest(sum((vec_id % 3 > 0)::INT), 1e-6), 5) + 0 AS value FROM {_UNNESTED} GROUP BY label, dim")
def mean_pool(spark, d):
    rows = _table(spark, d, "embeddings").withColumn("mask", (F.col("vec_id") % 3 > 0).cast("int"))
    return _rounded(vectors.mean_pool(rows, "label", "embedding", "mask"), 5)


@query(f"""
WITH m AS (SELECT vec_id % 7 AS graph, label % 3 AS type, dim, avg(x) AS m FROM {_UNNESTED} WHERE vec_id % 7 <> label % 3 GROUP BY ALL)
SELECT graph, dim, round(sum(m) / 3, 5) + 0 AS value FROM m GROUP BY graph, dim""")
def type_pool(spark, d):
    rows = _table(spark, d, "embeddings").select((F.col("vec_id") % 7).alias("graph"), (F.col("label") % 3).alias("type"), F.posexplode("embedding").alias("dim", "value")).filter("graph <> type")
    return _rounded(graph.type_pool(rows.withColumn("value", F.col("value").cast("double"))), 5)


@query(f"SELECT vec_id, dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12), 5) + 0 AS value FROM {_UNNESTED}")
def l2_norm(spark, d):
    unit = vectors.l2_normalise(F.col("embedding"))
    return _rounded(_table(spark, d, "embeddings").select("vec_id", F.posexplode(unit).alias("dim", "value")), 5)


@query(f"WITH u AS {_UNNESTED} SELECT a.dim AS i, b.dim AS j, round(sum(a.x * b.x) / (SELECT count(*) FROM embeddings), 5) + 0 AS value FROM u a JOIN u b USING (vec_id) GROUP BY a.dim, b.dim")
def gram(spark, d):
    return _rounded(vectors.gram(_table(spark, d, "embeddings"), "embedding"), 5)


@query(f"""
WITH u AS {_UNNESTED}, w AS (SELECT vec_id, dim, x * x + label AS x FROM u),
c AS (SELECT a.dim AS i, b.dim AS j, (sum(a.x * b.x) - sum(a.x) * sum(b.x) / count(*)) / (count(*) - 1 + 1e-8) AS v FROM u a JOIN w b ON a.vec_id = b.vec_id GROUP BY a.dim, b.dim)
SELECT round(avg(v * v), 5) AS penalty FROM c""")
def cross_penalty(spark, d):
    """Of the vectors and of their squares, to which the label is added."""
    other = F.transform("embedding", lambda x: x.cast("double") * x.cast("double") + F.col("label"))
    return _rounded(vectors.cross_penalty(_table(spark, d, "embeddings").withColumn("other", other), "embedding", "other"), 5)


@query("""
WITH e AS (SELECT vec_id, vec_id // 32 AS batch, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, batch, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS x, list_transform(list_reverse(v), lambda x: x / sqrt(list_dot_product(v, v))) AS y FROM e),
s AS (SELECT a.batch, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.x, b.y) * 10 AS s FROM n a JOIN n b USING (batch)),
l AS (SELECT *, ln(sum(exp(s)) OVER (PARTITION BY batch, i)) AS li, ln(sum(exp(s)) OVER (PARTITION BY batch, j)) AS lj FROM s)
SELECT batch, round((avg(li - s) + avg(lj - s)) / 2, 5) AS loss FROM l WHERE i = j GROUP BY batch""")
def contrastive(spark, d):
    rows = _table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 32).cast("long").alias("batch"), "vec_id", "embedding", F.reverse("embedding").alias("other"))
    return _rounded(vectors.contrastive(rows, "batch", "vec_id", "embedding", "other", scale=10.0), 5)


@query("""
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, 0.01 + 0.98 / (1 + exp(embedding[2]::DOUBLE - embedding[1]::DOUBLE)) AS g FROM embeddings),
u AS (SELECT vec_id, g, unnest(a) AS x, unnest(list_reverse(a)) AS y, generate_subscripts(a, 1)::INT - 1 AS dim FROM w)
SELECT vec_id, dim, round(g * x + (1 - g) * y, 5) + 0 AS value FROM u""")
def fusion(spark, d):
    e = F.col("embedding")
    weights = vectors.routing(F.transform(F.slice(e, 1, 2), lambda x: x.cast("double")))
    rows = _table(spark, d, "embeddings").select("vec_id", "embedding", weights.alias("w"))
    return _rounded(rows.select("vec_id", F.posexplode(vectors.fuse(e, F.reverse(e), F.col("w"))).alias("dim", "value")), 5)


def _weights(outputs: int, inputs: int, seed: int, scale: float = 60.0) -> Linear:
    """A fixed linear map by rule."""
    i, j = np.arange(outputs)[:, None], np.arange(inputs)[None]
    return Linear(((31 * i + 17 * j + 7 * seed) % 23 - 11) / scale, (np.arange(outputs) * 5 + seed) % 7 / 20 - 0.15)


def _linear_sql(x: str, outputs: int, inputs: int, seed: int, scale: float = 60.0) -> str:
    """What ``_weights`` makes of the list ``x``."""
    row = f"list_transform(range(0, {inputs}), lambda j: ((31 * o + 17 * j + 7 * {seed}) % 23 - 11)::DOUBLE / {scale})"
    return f"list_transform(range(0, {outputs}), lambda o: list_dot_product({x}, {row}) + ((o * 5 + {seed}) % 7)::DOUBLE / 20 - 0.15::DOUBLE)"


def _gelu_sql(x: str) -> str:
    return f"list_transform({x}, lambda z: z * (1 + {_ERF_SQL}) / 2)"


@query(f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings),
n AS (SELECT vec_id, a, list_reverse(a) AS b, list_transform(a, lambda x: x / greatest(sqrt(list_dot_product(a, a)), 1e-12)) AS u FROM v),
r AS (SELECT vec_id, {_linear_sql(_gelu_sql(_linear_sql("list_concat(u, list_reverse(u))", 16, 128, 1)), 2, 16, 2)} AS s, {_gelu_sql(_linear_sql("a", 32, 64, 3))} AS ea, {_gelu_sql(_linear_sql("b", 32, 64, 4))} AS eb FROM n),
w AS (SELECT *, 0.01 + 0.98 / (1 + exp(s[2] - s[1])) AS g FROM r),
f AS (SELECT vec_id, g, list_transform(range(1, 33), lambda i: g * ea[i] + (1 - g) * eb[i]) AS f FROM w),
c AS (SELECT vec_id, list_concat(list_concat([g, 1 - g], f), {_linear_sql("f", 10, 32, 5)}) AS values FROM f),
p AS (SELECT vec_id, values, list_position(values[35:], list_max(values[35:])) - 1 AS predicted FROM c)
SELECT vec_id, predicted::INT AS predicted, unnest(range(0, 44))::INT AS dim, round(unnest(values), 5) + 0 AS value FROM p""")
def gated_fusion(spark, d):
    """Routing weights, fused vector and class scores of every embedding, from fixed weights: 64 numbers, 32 an expert, 10 classes."""
    model = fusions.GatedFusion(_weights(32, 64, 3), _weights(32, 64, 4), _weights(10, 32, 5), (_weights(16, 128, 1), _weights(2, 16, 2)))
    rows = _table(spark, d, "embeddings").select("vec_id", "embedding", F.reverse("embedding").alias("other"))
    out = fusions.gated_fusion(rows, "embedding", "other", model)
    return _rounded(out.select("vec_id", "predicted", F.posexplode(F.concat("routing", "fused", "scores")).alias("dim", "value")), 5)


_PROJECTED = "list_transform(range(0, 4), lambda o: list_dot_product({x}, list_transform(range(0, 64), lambda j: ((31 * o + 17 * j + 7 * {seed}) % 23 - 11)::DOUBLE / 60)))"


@query(f"""
WITH v AS (SELECT vec_id, vec_id // 32 AS batch, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings),
p AS (SELECT vec_id, batch, {_PROJECTED.format(x="a", seed=8)} AS g, {_PROJECTED.format(x="list_reverse(a)", seed=9)} AS t FROM v),
n AS (SELECT *, count(*) OVER (PARTITION BY batch) AS n, list_transform(g, lambda z: z / sqrt(list_dot_product(g, g))) AS u, list_transform(t, lambda z: z / sqrt(list_dot_product(t, t))) AS w FROM p),
s AS (SELECT a.batch, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.u, b.w) * 10 AS s FROM n a JOIN n b ON a.batch = b.batch WHERE a.n > 1),
l AS (SELECT *, ln(sum(exp(s)) OVER (PARTITION BY batch, i)) AS li, ln(sum(exp(s)) OVER (PARTITION BY batch, j)) AS lj FROM s),
c AS (SELECT batch, count(*) AS n, (avg(li - s) + avg(lj - s)) / 2 AS contrastive FROM l WHERE i = j GROUP BY batch),
d AS (SELECT vec_id, batch, unnest(g) AS g, unnest(t) AS t, unnest(u) AS u, unnest(range(0, 4)) AS k FROM n),
q AS (SELECT a.batch, a.k AS i, b.k AS j, sum(a.u * b.u) / count(*) AS c, (sum(a.g * b.t) - sum(a.g) * sum(b.t) / count(*)) / (count(*) - 1 + 1e-6::DOUBLE) AS x FROM d a JOIN d b ON a.batch = b.batch AND a.vec_id = b.vec_id GROUP BY ALL),
m AS (SELECT batch, sum(c * c) / 4 - pow(sum(CASE WHEN i = j THEN c ELSE 0 END) / 4, 2) AS isotropy, avg(x * x) AS "cross" FROM q GROUP BY batch)
SELECT batch, n, round(contrastive, 5) AS contrastive, round(isotropy, 5) AS isotropy, round("cross", 5) AS "cross", round(contrastive + isotropy + 0.5::DOUBLE / (contrastive + 1e-6::DOUBLE) * "cross", 5) AS total
FROM c JOIN m USING (batch)""")
def alignment_losses(spark, d):
    """The terms of the pre-training loss in every batch of embeddings, projected to 4 numbers by fixed weights."""
    rows = _table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 32).cast("long").alias("batch"), "embedding", F.reverse("embedding").alias("other"))
    weights = {"first": _weights(4, 64, 8).weight, "second": _weights(4, 64, 9).weight, "scale": np.array([np.log(10.0)])}
    return _rounded(align.batch_losses(rows, "batch", "embedding", "other", weights), 5)


#: Tokens of the small model's texts, its places and its layer, all by rule.
_VOCABULARY, _PLACES = 500, 512


def _small_transformer() -> transformer.Transformer:
    token, place, k = np.arange(_VOCABULARY + 1)[:, None], np.arange(_PLACES)[:, None], np.arange(4)[None]
    norm = lambda n: Norm(1 + np.arange(4) / 10 * n, np.arange(4) / 20)
    linear = lambda o, i, seed: _weights(o, i, seed, 8.0)
    layer = transformer.Layer(linear(4, 4, 1), linear(4, 4, 2), linear(4, 4, 3), linear(4, 4, 4), norm(1), linear(6, 4, 5), linear(4, 6, 6), norm(2), heads=2)
    return transformer.Transformer((token * (k + 3) % 17 - 8) / 16, (place * (k + 1) % 5 - 2) / 10, [layer], projection=linear(3, 4, 7))


def _norm_sql(x: str, n: int) -> str:
    centred = f"list_transform({x}, lambda c: c - list_avg({x}))"
    return f"list_transform(range(1, 5), lambda i: ({centred})[i] / sqrt(list_dot_product({centred}, {centred}) / 4 + 1e-5::DOUBLE) * (1 + (i - 1)::DOUBLE / 10 * {n}) + (i - 1)::DOUBLE / 20)"


_STATES_SQL = rf"""
WITH c AS (SELECT conv_id || ':' || turn AS key, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM conversations),
t AS (SELECT key, unnest(range(0, least(len(words), {_PLACES}))) AS p, unnest(words[1:{_PLACES}]) AS w FROM c),
e AS (SELECT key, p, 1 + ('0x' || substr(md5(w), 1, 8))::BIGINT % {_VOCABULARY} AS id FROM t),
x AS (SELECT key, p, list_transform(range(0, 4), lambda k: (id * (k + 3) % 17 - 8)::DOUBLE / 16 + (p * (k + 1) % 5 - 2)::DOUBLE / 10) AS x FROM e),
q AS (SELECT key, p, x, {_linear_sql("x", 4, 4, 1, 8.0)} AS q, {_linear_sql("x", 4, 4, 2, 8.0)} AS k, {_linear_sql("x", 4, 4, 3, 8.0)} AS v FROM x),
s AS (SELECT a.key, a.p, any_value(a.x) AS x, sum(exp(list_dot_product(a.q[1:2], b.k[1:2]) / sqrt(2))) AS n1, sum(exp(list_dot_product(a.q[3:4], b.k[3:4]) / sqrt(2))) AS n2,
  sum(exp(list_dot_product(a.q[1:2], b.k[1:2]) / sqrt(2)) * b.v[1]) AS v1, sum(exp(list_dot_product(a.q[1:2], b.k[1:2]) / sqrt(2)) * b.v[2]) AS v2,
  sum(exp(list_dot_product(a.q[3:4], b.k[3:4]) / sqrt(2)) * b.v[3]) AS v3, sum(exp(list_dot_product(a.q[3:4], b.k[3:4]) / sqrt(2)) * b.v[4]) AS v4 FROM q a JOIN q b USING (key) GROUP BY a.key, a.p),
o AS (SELECT key, p, x, {_linear_sql("[v1 / n1, v2 / n1, v3 / n2, v4 / n2]", 4, 4, 4, 8.0)} AS o FROM s),
h AS (SELECT key, p, list_transform(range(1, 5), lambda i: x[i] + o[i]) AS h FROM o),
m AS (SELECT key, p, {_norm_sql("h", 1)} AS y FROM h),
u AS (SELECT key, p, y, list_transform({_linear_sql("y", 6, 4, 5, 8.0)}, lambda z: greatest(z, 0)) AS u FROM m),
d AS (SELECT key, p, list_transform(range(1, 5), lambda i: y[i] + ({_linear_sql("u", 4, 6, 6, 8.0)})[i]) AS d FROM u),
z AS (SELECT key, p, {_norm_sql("d", 2)} AS z FROM d)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")


@query(_STATES_SQL + f""",
g AS (SELECT key, [avg(z[1]), avg(z[2]), avg(z[3]), avg(z[4])] AS g FROM z GROUP BY key)
SELECT key, round(p[1], 5) + 0 AS x, round(p[2], 5) + 0 AS y, round(p[3], 5) + 0 AS z FROM (SELECT key, {_linear_sql("g", 3, 4, 7, 8.0)} AS p FROM g) UNION ALL
SELECT key, NULL, NULL, NULL FROM c WHERE len(words) = 0""")
def text_encoder(spark, d):
    """The pooled vector of every turn, from a Transformer of one layer, two heads and four numbers."""
    ids = embed.token_ids(_turns(spark, d), "text", embed.hashing_tokens(_VOCABULARY), _PLACES, None)
    out = transformer.encode_texts(ids, "input_ids", _small_transformer())
    return _rounded(out.select("key", *[F.get("vector", F.lit(i)).alias(n) for i, n in enumerate("xyz")]), 5)


@query(_STATES_SQL + " SELECT key, p::INT AS position, round(z[1], 5) + 0 AS x0, round(z[2], 5) + 0 AS x1, round(z[3], 5) + 0 AS x2, round(z[4], 5) + 0 AS x3 FROM z")
def token_vectors(spark, d):
    """The vector of every token of every turn."""
    out = embed.token_vectors(_turns(spark, d), "key", "text", embed.hashing_tokens(_VOCABULARY), _small_transformer())
    return _rounded(out.select("key", "position", *[F.get("vector", F.lit(i)).alias(f"x{i}") for i in range(4)]), 5)


@query(f"""
WITH u AS (SELECT vec_id, dim, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12) AS x FROM {_UNNESTED}),
g AS (SELECT a.dim AS i, b.dim AS j, sum(a.x * b.x) / (SELECT count(*) FROM embeddings) AS v FROM u a JOIN u b USING (vec_id) GROUP BY a.dim, b.dim)
SELECT round(sum(v * v) / count(DISTINCT i) - pow(sum(CASE WHEN i = j THEN v ELSE 0 END) / count(DISTINCT i), 2), 9) AS penalty FROM g""")
def isotropy(spark, d):
    return _rounded(vectors.isotropy_penalty(_table(spark, d, "embeddings"), "embedding"), 9)


@query("SELECT max(len(embedding))::INT AS width FROM embeddings")
def feature_width(spark, d):
    return spark.createDataFrame([(graph_dataset.feature_width(_table(spark, d, "embeddings"), "embedding"),)], "width int")


@query("""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT a.vec_id, a.label AS own, b.label AS other, avg(list_distance(a.v, b.v)) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT vec_id, max(dist) FILTER (own = other) AS a, min(dist) FILTER (own <> other) AS b FROM m GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM s""")
def silhouette(spark, d):
    return _rounded(vectors.silhouette(_table(spark, d, "embeddings"), "vec_id", "label", "embedding"), 5)


# Folds, trees, forests


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, value / 10 AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE value IS NOT NULL),
f AS (
  SELECT user_id, rn, -loss AS best, 0 AS bad, NULL::BIGINT AS stop FROM e WHERE rn = 1 UNION ALL
  SELECT e.user_id, e.rn, CASE WHEN -loss >= best + 1e-7::DOUBLE THEN -loss ELSE best END, CASE WHEN -loss >= best + 1e-7::DOUBLE THEN 0 ELSE bad + 1 END,
    CASE WHEN NOT -loss >= best + 1e-7::DOUBLE AND bad + 1 >= 3 THEN event_id END
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1 WHERE f.stop IS NULL)
SELECT user_id, -arg_max(best, rn) AS best_loss, max(stop) AS stopped_at FROM f GROUP BY user_id""")
def early_stopping(spark, d):
    events = _table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 10).alias("loss"))
    return early_stop.stop_epochs(events, "user_id", "event_id", "loss", patience=3)


def _part_graphs(spark: SparkSession, d: str) -> DataFrame:
    """A GraphML text for each part: a call, a literal, a node without label and another call; two edges between them and a dangling one."""
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pieces = [
        F.lit(f'<graphml xmlns="{graphml.NAMESPACE}"><graph><node id="1"><data key="labelV">CALL</data><data key="name">'),
        safe("p_name"),
        F.lit('</data><data key="code">it\'s\n'),
        safe("p_type"),
        F.lit('</data></node><node id="2"><data key="labelV">LITERAL</data><data key="order">'),
        F.col("p_size").cast("string"),
        F.lit('</data></node><node id="3"><data key="code"></data></node><node id="4"><data key="labelV">CALL</data></node>'),
        F.lit('<edge source="4" target="2"><data key="labelE">ARG</data><data key="order">'),
        F.col("p_size").cast("string"),
        F.lit('</data></edge><edge source="1" target="3"/><edge source="1" target="9"/></graph></graphml>'),
    ]
    # Parsed once for nodes and edges, and cut, since a filter on what is parsed would be pushed below the spreading, into the task of the file.
    return cut(graphml.parse(spread(_table(spark, d, "part").select("p_partkey", F.concat(*pieces).alias("xml"))), "xml").drop("xml"))


@query("""
SELECT p_partkey AS graph, '4' AS source, '2' AS target, 'ARG' AS rel, 'CALL' AS src_type, 'LITERAL' AS dst_type, 1 AS src_pos, 0 AS dst_pos, '[ARG] order=''' || p_size || '''' AS labelled_text FROM part UNION ALL
SELECT p_partkey, '1', '3', 'edge', 'CALL', 'UNKNOWN', 0, 0, '[edge]' FROM part""")
def xml_graph(spark, d):
    parsed = _part_graphs(spark, d)
    nodes, edges = graphml.node_rows(parsed, "p_partkey"), graphml.edge_rows(parsed, "p_partkey")
    return graph.typed_edges(nodes, edges).select("graph", "source", "target", "rel", "src_type", "dst_type", "src_pos", "dst_pos", "labelled_text")


@query(r"""
SELECT p_partkey AS graph, 0 AS pos, 'CALL' AS type, 'code=''it\''s\n' || p_type || ''', name=''' || p_name || '''' AS text FROM part UNION ALL
SELECT p_partkey, 1, 'LITERAL', 'order=''' || p_size || '''' FROM part UNION ALL SELECT p_partkey, 2, 'UNKNOWN', '' FROM part UNION ALL SELECT p_partkey, 3, 'CALL', '' FROM part""")
def xml_nodes(spark, d):
    return graphml.node_rows(_part_graphs(spark, d), "p_partkey").select("graph", "pos", "type", "text")


@query("""
SELECT p_partkey AS graph, 0 AS epos, 3 AS src, 1 AS dst, '[ARG] order=''' || p_size || '''' AS text FROM part UNION ALL SELECT p_partkey, 1, 0, 2, '[edge]' FROM part""")
def homo_edges(spark, d):
    parsed = _part_graphs(spark, d)
    _, edges = graph_dataset.HomoDataset.shape(graphml.node_rows(parsed, "p_partkey"), graphml.edge_rows(parsed, "p_partkey"))
    return edges.select("graph", "epos", "src", "dst", "text")


@query("""
WITH q AS (SELECT p_partkey, p_size % 7 AS n FROM part), p AS (SELECT * FROM q WHERE p_partkey % 3 > 0),
k AS (SELECT p_partkey, n, unnest(range(0, n)) AS i FROM p), r AS (SELECT * FROM q WHERE p_partkey % 3 = 0), d AS (SELECT p_partkey, n, unnest(range(0, n)) AS i FROM r)
SELECT p_partkey, pos::BIGINT AS pos, label, parent::BIGINT AS parent, field FROM (
  SELECT p_partkey, 0 AS pos, '[Module]' AS label, NULL AS parent, NULL AS field FROM p UNION ALL SELECT p_partkey, 1, '[Assign]', 0, 'body' FROM p UNION ALL
  SELECT p_partkey, 2, '[Name] id=''x''', 1, 'targets' FROM p UNION ALL SELECT p_partkey, 3, '[Store]', 2, 'ctx' FROM p UNION ALL SELECT p_partkey, 4, '[List]', 1, 'value' FROM p UNION ALL
  SELECT p_partkey, 5 + i, '[Constant] value=''' || i || '''', 4, 'elts' FROM k UNION ALL SELECT p_partkey, 5 + n, '[Load]', 4, 'ctx' FROM p UNION ALL
  SELECT p_partkey, 0, '[Module]', NULL, NULL FROM r UNION ALL SELECT p_partkey, 1 + 3 * i, '[If]', greatest(0, 3 * i - 2), 'body' FROM d UNION ALL
  SELECT p_partkey, 2 + 3 * i, '[Name] id=''x' || i || '''', 1 + 3 * i, 'test' FROM d UNION ALL SELECT p_partkey, 3 + 3 * i, '[Load]', 2 + 3 * i, 'ctx' FROM d UNION ALL
  SELECT p_partkey, 1 + 3 * n, '[Pass]', greatest(0, 3 * n - 2), 'body' FROM r)""")
def ast_graph(spark, d):
    """Programs of two shapes: a list of numbers, and conditions within each other, up to six of either."""
    n = F.col("p_size") % 7
    numbers = F.transform(F.sequence(F.lit(0), n), lambda i: i.cast("string"))
    listed = F.concat(F.lit("x = ["), F.array_join(F.slice(numbers, F.lit(1), F.size(numbers) - 1), ", "), F.lit("]\n"))
    lines = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.repeat(F.lit(" "), 4 * i), F.when(i < n, F.concat(F.lit("if x"), i.cast("string"), F.lit(":"))).otherwise("pass")))
    code_text = F.when(F.col("p_partkey") % 3 == 0, F.array_join(lines, "\n")).otherwise(listed)
    return syntax.tree(_table(spark, d, "part").select("p_partkey", code_text.alias("code")), "p_partkey", "code")


def _encoder() -> encoder.GraphEncoder:
    linear = lambda weight, bias: encoder.Linear(np.array(weight, float), np.array(bias, float))
    conv = lambda weight, bias, own: encoder.Convolution(linear(weight, bias), np.array(own, float))
    lives, placed = ("customer", "lives_in", "nation"), ("order", "placed_by", "customer")
    return encoder.GraphEncoder(
        {"nation": linear([[1, 0], [0, 1]], [0.1, 0]), "customer": linear([[0.5, -0.5], [1, 0]], [0, 0.2]), "order": linear([[2, 0], [0.5, 0.5]], [0, 0])},
        [
            {lives: conv([[0.5, 0.25], [0, 1]], [0.1, -0.1], [[1, 0], [0.5, 0.5]]), placed: conv([[1, 0], [-0.5, 1]], [0, 0.1], [[0.25, 0], [0, 0.25]])},
            {lives: conv([[1, -1], [0.5, 0.5]], [0, 0], [[0.1, 0], [0, 0.1]]), placed: conv([[1, 0], [0, 1]], [0, 0], [[1, 0], [0, 1]])},
        ],
        linear([[1, 1], [1, -1]], [0.01, 0]),
    )


@query("""
WITH c0 AS (SELECT c_custkey, c_nationkey AS g, 0.5 * c_acctbal / 1000 - 0.25 AS x, c_acctbal / 1000 + 0.2 AS y FROM customer),
om AS (SELECT o_custkey, avg(2 * o_totalprice / 100000) AS x, avg(0.5 * o_totalprice / 100000 - 0.5) AS y FROM orders GROUP BY o_custkey),
c1 AS (SELECT g, greatest(coalesce(m.x, 0) + 0.25 * c.x, 0) + c.x AS x, greatest(-0.5 * coalesce(m.x, 0) + coalesce(m.y, 0) + 0.1 + 0.25 * c.y, 0) + c.y AS y FROM c0 c LEFT JOIN om m ON o_custkey = c_custkey),
n0 AS (SELECT n_nationkey AS g, n_regionkey + 0.1 AS x, 1.0 AS y FROM nation),
m0 AS (SELECT g, avg(x) AS x, avg(y) AS y FROM c0 GROUP BY g), m1 AS (SELECT g, avg(x) AS x, avg(y) AS y FROM c1 GROUP BY g),
n1 AS (SELECT n.g, greatest(0.5 * coalesce(m.x, 0) + 0.25 * coalesce(m.y, 0) + 0.1 + n.x, 0) + n.x AS x, greatest(coalesce(m.y, 0) - 0.1 + 0.5 * n.x + 0.5 * n.y, 0) + n.y AS y FROM n0 n LEFT JOIN m0 m USING (g)),
n2 AS (SELECT n.g, greatest(coalesce(m.x, 0) - coalesce(m.y, 0) + 0.1 * n.x, 0) + n.x AS x, greatest(0.5 * coalesce(m.x, 0) + 0.5 * coalesce(m.y, 0) + 0.1 * n.y, 0) + n.y AS y FROM n1 n LEFT JOIN m1 m USING (g))
SELECT g AS graph, round((x + y + 0.01)::DOUBLE, 5) AS first, round((x - y)::DOUBLE, 5) + 0 AS second FROM n2""")
def graph_encoder(spark, d):
    nodes, edges = _star(spark, d, vectors=True)
    indexed = cut(graph.index_nodes(nodes))
    states = indexed.select("graph", "type", F.col("type_pos").alias("pos"), "x")
    out = encoder.encode(states, graph.typed_edges(indexed, edges), _encoder(), indexed.select("graph"))
    return _rounded(out.select("graph", F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(1)).alias("second")), 5)


@query()
def tsne_layout(spark, d):
    """The plot sample of the embeddings in the plane."""
    return projection.tsne(_table(spark, d, "embeddings"), "vec_id", "label", "embedding", rounds=120)


@query()
def umap_layout(spark, d):
    return projection.umap(_table(spark, d, "embeddings"), "vec_id", "label", "embedding", rounds=80)


@query()
def neighbour_graph(spark, d):
    """The fifteen nearest neighbours of every embedding, all found; distances are exact."""
    points = order.running(_table(spark, d, "embeddings"), [], ["vec_id"], "pos").select("pos", F.col("embedding").alias("v"))
    return projection.neighbours(cut(points)).withColumn("d", F.round("d", 6))


@query()
def linear_head(spark, d):
    """Fitted on four folds, scored on the fifth."""
    rows = cut(sampling.folds(heads.encode_labels(_table(spark, d, "embeddings"), "label", "truth"), "label", "vec_id"))
    shown = heads.apply_head(heads.fit_head(rows.filter("fold > 0"), "embedding", "label"), rows.filter("fold = 0"), "embedding")
    return _rounded(evaluation.scores(shown, "truth", "predicted"), 2)


@query()
def early_stopped_head(spark, d):
    """The epochs of a head trained on four folds of the embeddings until the loss on the fifth stops improving."""
    rows = sampling.folds(_table(spark, d, "embeddings"), "label", "vec_id").withColumn("held", F.col("fold") == 0)
    trained = heads.train_head(rows, "embedding", "label", "held", patience=3, epochs=30, rate=2.0)
    epochs = [(*e, trained.stopped_at) for e in trained.epochs]
    return _rounded(spark.createDataFrame(epochs, "epoch int, train_loss double, held_loss double, best boolean, stopped_at int"))


def _epochs(spark, fitted):
    return _rounded(spark.createDataFrame([(*e, fitted.stopped_at) for e in fitted.epochs], "epoch int, train_loss double, held_loss double, best boolean, stopped_at int"))


@query()
def aligned_embeddings(spark, d):
    """The epochs of two projections trained on batches of the embeddings, every fifth batch held out."""
    rows = sampling.mini_batches(_table(spark, d, "embeddings").withColumn("other", F.reverse("embedding")), "vec_id")
    return _epochs(spark, align.align(rows.withColumn("held", F.col("batch_id") % 5 == 0), "batch_id", "embedding", "other", "held", 16, patience=3, epochs=15))


@query()
def trained_fusion(spark, d):
    """The epochs of a router, two experts and a classifier trained on four folds of the embeddings, the fifth held out."""
    rows = sampling.folds(_table(spark, d, "embeddings"), "label", "vec_id").withColumn("held", F.col("fold") == 0).withColumn("other", F.reverse("embedding"))
    return _epochs(spark, fusions.train_fusion(rows, "embedding", "other", "label", "held", 32, epochs=15))


@query(f"""
WITH v AS ({" UNION ALL ".join(f"SELECT l_returnflag AS class, '{f}' AS feature, {f}::DOUBLE AS v FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') AND {f} IS NOT NULL" for f in _LINE_FEATURES)}),
c AS (SELECT class, v.feature, least(v, cap) AS v FROM v JOIN (SELECT feature, quantile_cont(v, 0.99) AS cap FROM v GROUP BY feature) q ON q.feature = v.feature),
b AS (SELECT feature, min(v) AS low, (max(v) - min(v)) / 64 AS width FROM c GROUP BY feature),
s AS (SELECT feature, class, count(*) AS n, pow(count(*), -0.2) * stddev_samp(v) AS band FROM c GROUP BY feature, class),
h AS (SELECT feature, class, least(63, floor((v - low) / width))::INT AS j, count(*) AS n FROM c JOIN b USING (feature) GROUP BY ALL),
g AS (SELECT feature, class, low, width, s.n, band, unnest(range(0, 64))::INT AS bin FROM s JOIN b USING (feature))
SELECT feature, class, bin, round(low + (bin + 0.5::DOUBLE) * width, 6) AS x, round(sum(h.n * exp(-pow((bin - j) * width / band, 2) / 2) / sqrt(2 * pi())) / (g.n * band), 9) AS density
FROM g JOIN h USING (feature, class) GROUP BY feature, class, bin, low, width, g.n, band""")
def feature_densities(spark, d):
    """The curves of four features by return flag, each capped at its 99th percentile."""
    out = density.densities(_table(spark, d, "lineitem"), "l_returnflag", _LINE_FEATURES, ["A", "N", "R"])
    return out.select("feature", "class", "bin", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')"


@query(f"""
SELECT doc_id, coalesce(list_aggregate(list_transform(({_WORDS_SQL})[1:512], lambda w: (1 + ('0x' || substr(md5(w), 1, 8))::BIGINT % 50000)::VARCHAR), 'string_agg', ' '), '') AS ids FROM documents""")
def token_ids(spark, d):
    docs = embed.token_ids(_table(spark, d, "documents").select("doc_id", "text"), "text", embed.hashing_tokens(50_000))
    return docs.select("doc_id", F.array_join(F.array_remove("input_ids", 0).cast("array<string>"), " ").alias("ids"))  # without the padding


@query(rf"""
WITH t AS (
  SELECT p_partkey AS graph, 0 AS pos, 'code=''it\''s\n' || p_type || ''', name=''' || p_name || '''' AS text FROM part UNION ALL SELECT p_partkey, 1, 'order=''' || p_size || '''' FROM part),
w AS (SELECT graph, pos, ('0x' || substr(md5(unnest({_WORDS_SQL})), 1, 8))::BIGINT AS h FROM t),
v AS (SELECT graph, pos, h % 16 AS dim, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::INT AS x FROM w GROUP BY ALL),
g AS (SELECT graph, pos, unnest(range(0, 16)) AS dim FROM t)
SELECT graph, pos, string_agg(coalesce(x, 0)::VARCHAR, ' ' ORDER BY dim) AS x FROM g LEFT JOIN v USING (graph, pos, dim) GROUP BY graph, pos""")
def node_embeddings(spark, d):
    nodes = cut(graphml.node_rows(_part_graphs(spark, d), "p_partkey").filter("text <> ''").select("graph", "pos", "text"))  # read for the distinct texts and for all
    vectors_of = embed.embed_texts(nodes, "text", embed.hashing_embedder(16), out="x")
    return vectors_of.select("graph", "pos", F.array_join(F.transform("x", lambda v: v.cast("int").cast("string")), " ").alias("x"))


_LANGUAGE = "CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'java' WHEN 'de' THEN 'cpp' ELSE 'python' END"


@query(f"""
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, md5(text) AS hash, language, split, model FROM (
  SELECT doc_id, text, {_LANGUAGE} AS language, {_SPLIT} AS split, CASE WHEN doc_id % 7 > 0 THEN 'm' || (doc_id % 3) END AS model FROM documents) WHERE model IS NOT NULL AND language <> 'cpp'""")
def ingest_records(spark, d):
    model = F.when(F.expr("doc_id % 7 > 0"), F.concat(F.lit("m"), F.expr("doc_id % 3")))
    samples = _table(spark, d, "documents").select("doc_id", F.col("text").alias("code"), F.expr(_LANGUAGE).alias("language"), F.expr(_SPLIT).alias("split"), model.alias("model"))
    return ingest.chosen_samples(samples, "doc_id").select("idx", F.md5(F.col("code").cast("binary")).alias("hash"), "language", "split", "model")


@query()
def forest_scores(spark, d):
    embeddings = _table(spark, d, "embeddings")
    features = [f"x{i}" for i in range(embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    rows = embeddings.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(x) for i, x in enumerate(features)])
    return forest.by_fold(forest.cross_validated(rows, "vec_id", "label", features))


__all__ = ["oracle_sql", "queries"]
