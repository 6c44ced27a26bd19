"""Queries of what is written and read again: record files, graph datasets, caches, split files, and analysers that run outside."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import code, effects
from tabulon.operators import ranks, vectors
from tabulon.plans import analysis, graph_dataset, registry
from tabulon.session import shared_dir, spread
from tabulon.sources import graphml, records

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


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


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Record files: every document as a JSON line, of which some are not JSON, some lack fields and some have no graph


def _lines(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    model = F.when(i % 3 == 1, "m1").when(i % 3 == 2, "m2")  # absent from a third of the lines
    record = F.struct(i.alias("idx"), F.md5(F.col("text").cast("binary")).alias("hash"), F.col("source").alias("target"), model.alias("model"), F.col("lang").alias("language"), F.lit("train").alias("split"), "source", F.col("text").alias("code"), F.when(i % 7 > 0, "<g/>").otherwise("").alias("graphml"))
    line = F.when(i % 11 == 0, F.lit('{"idx": 1, ')).otherwise(F.to_json(record))
    path = _folder(spark, "lines")
    records.write_document(_table(spark, d, "documents").select("doc_id", line.alias("line")), ["doc_id"], "line", path)
    return records.read_lines(spark, path)


_STATUS = "CASE WHEN doc_id % 11 = 0 THEN 'error: invalid JSON' WHEN doc_id % 7 = 0 THEN 'empty' WHEN doc_id % 3 = 0 THEN 'error: missing model' ELSE 'success' END"


@query(f"SELECT CASE WHEN doc_id % 11 > 0 THEN doc_id ELSE -1 END AS idx, {_STATUS} AS status, CASE WHEN doc_id % 11 > 0 THEN md5(text) END AS code_hash, CASE WHEN doc_id % 11 > 0 THEN lang END AS language FROM documents")
def decoded_records(spark, d):
    out = records.decode_records(_lines(spark, d))
    return out.select(F.coalesce("idx", F.lit(-1)).alias("idx"), "status", F.md5(F.col("code").cast("binary")).alias("code_hash"), "language")


@query(f"SELECT {_STATUS} AS status, count(*) AS n FROM documents GROUP BY ALL")
def record_status(spark, d):
    return records.status_counts(records.decode_records(_lines(spark, d)))


@query(f"SELECT doc_id AS dataset_idx, source AS target, 'm' || (doc_id % 3) AS model, lang AS language, source, md5(text) AS hash, 'train' AS split, md5(text) AS code_hash FROM documents WHERE {_STATUS} = 'success'")
def record_metadata(spark, d):
    good = records.decode_records(_lines(spark, d)).filter("status = 'success'")
    return records.metadata(good).withColumn("code_hash", F.md5(F.col("code").cast("binary"))).drop("code")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 11 > 0 ORDER BY doc_id LIMIT 40")
def first_lines(spark, d):
    """The first records of a file in its own order: of the lines up to the place where 40 are whole."""
    lines = records.read_lines(spark, _written_texts(spark, d), first=40)
    parsed = lines.select(F.from_json("line", "doc_id bigint, text string").alias("r"))
    return parsed.select("r.doc_id", F.length("r.text").cast("long").alias("n"))


def _written_texts(spark: SparkSession, d: str) -> str:
    path = _folder(spark, "texts")
    rows = _table(spark, d, "documents").filter("doc_id % 11 > 0").select("doc_id", F.to_json(F.struct("doc_id", "text")).alias("line"))
    records.write_document(rows, ["doc_id"], "line", path)
    return path


@query("SELECT count(*) AS n FROM documents WHERE doc_id % 11 > 0")
def line_count(spark, d):
    return spark.createDataFrame([(records.count_lines(spark, _written_texts(spark, d)),)], "n long")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 1 OFFSET 17")
def nth_record(spark, d):
    return records.peek(_table(spark, d, "documents").select("doc_id", "lang"), 17, "doc_id")


@query("SELECT doc_id, md5(text) AS hash, lang FROM documents")
def json_sink(spark, d):
    path = _folder(spark, "json")
    records.write_json(_table(spark, d, "documents"), path)
    return spark.read.schema("doc_id bigint, text string, lang string").json(path).select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"), "lang")


@query(registry.oracle_sql()["kruskal_multi"])
def csv_sink(spark, d):
    path = _folder(spark, "csv")
    records.write_csv(registry.queries()["kruskal_multi"](spark, d), path)
    return spark.read.csv(path, header=True, schema="feature string, n long, h double, p double, eta2 double, effect string")


@query("SELECT lang, sum(strlen(text) + 1)::BIGINT AS length FROM documents GROUP BY lang")
def file_inventory(spark, d):
    """The files of a folder, by language, with their bytes; a line break ends each text."""
    path = _folder(spark, "inventory")
    _table(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(path)  # each task has a file of its own a language
    files = records.inventory(spark, path).withColumn("lang", F.regexp_extract("path", "lang=([^/]*)", 1))
    return files.filter("lang <> ''").groupBy("lang").agg(F.sum("length").alias("length"))


@query("SELECT p_brand, md5(string_agg(p_name, ' ' ORDER BY p_name) || chr(10)) AS hash, 'python' AS language FROM part GROUP BY p_brand")
def text_files(spark, d):
    """Whole files as rows: a file a brand with the names of its parts; the suffix tells the language."""
    path = _folder(spark, "files")
    texts = _table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list("p_name")), " ").alias("text"))
    texts.repartition("p_brand").write.partitionBy("p_brand").text(path)
    brand = F.url_decode(F.url_decode(F.regexp_extract("path", "p_brand=([^/]*)", 1)))  # the folder has escapes, and the path of a file more
    return records.read_texts(spark, path).select(brand.alias("p_brand"), F.md5(F.col("code").cast("binary")).alias("hash"), "language")


@query("SELECT vec_id, label, round(embedding[1]::DOUBLE * 2, 5) + 0 AS doubled FROM embeddings")
def cached_embeddings(spark, d):
    """A cache of vectors, stored by label and attached again by key, whose second use reads what the first has written."""
    rows, path = _table(spark, d, "embeddings"), _folder(spark, "cache")
    made = rows.select("vec_id", F.col("label").alias("node_type"), F.transform("embedding", lambda x: x.cast("double") * 2).alias("x"))
    records.materialise(made, path)
    cache = records.materialise(made.limit(0), path).select("vec_id", "x")
    return records.attach(rows.select("vec_id", "label"), cache, "vec_id").select("vec_id", "label", (F.round(F.get("x", F.lit(0)), 5) + 0.0).alias("doubled"))


@query("SELECT doc_id FROM documents")
def split_file(spark, d):
    """Every index of the split file, read back from its parts."""
    path, task = _folder(spark, "split"), "lang"
    docs = _table(spark, d, "documents").select("doc_id", "lang")
    names = analysis.write_few_shot(*analysis.few_shot(docs, "doc_id", "lang", tasks=2, max_shot=2), path, task)
    lines = spark.read.text(f"{path}/{next(n for n in names if 'base_split' in n)}")
    return lines.filter(F.col("value").rlike("^,?[0-9]+$")).select(F.regexp_replace("value", ",", "").cast("long").alias("doc_id"))


# Outside analysers


def _fingerprint(text: str, end: str) -> str | None:
    if len(text) % 7 == 0:
        raise ValueError("seven")
    return None if len(text) % 11 == 0 else hashlib.md5((text + end).encode()).hexdigest()


_FAILS = "length(coalesce(text, '')) % 7 = 0"


@query(f"""SELECT doc_id, CASE WHEN NOT ({_FAILS}) AND length(text) % 11 > 0 THEN md5(text || CASE WHEN lang = 'fr' THEN '.java' WHEN lang = 'de' THEN '.cpp' ELSE '.py' END) END AS graphml,
  CASE WHEN {_FAILS} THEN 'error: seven' WHEN length(text) % 11 = 0 THEN 'empty' ELSE 'success' END AS status FROM documents""")
def analysed_rows(spark, d):
    """An analyser in the worker, of which some calls fail and some return nothing."""
    language = F.when(F.col("lang") == "fr", "java").when(F.col("lang") == "de", "cpp").otherwise("python")
    rows = _table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("code"), language.alias("language"))
    return records.with_analysis(rows, _fingerprint).select("doc_id", "graphml", "status")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 > 1 THEN p_name || p_partkey END AS graphml, CASE WHEN p_size % 5 = 0 THEN 'error: exit status 1' WHEN p_size % 5 = 1 THEN 'empty' ELSE 'success' END AS status,
  CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END AS exit_status, CASE WHEN p_size % 5 > 1 THEN strlen(p_name || p_partkey) ELSE 0 END AS out_bytes FROM part""")
def analyser_processes(spark, d):
    """A process a part: those without a source text end with an error, empty ones leave nothing, the others copy theirs."""
    text = F.when(F.col("p_size") % 5 > 1, F.concat("p_name", F.col("p_partkey").cast("string"))).when(F.col("p_size") % 5 == 0, "fail").otherwise("")
    rows = _table(spark, d, "part").select("p_partkey", text.alias("code"), F.lit("python").alias("language"))
    out = records.with_processes(rows, ["sh", "-c", 'grep -q "^fail$" "$0" && exit 1; cp "$0" "$1"', "{code}", "{out}"])
    return out.select("p_partkey", "graphml", "status", "exit_status", "out_bytes")


# Graph datasets from lines, of graphs whose shape varies: one to six nodes of three types, some ids repeated, some texts in CDATA, some edges dangling


def _graph_text() -> F.Column:
    label = lambda i: F.when((F.col("p_partkey") + i) % 3 == 0, '<data key="labelV">CALL</data>').when((F.col("p_partkey") + i) % 3 == 1, '<data key="labelV">LIT</data>').otherwise("")
    name = lambda i: F.when((i == F.col("n") - 1) & (F.col("p_partkey") % 4 == 0), "n0").otherwise(F.concat(F.lit("n"), i.cast("string")))
    node = lambda i: F.concat(F.lit('<node id="'), name(i), F.lit('">'), label(i), F.lit('<data key="code"><![CDATA[a<b && \'c\' '), i.cast("string"), F.lit(']]></data><data key="order">'), i.cast("string"), F.lit("</data></node>"))
    kind = lambda j: F.when(j % 3 == 2, "").otherwise(F.concat(F.lit('<data key="labelE">E'), (j % 3).cast("string"), F.lit("</data>")))
    edge = lambda j: F.concat(F.lit('<edge source="n'), j.cast("string"), F.lit('" target="n'), ((j + 1) % F.col("n")).cast("string"), F.lit('">'), kind(j), F.lit("</edge>"))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    return F.concat(F.lit(f'<?xml version="1.0"?><graphml xmlns="{graphml.NAMESPACE}"><graph>'), F.array_join(F.transform(every, node), ""), F.array_join(F.transform(every, edge), ""), F.lit("</graph></graphml>"))


def _graph_lines(spark: SparkSession, d: str) -> str:
    """A folder with the lines; a seventh of the graphs are given twice, the first time with one node, an eleventh are blank and a thirteenth no XML."""
    part = spread(_table(spark, d, "part")).select("p_partkey", (1 + F.col("p_size") % 6).alias("n"), "p_brand").withColumn("version", F.lit(1))
    early = part.filter("p_partkey % 7 = 0").withColumns({"version": F.lit(0), "n": F.lit(1)})
    text = F.when(F.col("p_partkey") % 11 == 0, " ").when(F.col("p_partkey") % 13 == 0, "<graphml").otherwise(_graph_text())
    record = F.struct(F.col("p_partkey").alias("idx"), F.lit("h").alias("hash"), F.col("p_brand").alias("target"), F.lit("m").alias("model"), F.when(F.col("p_partkey") % 2 == 0, "python").otherwise("java").alias("language"), F.lit("train").alias("split"), F.lit("s").alias("source"), F.lit("x").alias("code"), text.alias("graphml"))
    root = _folder(spark, "graphs")
    records.write_document(part.unionByName(early).select("p_partkey", "version", F.to_json(record).alias("line")), ["p_partkey", "version"], "line", f"{root}/cpg_dataset.jsonl")
    return root


_GRAPHS_SQL = """
WITH g AS (SELECT p_partkey AS p, 1 + p_size % 6 AS n FROM part WHERE p_partkey % 11 > 0 AND p_partkey % 13 > 0),
v AS (SELECT p, n, unnest(range(0, n)) AS i FROM g),
w AS (SELECT p, i, CASE WHEN i = n - 1 AND p % 4 = 0 THEN 'n0' ELSE 'n' || i END AS node, CASE (p + i) % 3 WHEN 0 THEN 'CALL' WHEN 1 THEN 'LIT' ELSE 'UNKNOWN' END AS type,
  'code=''a<b && \\''c\\'' ' || i || ''', order=''' || i || '''' AS text FROM v),
x AS (SELECT *, row_number() OVER (PARTITION BY p, type ORDER BY i) - 1 AS type_pos FROM w),
l AS (SELECT p, node, arg_max(type, i) AS type, arg_max(type_pos, i) AS type_pos, max(i) AS i FROM x GROUP BY p, node),
e AS (SELECT p, i AS epos, 'n' || i AS source, 'n' || ((i + 1) % n) AS target, CASE i % 3 WHEN 2 THEN 'edge' ELSE 'E' || (i % 3) END AS rel FROM v)
"""


@query(_GRAPHS_SQL + """SELECT e.p AS graph, e.epos, e.source, e.target, e.rel, s.type AS src_type, t.type AS dst_type, s.type_pos AS src_pos, t.type_pos AS dst_pos
FROM e JOIN l s ON s.p = e.p AND s.node = e.source JOIN l t ON t.p = e.p AND t.node = e.target WHERE e.p % 2 = 0""")
def graph_store_edges(spark, d):
    """Built, stored, loaded and cut to one language."""
    root = _graph_lines(spark, d)
    graph_dataset.GraphDataset.build(spark, root).write(f"{root}/hetero")
    chosen = graph_dataset.GraphDataset.load(spark, f"{root}/hetero").subset(language="python")
    return chosen.edges.select("graph", "epos", "source", "target", "rel", "src_type", "dst_type", "src_pos", "dst_pos")


@query(_GRAPHS_SQL + "SELECT p AS graph, i AS pos, node, type, type_pos, text FROM x WHERE type <> 'LIT'")
def graph_store_nodes(spark, d):
    """Parsed in the exact way, with a hook before storing that drops a type, and one at loading that adds nothing but a check."""
    root = _graph_lines(spark, d)
    without = lambda t: replace(t, nodes=t.nodes.filter("type <> 'LIT'"))
    graph_dataset.GraphDataset.build(spark, root, exact=True, pre_transform=without).write(f"{root}/hetero")
    loaded = graph_dataset.GraphDataset.load(spark, f"{root}/hetero", lambda t: replace(t, nodes=t.nodes.withColumn("text", F.coalesce("text", F.lit("")))))
    return loaded.nodes.select("graph", "pos", "node", "type", "type_pos", "text")


@query("""SELECT CASE WHEN p_partkey % 11 = 0 THEN 'empty' ELSE 'parse_failed' END AS status, sum(1 + (p_partkey % 7 = 0)::INT)::BIGINT AS n FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 13 = 0 GROUP BY ALL""")
def graph_store_skipped(spark, d):
    return graph_dataset.GraphDataset.build(spark, _graph_lines(spark, d)).skipped


@query(_GRAPHS_SQL + """SELECT e.p AS graph, e.epos, s.i AS src, t.i AS dst, CASE e.rel WHEN 'edge' THEN '[edge]' ELSE '[' || e.rel || ']' END AS text FROM e JOIN l s ON s.p = e.p AND s.node = e.source JOIN l t ON t.p = e.p AND t.node = e.target""")
def homo_store_edges(spark, d):
    root = _graph_lines(spark, d)
    graph_dataset.HomoDataset.build(spark, root).write(f"{root}/homo")
    return graph_dataset.HomoDataset.load(spark, f"{root}/homo").edges.select("graph", "epos", "src", "dst", "text")


@query(_GRAPHS_SQL + "SELECT p AS graph, i AS pos, '[' || type || '] ' || text AS text FROM x")
def homo_store_nodes(spark, d):
    root = _graph_lines(spark, d)
    graph_dataset.HomoDataset.build(spark, root).write(f"{root}/homo")
    return graph_dataset.HomoDataset.load(spark, f"{root}/homo").nodes.select("graph", "pos", "text")


# Small functions of tables


@query("""
WITH w AS (SELECT vec_id // 32 AS batch, 0.01 + 0.98 / (1 + exp(embedding[2]::DOUBLE - embedding[1]::DOUBLE)) AS g FROM embeddings)
SELECT batch, unnest([0, 1])::INT AS expert, round(unnest([avg(g), avg(1 - g)]), 6) AS weight FROM w GROUP BY batch""")
def mean_routing(spark, d):
    weights = vectors.routing(F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")))
    rows = _table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 32).alias("batch"), weights.alias("w"))
    return vectors.mean_routing(rows, "batch", "w").withColumn("weight", F.round("weight", 6))


@query("""SELECT vec_id, unnest(range(0, 128))::INT AS dim, round(unnest(list_concat(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE / 2 + embedding[65 - i]::DOUBLE / 2), list_transform(embedding, lambda x: x::DOUBLE))), 5) + 0 AS value FROM embeddings""")
def fixed_fusion(spark, d):
    """Both vectors fused by equal weights, beside the first."""
    e = F.col("embedding")
    half = F.array(F.lit(0.5), F.lit(0.5))
    both = vectors.side_by_side(vectors.fuse(e, F.reverse(e), half), F.transform(e, lambda x: x.cast("double")))
    rows = _table(spark, d, "embeddings").select("vec_id", F.posexplode(both).alias("dim", "value"))
    return rows.withColumn("value", F.round("value", 5) + 0.0)


_LOSSES = [(True, True), (True, False), (False, True), (False, False)]


@query(f"""
WITH c AS (SELECT avg(loss) AS c FROM ({registry.oracle_sql()["contrastive"]})), i AS (SELECT penalty AS i FROM ({registry.oracle_sql()["isotropy"]})), x AS (SELECT penalty AS x FROM ({registry.oracle_sql()["cross_penalty"]})),
f AS (SELECT unnest([true, true, false, false]) AS use_isotropy, unnest([true, false, true, false]) AS use_cross)
SELECT use_isotropy, use_cross, round(c + CASE WHEN use_isotropy THEN 0.1 * i ELSE 0 END + CASE WHEN use_cross THEN 0.5 / (c + 1e-8) * x ELSE 0 END, 4) AS loss FROM c, i, x, f""")
def ablated_loss(spark, d):
    """The whole loss and its ablations, from the three terms over all embeddings."""
    first = lambda name: registry.queries()[name](spark, d)
    c = first("contrastive").agg(F.avg("loss")).first()[0]
    i, x = (first(name).first()[0] for name in ("isotropy", "cross_penalty"))
    rows = [(a, b, vectors.total_loss(c, i, x, 0.1, use_isotropy=a, use_cross=b)) for a, b in _LOSSES]
    return spark.createDataFrame(rows, "use_isotropy boolean, use_cross boolean, loss double").withColumn("loss", F.round("loss", 4))


@query("SELECT event_id, CASE WHEN value / 100 >= 0.40 AND event_id % 5 >= 3 THEN 'strong' WHEN value / 100 >= 0.25 THEN 'moderate' ELSE 'weak' END AS grade FROM events WHERE value IS NOT NULL")
def evidence_grades(spark, d):
    return _table(spark, d, "events").filter("value IS NOT NULL").select("event_id", effects.evidence(F.col("value") / 100, F.col("event_id") % 5).alias("grade"))


@query(f"SELECT feature, effect FROM ({registry.oracle_sql()['kruskal_multi']}) QUALIFY effect IN ('Large', 'Medium') OR (count(*) FILTER (effect IN ('Large', 'Medium')) OVER () = 0 AND row_number() OVER (ORDER BY eta2 DESC, feature) <= 2)")
def notable_features(spark, d):
    return ranks.notable_features(registry.queries()["kruskal_multi"](spark, d), fallback=2).select("feature", "effect")


@query(f"SELECT pair, p_adjusted FROM ({registry.oracle_sql()['pairwise_table']}) WHERE significant = 'Yes'")
def significant_pairs(spark, d):
    return ranks.significant(registry.queries()["pairwise_table"](spark, d)).select("pair", "p_adjusted")


_HIDE = "regexp_extract_all(text, '([\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+)')"


def _hidden_sql(language: str) -> str:
    words = ", ".join(f"'{w}'" for w in code.RESERVED[language])
    return f"""array_to_string(list_transform({_HIDE}, lambda w: CASE WHEN regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]*') AND w NOT IN ({words})
  THEN 'h' || printf('%08x', list_reduce(list_transform(string_split(w, ''), lambda c: ascii(c)::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)) ELSE w END), '')"""


@query(f"""
WITH t AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'java' WHEN 'de' THEN 'cpp' END AS language, CASE WHEN doc_id % 4 > 0 THEN text END AS text, text AS code FROM documents)
SELECT doc_id, md5(CASE language WHEN 'python' THEN {_hidden_sql("python")} WHEN 'java' THEN {_hidden_sql("java")} ELSE coalesce(text, code) END) AS hidden,
  CASE language WHEN 'cpp' THEN '.cpp' WHEN 'java' THEN '.java' ELSE '.py' END AS suffix FROM t""")
def hidden_by_language(spark, d):
    """Obfuscation where the language is known, else the cleaned text or the text itself."""
    language = F.when(F.col("lang") == "en", "python").when(F.col("lang") == "fr", "java").when(F.col("lang") == "de", "cpp")
    rows = _table(spark, d, "documents").select("doc_id", language.alias("l"), "text", F.when(F.col("doc_id") % 4 > 0, F.col("text")).alias("cleaned"))
    return rows.select("doc_id", F.md5(code.obfuscate_by_language(F.col("text"), F.col("cleaned"), F.col("l")).cast("binary")).alias("hidden"), code.suffix(F.col("l")).alias("suffix"))


@query("""
WITH n AS (SELECT p_partkey, unnest(list_sort(list_distinct(regexp_extract_all(p_name || '=' || p_type, '[a-zA-Z_][a-zA-Z0-9_]*')))) AS name FROM part)
SELECT p_partkey, name, 'h' || printf('%08x', list_reduce(list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295, 2166136261::BIGINT)) AS hidden FROM n WHERE name NOT IN ('for', 'in', 'range', 'set', 'list')""")
def symbol_map(spark, d):
    text = F.concat_ws("=", "p_name", "p_type")
    return _table(spark, d, "part").select("p_partkey", F.explode(code.symbol_map(text, "python")).alias("name", "hidden"))


__all__ = ["oracle_sql", "queries"]
