"""Mixing of sources to target weights: exact block quotas, split among output shards by a tree of hypergeometric draws.

DataFrame operations only. A source's documents stand in seeded order and are taken as one run of words, cut into blocks. A mix takes
every block of a source as often as its target holds the source, and some once more. Which shard gets how many blocks of which source is drawn on
counts alone; the blocks then go out in permuted order, each to one place.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.text import table
from tabulon.operators import order
from tabulon.session import cut, shared_dir

#: The mix is cut into about so many blocks, whatever its size; a block has ``LEAST_WORDS`` words at least.
BLOCKS, LEAST_WORDS = 1 << 20, 256

#: A draw looks so many standard deviations to either side of its mean; beyond them a double has no probability left.
DEVIATIONS = 12

#: Sources are drawn from in groups of 64 at each level of a draw.
BITS = 6
FAN = 1 << BITS


def words_of(text: Column) -> Column:
    """The words of a text, runs of characters other than ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source, rank, source_size, target`` of each source of ``sizes`` (``source, size``).

    ``rank`` counts sources in the order of code points, null last, and gives each its weight in turn. All sizes together are shared by
    weight; a source gets ``most`` times its own size at most, and what is above that is shared again among the others. So the level that all
    uncapped sources fill to, per unit of weight, is where the capped sizes and the level times the other weights make up the whole. A source is
    capped if filling all to its own cap would not take more than there is: one running sum in the order of the caps.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__null", F.col("source").isNull())
    ranked = order.running(totals, [], ["__null", "source"], "rank")
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    weighed = ranked.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("w"))
    both = order.before(order.in_ranges(weighed, ["level", "rank"]), "__part", [], ["level", "rank"], "__caps", F.col("cap"))
    filled = order.before(both, "__part", [], ["level", "rank"], "__light", F.col("w"))
    whole = filled.agg(F.sum("source_size").alias("all"), F.sum("w").alias("all_w"))  # one row
    left = filled.crossJoin(F.broadcast(whole))
    fits = F.col("__caps") + F.col("cap") + F.col("level") * (F.col("all_w") - F.col("__light") - F.col("w")) <= F.col("all")
    known = cut(left.withColumn("capped", fits))
    rest = known.agg(F.max("all").alias("__all"), F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(F.lit(0))).alias("__full"), F.sum(F.when(F.col("capped"), F.lit(0)).otherwise(F.col("w"))).alias("__open"))  # one row
    fill = F.when(F.col("__open") > 0, (F.col("__all") - F.col("__full")) / F.col("__open") * F.col("w"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), fill))
    return known.crossJoin(F.broadcast(rest)).select("source", "rank", "source_size", target.alias("target"))


def source_order(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` (``rank, doc_id, size, key``) with ``place`` and ``start``: the rows and the words before each in its source's seeded order.

    As in ``order.before``, a source falls into 4,096 parts by the first digits of the hash, so one that has a third of all rows passes through no task whole.
    Both totals come from one aggregate and one pass.
    """
    hashed = rows.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))).withColumn("__part", F.substring("__h", 1, 3))
    totals = hashed.groupBy("rank", "__part").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__s"))
    outer = Window.partitionBy("rank").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("rank", "__part", F.coalesce(F.sum("__n").over(outer), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(outer), F.lit(0)).alias("__s0"))
    inner = Window.partitionBy("rank", "__part").orderBy("__h", "doc_id", "size", "key")
    within = hashed.withColumn("__n1", F.row_number().over(inner) - 1).withColumn("__s1", F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(starts, ["rank", "__part"]).withColumn("place", F.col("__n0") + F.col("__n1")).withColumn("start", F.col("__s0") + F.col("__s1")).select(*rows.columns, "place", "start")


def drawn_blocks(targets: DataFrame, block: int, seed: int) -> DataFrame:
    """``rank, number, block, take``: a source's draws of blocks, in their order.

    The target in whole words holds the source's words some times over: as often every block is drawn, each time in the same seeded permutation. The words
    left are drawn from its beginning, ``take`` being the words used of each block; the last may be cut.
    """
    sized = targets.filter("source_size > 0").select("rank", "source_size", F.floor(F.col("target") + 0.5).alias("__words")).withColumn("__blocks", F.ceil(F.col("source_size") / block))
    each = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    each = each.withColumn("length", F.least(F.lit(block), F.col("source_size") - F.col("block") * block))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rank").cast("string"), F.col("block").cast("string")))
    hashed = each.withColumn("__h", h).withColumn("__bucket", F.substring("__h", 1, 3))
    permuted = order.before(order.before(hashed, "__bucket", ["rank"], ["__h"], "turn"), "__bucket", ["rank"], ["__h"], "__earlier", F.col("length"))
    epochs = permuted.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("__words") / F.col("source_size")))))
    left = F.col("__words") - F.col("__epoch") * F.col("source_size") - F.col("__earlier")
    taken = epochs.withColumn("take", F.least(F.col("length"), left)).filter("take > 0")
    return taken.select("rank", (F.col("__epoch") * F.col("__blocks") + F.col("turn")).alias("number"), "block", "take")


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, the argument being moved up by 8 first; its error is below 1e-10 relative."""
    x = n + 9
    below = reduce(Column.__mul__, [n + i for i in range(1, 9)])
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - F.log(below)


def _let(fields: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of ``fields``, each worked out once."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(name) for name, c in fields.items()])), body), F.lit(0))


def hypergeometric(balls: Column, marked: Column, draws: Column, uniform: Column) -> Column:
    """How many of ``draws`` balls drawn without replacement are among the ``marked`` ones: the inverse distribution at ``uniform`` in (0, 1).

    The terms are added up by their recurrence from ``DEVIATIONS`` standard deviations below the mean, so the work grows with the root of the number of balls.
    """
    choose = lambda a, b: _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)

    def spread(v: Column) -> Column:
        return F.when(v["n"] > 1, F.sqrt(v["m"] * (1 - v["k"] / v["n"]) * (v["n"] - v["d"]) / (v["n"] - 1))).otherwise(F.lit(0.0))

    def ends(v: Column) -> Column:
        low = F.greatest(F.lit(0.0), v["d"] + v["k"] - v["n"], F.floor(v["m"] - DEVIATIONS * spread(v) - 1).cast("double"))
        high = F.least(v["k"], v["d"], F.ceil(v["m"] + DEVIATIONS * spread(v) + 1).cast("double"))
        return _let({"n": v["n"], "k": v["k"], "d": v["d"], "low": low, "high": high}, begin)

    def begin(v: Column) -> Column:
        first = F.exp(choose(v["k"], v["low"]) + choose(v["n"] - v["k"], v["d"] - v["low"]) - choose(v["n"], v["d"]))
        return _let({"n": v["n"], "k": v["k"], "d": v["d"], "low": v["low"], "high": v["high"], "first": first}, walk)

    def walk(v: Column) -> Column:
        def more(a: Column, x: Column) -> Column:
            following = a["term"] * (v["k"] - x) * (v["d"] - x) / ((x + 1) * (v["n"] - v["k"] - v["d"] + x + 1))
            return F.struct(following.alias("term"), (a["sum"] + following).alias("sum"), F.when(a["sum"] < uniform, x + 1).otherwise(a["x"]).alias("x"))

        steps = F.when(v["high"] > v["low"], F.sequence(v["low"].cast("long"), v["high"].cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
        start = F.struct(v["first"].alias("term"), v["first"].alias("sum"), v["low"].alias("x"))
        return F.aggregate(F.transform(steps, lambda x: x.cast("double")), start, more, lambda a: a["x"].cast("long"))

    n, k, d = (c.cast("double") for c in (balls, marked, draws))
    return _let({"n": n, "k": k, "d": d, "m": F.when(n > 0, d * k / n).otherwise(F.lit(0.0))}, ends)


def multivariate(parts: Column, draws: Column, uniform: Callable[[Column], Column]) -> Column:
    """``parts``, an array of (``at``, ``quota``), with ``draws`` balls drawn from all of them: an array of (``at``, ``draws``).

    Part by part, what is drawn of one is hypergeometric among what is left of all.
    """
    begin = F.struct(F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["quota"]).alias("n"), draws.alias("d"), F.array().cast("array<struct<at:bigint,draws:bigint>>").alias("out"))

    def more(a: Column, p: Column) -> Column:
        x = hypergeometric(a["n"], p["quota"], a["d"], uniform(p["at"]))
        return _let({"x": x}, lambda v: F.struct((a["n"] - p["quota"]).alias("n"), (a["d"] - v["x"]).alias("d"), F.concat(a["out"], F.array(F.struct(p["at"].alias("at"), v["x"].alias("draws")))).alias("out")))

    return F.aggregate(parts, begin, more, lambda a: a["out"])


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard, rank, quota``: the ``quota`` of each ``rank`` split at random among ``shards`` of sizes that differ by one at most.

    A node of the tree is a range of shards with its blocks by source. Its left half gets a fixed number of them; how many of each source is
    multivariate hypergeometric, as if the node's blocks had been shuffled. With more than ``FAN`` sources that draw goes down a tree of its own, over the ranks:
    a group of sources is told how many it gives, and its ``FAN`` parts share that in turn. So no row holds more than ``FAN`` numbers, and sources are
    never gathered, however many there are. Sums are exact everywhere.
    """
    spark = quotas.sparkSession
    total, last = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.coalesce(F.max("rank"), F.lit(0))).first()
    levels = 1
    while last >> BITS * levels:
        levels += 1
    starts = [total * i // shards for i in range(shards + 1)]
    nodes, tree = [(0, shards)], quotas.select(F.lit(0).alias("lo"), F.col("rank").cast("long").alias("rank"), "quota")
    for depth in range((shards - 1).bit_length()):
        halves = [(lo, (lo + hi) // 2, starts[(lo + hi) // 2] - starts[lo]) for lo, hi in nodes if hi - lo > 1]
        plan = F.broadcast(spark.createDataFrame(halves, "lo int, mid int, draws long"))  # a row a node
        open_ = tree.join(plan, "lo")
        every = open_.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("at", F.expr(f"shiftright(rank, {BITS} * level)"))
        sums = every.groupBy("lo", "draws", "level", "at").agg(F.sum("quota").alias("quota"))
        groups = cut(sums.groupBy("lo", "draws", "level", F.shiftright("at", BITS).alias("group")).agg(F.sort_array(F.collect_list(F.struct("at", "quota"))).alias("parts")))  # FAN parts at most
        share = groups.filter(F.col("level") == levels - 1).select("lo", "group", "draws")
        for level in reversed(range(levels)):
            rows = groups.filter(F.col("level") == level).drop("draws").join(share, ["lo", "group"])
            uniform = lambda at, d=depth: (F.pmod(F.xxhash64(F.lit(seed), F.lit(d), "level", "lo", at), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            drawn = rows.select("lo", F.explode(multivariate(F.col("parts"), F.col("draws"), uniform)).alias("p"))
            share = drawn.select("lo", F.col("p.at").alias("group"), "p.draws")
        left = open_.drop("draws").join(share.withColumnRenamed("group", "rank"), ["lo", "rank"])
        both = F.array(F.struct(F.col("lo"), F.col("draws").alias("quota")), F.struct(F.col("mid").alias("lo"), (F.col("quota") - F.col("draws")).alias("quota")))
        done = tree.join(plan.select("lo"), "lo", "left_anti")
        tree = cut(left.select(F.explode(both).alias("n"), "rank").select("n.lo", "rank", "n.quota").filter("quota > 0").unionByName(done))
        nodes = [half for lo, hi in nodes for half in ([(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)] if hi - lo > 1 else [(lo, hi)])]
    return tree.select(F.col("lo").alias("shard"), "rank", "quota")


def mix(docs: DataFrame, shards: int = 8, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 12) -> tuple[DataFrame, DataFrame]:
    """The documents, and the pieces of them that the mix takes.

    Documents: ``doc_id, source, size, key, rank, source_size, target, place, start``, a row for each of ``docs``, ``key`` being its text's. Pieces: ``rank, place, shard,
    draw, number, first, words``: ``words`` words of the document at ``place`` of its source, from word ``first`` on, are part of the block drawn ``number``-th
    of its source; ``draw`` orders the blocks of a shard, a local shuffle.

    The block length follows from all sizes, so the number of blocks does not grow with the corpus. A document's words are in as many blocks as it is long, so
    documents of any length leave no source off its target by a word. No document is taken more than ``most`` times over. Null texts and texts
    of white space have no words and no pieces; null sources are a source, the last one; a null id has a place like any
    other; rows equal in id, source and text may stand for each other. An empty table gives no rows. A rerun, on any number of tasks, gives the same mix.
    """
    sized = cut(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), _text_key(F.col("text")).alias("key")))
    targets = cut(source_targets(sized, weights, most))
    ranked = order.join_null_safe(sized, targets, ["source"])
    placed = cut(source_order(ranked, seed))
    block = max(LEAST_WORDS, (targets.agg(F.sum("source_size")).first()[0] or 0) // BLOCKS)
    draws = cut(drawn_blocks(targets, block, seed))
    quotas = draws.groupBy("rank").agg(F.count(F.lit(1)).alias("quota"))
    dealt = split_quotas(quotas, shards, seed)
    by_shard = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.withColumn("from", F.coalesce(F.sum("quota").over(by_shard), F.lit(0))).groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("from", "shard"))).alias("ranges"))  # at most one a shard
    shard = F.element_at(F.filter("ranges", lambda r: r["from"] <= F.col("number")), -1)["shard"]
    out = draws.join(ranges, "rank").withColumn("shard", shard).withColumn("draw", F.xxhash64(F.lit(seed), "rank", "number"))
    spans = placed.filter("size > 0").select("rank", "place", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    met = spans.join(out, ["rank", "block"])
    begin = F.greatest(F.lit(0), F.col("start") - F.col("block") * block)
    end = F.least(F.col("take"), F.col("start") + F.col("size") - F.col("block") * block)
    pieces = met.withColumn("words", end - begin).filter("words > 0").select("rank", "place", "shard", "draw", "number", (F.col("block") * block + begin - F.col("start")).alias("first"), "words")
    return placed, pieces


def write_mix(docs: DataFrame, location: str | None = None, **options) -> DataFrame:
    """The mix as text: a folder a shard under ``location``, a row a piece, in the shuffled order of blocks; read back.

    Rows are ``doc_id, source, first, words, text, draw, number, shard``, ``text`` being the piece's words joined by spaces. Options are those of ``mix``.
    """
    spark = docs.sparkSession
    placed, pieces = mix(docs, **options)
    chosen = pieces.join(placed.select("rank", "place", "doc_id", "source", "key"), ["rank", "place"])
    # Rows that share an id are told apart by their texts; rows alike in all three have the same words.
    texts = docs.select("doc_id", "source", _text_key(F.col("text")).alias("key"), "text").dropDuplicates(["doc_id", "source", "key"]).withColumn("__words", words_of(F.col("text"))).drop("text")
    cut_out = order.join_null_safe(chosen, texts, ["doc_id", "source", "key"])
    text = F.array_join(F.slice("__words", (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    rows = cut_out.select("doc_id", "source", "first", "words", text.alias("text"), "draw", "number", "rank", "place", "shard")
    location = location or f"{shared_dir(spark)}/mix-{uuid.uuid4().hex}"
    rows.repartition("shard", F.pmod("draw", F.lit(64))).sortWithinPartitions("draw", "rank", "number", "place").drop("rank", "place").write.partitionBy("shard").parquet(location)
    return spark.read.parquet(location)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the words that the mix takes of it, added up over its pieces."""
    placed, pieces = mix(table(spark, sf_dir, "documents"))
    taken = pieces.groupBy("rank", "place").agg(F.sum("words").alias("taken"))
    return placed.join(taken, ["rank", "place"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, source_size, rank, [5, 2, 1][rank % 3 + 1]::BIGINT AS w, source_size * 3 AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source)
), o AS (
  SELECT *, sum(cap) OVER t AS caps, (sum(w) OVER ()) - (sum(w) OVER t) AS open, sum(source_size) OVER () AS whole FROM s
  WINDOW t AS (ORDER BY cap::DOUBLE / w, rank ROWS UNBOUNDED PRECEDING)
), f AS (SELECT *, caps + cap::DOUBLE / w * open <= whole AS capped FROM o
), t AS (
  SELECT *, CASE WHEN capped THEN cap::DOUBLE ELSE least(cap::DOUBLE, (whole - (SELECT coalesce(sum(cap), 0) FROM f WHERE capped))::DOUBLE / (SELECT sum(w) FROM f WHERE NOT capped) * w) END AS target FROM f
), b AS (SELECT greatest(256, (sum(source_size) // 1048576))::BIGINT AS block FROM t
), k AS (
  SELECT rank, k AS k, block, source_size, floor(target + 0.5)::BIGINT AS words, least(block, source_size - k * block) AS length, md5('12:' || rank || ':' || k) AS h
  FROM (SELECT *, unnest(range(0, (source_size + block - 1) // block)) AS k FROM t, b WHERE source_size > 0)
), e AS (
  SELECT *, sum(length) OVER (PARTITION BY rank ORDER BY h ROWS UNBOUNDED PRECEDING) - length AS earlier FROM k
), x AS (
  SELECT rank, k, words // source_size AS times, greatest(0, least(length, words % source_size - earlier)) AS more FROM e
), p AS (
  SELECT doc_id, size, rank, source_size, target, block, sum(size) OVER (PARTITION BY rank ORDER BY md5('12:' || doc_id), doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, b
), q AS (
  SELECT *, unnest(range(start // block, (start + size - 1) // block + 1)) AS k FROM p WHERE size > 0
), m AS (
  SELECT doc_id, sum(times * (least(start + size, (k + 1) * block) - greatest(start, k * block)) + greatest(0, least(more, start + size - k * block) - greatest(0, start - k * block)))::BIGINT AS taken
  FROM q JOIN x USING (rank, k) GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM p LEFT JOIN m USING (doc_id)
"""
