"""Seeded, reproducible sampling, splitting and episodes, each in window passes instead of a scan per stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.order import before, join_null_safe
from tabulon.session import cut


def seeded(seed: int, *keys: str) -> Column:
    """A pseudo-random order key that any engine with MD5 can reproduce."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def in_seeded_order(df: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """``df`` with ``__place``, the number of each row from 1 within its ``by`` group in seeded order.

    The first digits of the hash deal every group into 4,096 buckets of about equal size; rows are ordered within a
    bucket only, and a bucket begins where the counts of those before it end. So a group may hold most of the rows.
    """
    hashed = df.withColumn("__h", seeded(seed, key)).withColumn("__bucket", F.substring("__h", 1, 3))
    return before(hashed, "__bucket", by, ["__h", key], "__place").withColumn("__place", F.col("__place") + 1).drop("__h", "__bucket")


def first_of_each(df: DataFrame, by: list[str], most: Column, key: str, seed: int) -> DataFrame:
    """The first ``most`` rows of each group in seeded order."""
    return in_seeded_order(df, by, key, seed).filter(F.col("__place") <= most).drop("__place")


def proportional(df: DataFrame, stratum: str, target: int | Column, key: str, within: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """About ``target`` rows of each ``within`` group, by the strata's shares of it; all of a group that has no more.

    A stratum gives max(1, half-even rounding of its share) rows, the group is cut to the target in the order of stratum,
    then seeded hash. Rounding may leave it below the target. Null is a stratum and a group like any other, the first in order.
    """
    group = Window.partitionBy(*map(F.col, within)) if within else Window.partitionBy(F.lit(0))
    sizes = df.groupBy(*within, stratum).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__total", F.sum("__n").over(group)).withColumn("__target", F.lit(target).cast("long") if isinstance(target, int) else target)
    quota = F.greatest(F.lit(1), F.bround(F.col("__target") * F.col("__n") / F.col("__total")).cast("long"))
    sizes = sizes.withColumn("__quota", F.when(F.col("__total") <= F.col("__target"), F.col("__n")).otherwise(F.least(quota, "__n")))
    before = F.coalesce(F.sum("__quota").over(group.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    allowed = F.when(F.col("__total") <= F.col("__target"), F.col("__quota")).otherwise(F.least(F.col("__quota"), F.greatest(F.lit(0), F.col("__target") - before)))
    sizes = sizes.withColumn("__allowed", allowed).select(*within, stratum, "__allowed")
    return first_of_each(join_null_safe(df, sizes, [*within, stratum]), [*within, stratum], F.col("__allowed"), key, seed).drop("__allowed")


def quota_sample(df: DataFrame, quotas: dict[str, int], key: str, language: str = "language", split: str = "split", model: str = "model", source: str = "source", whole: str = "test", seed: int = 42) -> DataFrame:
    """Per language and split, the split's quota shared evenly by its models, each filled proportionally by source.

    The ``whole`` split is taken as it is; splits without a quota are left out. A null language, model or source counts like any other.
    """
    wanted = df.filter(F.col(split).isin(list(quotas)))
    models = wanted.groupBy(language, split).agg((F.count_distinct(model) + F.max(F.col(model).isNull().cast("int"))).alias("__models"))
    quota = F.element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col(split))
    with_models = join_null_safe(wanted, models, [language, split])
    target = F.floor(quota / F.col("__models")).cast("long")
    filled = proportional(with_models.withColumn("__t", target), source, F.col("__t"), key, (language, split, model, "__t"), seed)
    return filled.select(*df.columns).unionByName(df.filter(F.col(split) == whole))


def floor_sample(df: DataFrame, stratum: str, target: int, key: str, seed: int = 42) -> DataFrame:
    """At least one row of each stratum, null among them, and the floor of its share of ``target``; everything if there is no more."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n")).withColumn("__total", F.sum("__n").over(Window.partitionBy(F.lit(0))))
    quota = F.when(F.col("__total") <= target, F.col("__n")).otherwise(F.greatest(F.lit(1), F.floor(F.lit(target) * F.col("__n") / F.col("__total"))))
    return first_of_each(join_null_safe(df, sizes.select(stratum, quota.alias("__quota")), [stratum]), [stratum], F.col("__quota"), key, seed).drop("__quota")


def split(df: DataFrame, label: str, key: str, train: float = 0.2, seed: int = 42) -> DataFrame:
    """``part``: train for the half-even rounded share of each class, in seeded order, test for the rest."""
    sizes = df.groupBy(label).agg(F.bround(F.count(F.lit(1)) * F.lit(train)).alias("__train"))
    placed = join_null_safe(in_seeded_order(df, [label], key, seed), sizes, [label])
    return placed.withColumn("part", F.when(F.col("__place") <= F.col("__train"), "train").otherwise("test")).drop("__place", "__train")


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold``: every class dealt in turn to ``k`` folds."""
    return in_seeded_order(df, [label], key, seed).withColumn("fold", ((F.col("__place") - 1) % k).cast("int")).drop("__place")


def episodes(df: DataFrame, label: str, key: str, tasks: int, max_shot: int, seed: int = 42) -> DataFrame:
    """``task_id, k, class_id, rank, member``: for each task and class with enough rows, one draw of ``max_shot`` members whose
    first k are the k-shot set.

    Every task orders every class anew, but only rows whose hash is among the small ones can be drawn, about four times
    ``max_shot`` a class: just these are shuffled. A draw that finds too few of them is made again from all its class.
    """
    enough = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("class_id")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= max_shot)
    members = df.join(enough, F.col(label) == F.col("class_id")).select("class_id", F.col(key).alias("member"), "__n")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("task_id").cast("string"), F.col("class_id").cast("string"), F.col("member").cast("string")))
    hashed = members.withColumn("task_id", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).withColumn("__h", order)
    small = F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") < F.lit(float(1 << 32)) * (4 * max_shot + 16) / F.col("__n")

    def ranked(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("task_id", "class_id").orderBy("__h", "member"))
        return rows.withColumn("rank", place).filter(F.col("rank") <= max_shot)

    drawn = cut(ranked(hashed.filter(small)).select("task_id", "class_id", "rank", "member"))
    all_draws = enough.select("class_id", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task_id"))
    short = cut(all_draws.join(drawn.filter(F.col("rank") == max_shot), ["task_id", "class_id"], "left_anti"))
    if not short.isEmpty():
        again = ranked(hashed.join(short, ["task_id", "class_id"], "left_semi")).select(*drawn.columns)
        drawn = drawn.join(short, ["task_id", "class_id"], "left_anti").unionByName(again)
    return drawn.withColumn("k", F.explode(F.sequence(F.col("rank"), F.lit(max_shot)))).select("task_id", "k", "class_id", "rank", "member")


def mini_batches(df: DataFrame, key: str, size: int = 32, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """``batch_id``: batches of ``size`` in seeded order, numbered without a global sort.

    Rows fall into buckets by the first digits of their hash; a bucket begins where the counts before it end.
    """
    bucket = (F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int")
    placed = df.withColumn("__bucket", bucket)
    counts = placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select("__bucket", F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(seeded(seed, key), key))
    return placed.join(first, "__bucket").withColumn("batch_id", F.floor((F.col("__first") + place - 1) / size)).drop("__bucket", "__first")
