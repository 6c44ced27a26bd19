"""Statistics of whole texts as Spark columns, and bounded labelled samples of them. No Python runs on executors here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.text import WORD, held_out

#: Words of a window in the count of repeated words.
WINDOW = 8

#: Exact counts, as longs.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Shares and means derived from the counts, as doubles; 0 where there is nothing to divide by.
SHARES = ("mean_word_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "words_per_line")


def with_statistics(docs: DataFrame, shares: bool = True) -> DataFrame:
    """``docs`` with the columns of ``COUNTS`` and, if asked for, of ``SHARES`` and ``n_lines``.

    A word is a run of characters other than ASCII white space; null texts have none. A repeated word lies in a window of
    eight consecutive words that occurs at least twice in the text, windows overlapping. Windows are compared by 64-bit
    hashes within one text. The cost of a text grows as its length times the logarithm of that, and only texts that do
    repeat a window are sorted. Columns of ``docs`` stay, but for any that have the names of these statistics.
    """
    own = [c for c in docs.columns if c not in {*COUNTS, *SHARES, "n_lines"}]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    out = docs.select(*own, words.alias("__words"), lines.alias("__lines"))
    out = out.withColumn("__n", F.size("__words")).withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(0), F.col("__n") - WINDOW)
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col("__h"), i + k) for k in range(WINDOW))))
    out = out.withColumn("__w", F.when(F.col("__n") > WINDOW, windows))
    placed = F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__w")) < F.size("__w"), F.sort_array(placed)))
    at = lambda k: F.get(F.col("__s"), k).getField("h")
    again = F.filter("__s", lambda x, k: x.getField("h").eqNullSafe(at(k - 1)) | x.getField("h").eqNullSafe(at(k + 1)))
    first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("words"))
    covered = F.aggregate(F.sort_array(F.transform(again, lambda x: x.getField("i"))), first, lambda a, i: F.struct(i.alias("last"), (a["words"] + F.least(F.lit(WINDOW), i - a["last"])).alias("words")), lambda a: a["words"])
    long = lambda c: c.cast("long")
    out = out.withColumns(
        {
            "n_words": long(F.col("__n")),
            "word_chars": long(F.length(F.array_join("__words", ""))),
            "n_symbols": long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))),
            "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
            "n_repeat_words": long(F.coalesce(covered, F.lit(0))),
        }
    )
    if not shares:
        return _settled(out, own, COUNTS)
    out = out.withColumn("n_lines", long(F.size("__lines")))

    def over(top: Column, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, top / F.col(bottom)).otherwise(F.lit(0.0))

    out = out.withColumns(
        {
            "mean_word_chars": over(F.col("word_chars"), "n_words"),
            "symbol_share": over(F.col("n_symbols"), "word_chars"),
            "dup_line_share": over(F.col("n_dup_lines"), "n_lines"),
            "repeat_share": over(F.col("n_repeat_words"), "n_words"),
            "upper_share": over(F.regexp_count(text, F.lit(r"\p{Lu}")), "word_chars"),
            "digit_share": over(F.regexp_count(text, F.lit(r"[0-9]")), "word_chars"),
            "mark_share": over(F.regexp_count(text, F.lit(r"[!?]")), "word_chars"),
            "distinct_share": over(F.size(F.array_distinct("__words")), "n_words"),
            "words_per_line": over(F.col("n_words"), "n_lines"),
        }
    )
    return _settled(out, own, (*COUNTS, "n_lines", *SHARES))


def _settled(out: DataFrame, own: list[str], names: tuple[str, ...]) -> DataFrame:
    """``out`` with the named columns taken through a generator of one row each.

    The optimizer moves no filter below a generator. Otherwise a filter on a statistic would take the statistic's whole
    definition down with it, nested ones copied into each other's lambdas.
    """
    one = F.explode(F.array(F.struct(*names))).alias("__one")
    return out.select(*own, one).select(*own, *(F.col("__one")[n].alias(n) for n in names))


def drawn_labels(labels: DataFrame, label: str, max_labelled: int) -> DataFrame:
    """``__id, __label`` of about ``max_labelled`` labelled ids at most, none held out, drawn by a hash of the id.

    The count of labels gives the hash threshold, so there is no sort and no limit on unordered rows, and what comes
    back may be broadcast whatever the corpus. A document labelled both ways counts as each once; a label that is
    repeated counts once, null labels for nothing.
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).distinct()
    share = min(1.0, max_labelled / max(1, known.count()))
    return known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int) -> DataFrame:
    """``doc_id, text, __label`` of about ``max_labelled`` rows at most, drawn again by id and text if many rows share the drawn ids."""
    known = F.broadcast(drawn_labels(labels, label, max_labelled))
    share = min(1.0, max_labelled / max(1, docs.select("doc_id").join(known, F.col("doc_id") == F.col("__id")).count()))
    joined = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("__id"))
    return joined if share == 1 else joined.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))


def labelled_statistics(docs: DataFrame, labels: DataFrame, label: str, features: tuple[str, ...], max_labelled: int) -> tuple[list[list[float]], list[int]]:
    """Features and labels of a drawn sample of the labelled rows. Only the drawn texts are analysed, and none is shuffled."""
    rows = sorted(with_statistics(labelled_rows(docs, labels, label, max_labelled)).select(*features, "__label").collect())
    return [[float(v) for v in r[:-1]] for r in rows], [int(r[-1]) for r in rows]
