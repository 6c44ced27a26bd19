"""Preference formatting: paired conversations as one prompt and two completions with the stretches to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.text import table

#: The parts of a rendered turn around its role and text.
OPEN, AFTER_ROLE, CLOSE, AFTER_TURN = "<|", "|>\n", "<|end|>", "\n"


def pair_conversations(conversations: DataFrame) -> DataFrame:
    """``pair_id, chosen, rejected`` from ``conv_id, turn, role, text``: of ids 2k and 2k + 1 the even one is chosen.

    Turns are arrays of (role, text), by turn, then role, then text, nulls first. A null role is the user's, a null text
    empty. A conversation whose partner is missing is paired with an empty one. Rows without ``conv_id`` belong to no
    conversation. A pair meets in one task, as a document does; nothing larger is gathered. Other columns are ignored.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = F.pmod(F.col("conv_id"), F.lit(2))

    def turns(n: int) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(side == n, turn))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    rows = conversations.filter("conv_id IS NOT NULL")
    return rows.groupBy(F.floor(F.col("conv_id") / 2).cast("bigint").alias("pair_id")).agg(turns(0).alias("chosen"), turns(1).alias("rejected"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE + AFTER_TURN))), "")


def _learned(turns: Column, learn: str) -> Column:
    """Character spans of the texts, and the close marks, of the turns whose role is ``learn``."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + len(OPEN) + F.length(t["role"]) + len(AFTER_ROLE)
        end = start + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(AFTER_TURN)).alias("at"), F.when(t["role"] == learn, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, first, step, lambda a: a["spans"])


def format_pairs(pairs: DataFrame, learn: str = "assistant") -> DataFrame:
    """``pair_id, n_prefix, prompt, chosen, rejected, chosen_spans, rejected_spans`` of paired conversations.

    The prompt is the longest run of first turns that both have alike in role and text, rendered once. The completions
    are the turns behind it; loss belongs to their spans alone, the texts of turns of the role ``learn``. Where both are
    the same the completions are empty; where not even the first turn is shared the prompt is. Null arrays are empty.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    alike = F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y))
    sides = sides.withColumn("first", F.array_position(alike, False)).withColumn("n", F.when(F.col("first") > 0, F.col("first") - 1).otherwise(F.size("c")).cast("int"))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n") + 1, F.size(side) - F.col("n"))

    split = sides.select("pair_id", F.col("n").cast("bigint").alias("n_prefix"), F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return split.select("pair_id", "n_prefix", _render(F.col("p")).alias("prompt"), _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"), _learned(F.col("c"), learn).alias("chosen_spans"), _learned(F.col("r"), learn).alias("rejected_spans"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of ``conversations``; spans as text, ``start-end`` with commas between."""
    out = format_pairs(pair_conversations(table(spark, sf_dir, "conversations")))
    for c in ("chosen_spans", "rejected_spans"):
        out = out.withColumn(c, F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ","))
    return out


OP4_SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, count(*) AS turns,
         min(CASE WHEN c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text THEN coalesce(c.pos, r.pos) END) AS first
  FROM (SELECT * FROM t WHERE side = 0) c FULL JOIN (SELECT * FROM t WHERE side = 1) r ON c.pair_id = r.pair_id AND c.pos = r.pos
  GROUP BY 1
), q AS (
  SELECT pair_id, coalesce(first, turns) AS n_prefix FROM p
), u AS (
  SELECT t.pair_id, n_prefix, pos, role, CASE WHEN pos < n_prefix THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part, side, text,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown
  FROM t JOIN q USING (pair_id)
), v AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side, part ORDER BY pos) - length(shown) + length(role) + 5 AS start FROM u
)
SELECT q.pair_id, q.n_prefix,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (part = 'prompt' AND side = 0), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(start::BIGINT || '-' || (start + length(text) + 7)::BIGINT, ',' ORDER BY pos) FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(start::BIGINT || '-' || (start + length(text) + 7)::BIGINT, ',' ORDER BY pos) FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_spans
FROM q JOIN v ON q.pair_id = v.pair_id
GROUP BY q.pair_id, q.n_prefix
"""
