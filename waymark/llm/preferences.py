"""Preference pairs: the shared beginning of two conversations once as prompt, the rest as masked completions.

The longest common prefix is counted in turns that agree in role and text. It is rendered once; what follows
is rendered for each side, with the character spans that a trainer learns from: text and end mark of the
assistant's turns. Headers, other roles and the prompt are masked.

Rows: turns are ordered by number, then role, then text, so repeated turns have an order; a repeated turn is
rendered each time; null roles and texts count as empty ones; a pair of which one side is missing has no
prompt and an empty completion on that side; turns without a conversation id belong to no pair; an empty table
gives no pairs; other columns are not looked at. A conversation is one record, so its turns, very long ones too, meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNED_ROLE = "assistant"
END = "<|end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """Start and end (not included) of what is learned, in characters of the rendered turns."""
    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"]) + len(END)
        more = F.when(t["role"] == LEARNED_ROLE, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(end.alias("at"), F.concat(state["spans"], more).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_pairs(turns: DataFrame, pair: Column, is_rejected: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``pair_id, n_shared, prompt, chosen, rejected, chosen_spans, rejected_spans`` of every pair.

    ``pair`` names the pair of each turn and ``is_rejected`` its side. One shuffle, by pair.
    """
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text"))
    rows = turns.select(pair.alias("pair_id"), is_rejected.alias("r"), turn.alias("t")).where("pair_id is not null")
    side = lambda r: F.array_sort(F.collect_list(F.when(F.col("r") == r, F.col("t"))))
    pairs = rows.groupBy("pair_id").agg(side(False).alias("a"), side(True).alias("b"))
    differ = F.zip_with("a", "b", lambda x, y: ~(x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"])))
    first = F.array_position(differ, F.lit(True))
    pairs = pairs.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("a")).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    pairs = pairs.withColumns({"shared": F.slice("a", F.lit(1), F.col("n")), "a": rest("a"), "b": rest("b")})
    return pairs.select(
        "pair_id", F.col("n").alias("n_shared"), _render(F.col("shared")).alias("prompt"), _render(F.col("a")).alias("chosen"), _render(F.col("b")).alias("rejected"),
        _spans(F.col("a")).alias("chosen_spans"), _spans(F.col("b")).alias("rejected_spans"),
    )


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
