"""Preference formatting of conversations.

A pair has a chosen and a rejected conversation, each an array of turns (role, text). The
longest common prefix of whole turns is rendered once as the prompt. What follows on either
side is its completion; in it only the assistant's turns are trained, which the spans give
(code points, the end exclusive): the turn's text and its closing mark, not its header.

Defined cases: rows without a conversation id belong to none and are ignored; turns are
ordered by number, ties by role and text, repeated rows are turns of their own; a null role
is `unknown` and a null text empty; a side that is null or empty has no turns; a pair is
`usable` if both completions have a trained turn, so equal conversations are not; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.arrays import let

ASSISTANT = "assistant"
HEAD, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
_TURNS = "array<struct<role:string,text:string>>"


def turn_arrays(
    conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text"
) -> DataFrame:
    """(conv_id, turns): every conversation as an array in order."""
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    bare = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    return (
        conversations.where(F.col(conv_id).isNotNull())
        .groupBy(F.col(conv_id).alias("conv_id"))
        .agg(F.transform(F.array_sort(F.collect_list(one)), bare).alias("turns"))
    )


def rendered(turns: Column) -> Column:
    return F.array_join(
        F.transform(
            turns, lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))
        ),
        "",
    )


def trained_spans(turns: Column) -> Column:
    """Spans of the assistant's texts and closing marks in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = a["at"] + len(HEAD) + F.length(t["role"]) + len(MIDDLE)
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == ASSISTANT, F.concat(a["spans"], span)).otherwise(a["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Turns from the start that are equal in role and text."""
    differ = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: ~x["a"].eqNullSafe(x["b"]))
    return let(differ, lambda d: F.when(F.array_contains(d, True), F.array_position(d, True) - 1).otherwise(F.size(d)))


def format_preferences(
    pairs: DataFrame, pair_id="pair_id", chosen="chosen", rejected="rejected"
) -> DataFrame:
    """One row per pair: `pair_id`, `n_prompt_turns`, `prompt`, and for both sides the
    completion and its trained spans; `usable`."""
    empty = F.array().cast(_TURNS)
    rows = pairs.select(
        F.col(pair_id).alias("pair_id"),
        F.coalesce(F.col(chosen).cast(_TURNS), empty).alias("a"),
        F.coalesce(F.col(rejected).cast(_TURNS), empty).alias("b"),
    ).withColumn("n", common_turns(F.col("a"), F.col("b")).cast("int"))
    after = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.lit(0), F.size(side) - F.col("n")))
    rows = rows.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        F.slice("a", F.lit(1), F.col("n")).alias("before"),
        after(F.col("a")).alias("a"),
        after(F.col("b")).alias("b"),
    )
    rows = rows.select(
        F.col("pair_id").alias(pair_id),
        "n_prompt_turns",
        rendered(F.col("before")).alias("prompt"),
        rendered(F.col("a")).alias("chosen"),
        trained_spans(F.col("a")).alias("chosen_spans"),
        rendered(F.col("b")).alias("rejected"),
        trained_spans(F.col("b")).alias("rejected_spans"),
    )
    return rows.withColumn("usable", (F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0))


def swapped_replies(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: chosen is the conversation itself; rejected has in
    place of its last assistant turn that of the conversation with the next id (nothing, if
    there is none). A plain join on the id; no conversation meets more than one other."""
    turns = turn_arrays(conversations)
    replies = F.filter("turns", lambda t: t["role"] == ASSISTANT)
    other = turns.select(
        (F.col("conv_id") - 1).alias("conv_id"), F.get(replies, F.size(replies) - 1)["text"].alias("reply")
    )
    places = F.transform("turns", lambda t, i: F.when(t["role"] == ASSISTANT, i))
    return (
        turns.join(other, "conv_id", "left")
        .withColumn("last", F.coalesce(F.array_max(places), F.lit(-1)))
        .select(
            F.col("conv_id").alias("pair_id"),
            F.col("turns").alias("chosen"),
            F.transform(
                "turns",
                lambda t, i: F.struct(
                    t["role"].alias("role"),
                    F.when(i == F.col("last"), F.coalesce("reply", F.lit(""))).otherwise(t["text"]).alias("text"),
                ),
            ).alias("rejected"),
        )
    )


def op8_preference_chat(spark, sf_dir: str) -> DataFrame:
    pairs = swapped_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    listed = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","
    ).alias(c)
    return format_preferences(pairs).select(
        F.col("pair_id").alias("conv_id"),
        "n_prompt_turns",
        "prompt",
        "chosen",
        listed("chosen_spans"),
        "rejected",
        listed("rejected_spans"),
        "usable",
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
la AS (SELECT conv_id, max(pos) FILTER (role = 'assistant') AS last, max(pos) AS n FROM t GROUP BY conv_id),
rep AS (SELECT t.conv_id - 1 AS conv_id, text AS reply FROM t JOIN la ON t.conv_id = la.conv_id AND pos = last),
s AS (
  SELECT t.conv_id, pos, role, text AS a,
    CASE WHEN pos = last THEN coalesce(reply, '') ELSE text END AS b
  FROM t JOIN la USING (conv_id) LEFT JOIN rep USING (conv_id)),
k AS (SELECT conv_id, coalesce(min(pos) FILTER (a <> b) - 1, max(pos)) AS k FROM s GROUP BY conv_id),
r AS (
  SELECT s.*, k, '<|' || role || '|>' || chr(10) || a || '<|end|>' || chr(10) AS ra,
    '<|' || role || '|>' || chr(10) || b || '<|end|>' || chr(10) AS rb
  FROM s JOIN k USING (conv_id)),
e AS (
  SELECT *, sum(length(ra)) OVER w AS ea, sum(length(rb)) OVER w AS eb FROM r
  WHERE pos > k WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
c AS (
  SELECT conv_id, string_agg(ra, '' ORDER BY pos) AS chosen, string_agg(rb, '' ORDER BY pos) AS rejected,
    string_agg((ea - length(ra) + length(role) + 5) || ':' || ea, ',' ORDER BY pos) FILTER (role = 'assistant') AS sa,
    string_agg((eb - length(rb) + length(role) + 5) || ':' || eb, ',' ORDER BY pos) FILTER (role = 'assistant') AS sb
  FROM e GROUP BY conv_id),
p AS (SELECT conv_id, string_agg(ra, '' ORDER BY pos) AS prompt FROM r WHERE pos <= k GROUP BY conv_id)
SELECT conv_id, CAST(k AS BIGINT) AS n_prompt_turns, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
  coalesce(sa, '') AS chosen_spans, coalesce(rejected, '') AS rejected, coalesce(sb, '') AS rejected_spans,
  sa IS NOT NULL AND sb IS NOT NULL AS usable
FROM k LEFT JOIN p USING (conv_id) LEFT JOIN c USING (conv_id)
"""
