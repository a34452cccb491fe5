"""Preference formatting of chat pairs (operator 6), in column expressions only.

A pair is a chosen and a rejected conversation, each an array of turns
(turn, role, text). Their longest common prefix of turns, equal in role and text,
is rendered once as the prompt; each side's further turns are its completion. The
loss mask of a completion is a list of [first, end) character ranges, one for
each assistant turn with its end mark; ranges count from the completion's start.

``pairs_from_turns`` makes pairs from a table of conversations: conversation 2k is
matched with 2k + 1, and each is chosen once, against itself with its last
assistant text replaced by that of its partner. Conversations are collected by
conv_id, whose size a single conversation bounds; nothing is grouped by content.

A null role or text is an empty one. Turns that repeat a number are ordered by
role and text; exact repeats stay. A conversation without assistant turn, or
whose partner is missing or has none, has no rejected side: rejected is null and
the prompt ends before its last assistant turn. Rows without conv_id are dropped.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    return own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def last_assistant(turns: Column) -> Column:
    """1-based place of the last assistant turn, 0 if there is none."""
    places = F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(places), F.lit(0))


def pairs_from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) of every conversation."""
    own = conversations(turns).withColumn("at", last_assistant(F.col("turns")))
    answer = own.where("at > 0").select((F.col("conv_id").bitwiseXOR(F.lit(1))).alias("conv_id"), F.element_at("turns", F.col("at"))["text"].alias("other"))
    both = own.join(answer, "conv_id", "left")
    swapped = F.transform("turns", lambda t, i: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(i + 1 == F.col("at"), F.col("other")).otherwise(t["text"]).alias("text")))
    return both.select("conv_id", F.col("turns").alias("chosen"), F.when(F.col("other").isNotNull() & (F.col("at") > 0), swapped).alias("rejected"))


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns with equal role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def completion(turns: Column, skip: Column) -> tuple[Column, Column]:
    """(text, mask) of the turns after the first ``skip``."""
    rest = F.filter(turns, lambda t, i: i >= skip)
    parts = F.transform(rest, rendered)
    text = F.array_join(parts, "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,end:int>>").alias("mask"))

    def step(acc, t):
        head = acc["at"] + F.length(F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE)))
        end = acc["at"] + F.length(rendered(t))
        one = F.when(t["role"] == "assistant", F.array(F.struct(head.cast("int").alias("first"), end.cast("int").alias("end")))).otherwise(F.array().cast("array<struct<first:int,end:int>>"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["mask"], one).alias("mask"))

    return text, F.aggregate(rest, start, step)["mask"]


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(conv_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected,
    rejected_mask) of pairs(conv_id, chosen, rejected)."""
    skip = F.coalesce(common_turns(F.col("chosen"), F.col("rejected")), F.greatest(last_assistant(F.col("chosen")) - 1, F.lit(0)))
    at = pairs.withColumn("n_prompt_turns", skip.cast("int"))
    prompt = F.array_join(F.transform(F.filter("chosen", lambda t, i: i < F.col("n_prompt_turns")), rendered), "")
    chosen, chosen_mask = completion(F.col("chosen"), F.col("n_prompt_turns"))
    rejected, rejected_mask = completion(F.col("rejected"), F.col("n_prompt_turns"))
    return at.select("conv_id", "n_prompt_turns", prompt.alias("prompt"), chosen.alias("chosen"), chosen_mask.alias("chosen_mask"), rejected.alias("rejected"), rejected_mask.alias("rejected_mask"))


def _mask_text(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.concat_ws("-", m["first"].cast("string"), m["end"].cast("string"))), " ")


def op6_query(spark, sf_dir: str) -> DataFrame:
    """Every conversation against its partner's last answer; masks as text."""
    out = format_preferences(pairs_from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return out.select("conv_id", "n_prompt_turns", "prompt", "chosen", _mask_text("chosen_mask").alias("chosen_mask"), "rejected", _mask_text("rejected_mask").alias("rejected_mask"))


#: All turns before the swapped one are common; if the two answers are equal, all turns are.
OP6_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM t),
a AS (SELECT conv_id, coalesce(max(i) FILTER (WHERE role = 'assistant'), 0) AS pos, max(i) AS n FROM n GROUP BY conv_id),
o AS (SELECT xor(n.conv_id, 1) AS conv_id, n.text AS other FROM n JOIN a ON a.conv_id = n.conv_id AND a.pos = n.i),
j AS (SELECT n.*, a.pos, a.n, CASE WHEN a.pos > 0 THEN o.other END AS other FROM n JOIN a USING (conv_id) LEFT JOIN o USING (conv_id)),
p AS (SELECT *, CASE WHEN other IS NULL THEN greatest(pos - 1, 0) WHEN max(CASE WHEN i = pos AND text = other THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) = 1 THEN n ELSE pos - 1 END AS k FROM j),
r AS (SELECT *, '<|' || role || '|>' || chr(10) AS h, CASE WHEN i = pos THEN other ELSE text END AS other_text FROM p),
s AS (SELECT *, h || text || '<|end|>' || chr(10) AS c, h || other_text || '<|end|>' || chr(10) AS d FROM r),
q AS (SELECT *, coalesce(sum(CASE WHEN i > k THEN length(c) ELSE 0 END) OVER w, 0) AS ec, coalesce(sum(CASE WHEN i > k THEN length(d) ELSE 0 END) OVER w, 0) AS ed FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(max(k) AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE i <= k), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE i > k), '') AS chosen,
  coalesce(string_agg(CAST(ec - length(c) + length(h) AS BIGINT) || '-' || CAST(ec AS BIGINT), ' ' ORDER BY i) FILTER (WHERE i > k AND role = 'assistant'), '') AS chosen_mask,
  CASE WHEN max(other) IS NOT NULL THEN coalesce(string_agg(d, '' ORDER BY i) FILTER (WHERE i > k), '') END AS rejected,
  CASE WHEN max(other) IS NOT NULL THEN coalesce(string_agg(CAST(ed - length(d) + length(h) AS BIGINT) || '-' || CAST(ed AS BIGINT), ' ' ORDER BY i) FILTER (WHERE i > k AND role = 'assistant'), '') END AS rejected_mask
FROM q GROUP BY conv_id
"""
