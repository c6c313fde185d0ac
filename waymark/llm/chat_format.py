"""Operator 2: chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of
one role share a block.  A block is ``<|role|>text<|+|>text<|end|>``.  Texts and
roles never hold a bare ``|``: a backslash is written as backslash b, a bar as
backslash p, so no text can look like a mark and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, JOINT, END = "<|", "|>", "<|+|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("|"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, ``segments``, ``formatted``.

    ``segments`` is an array of (text, loss) in output order; ``formatted`` is
    their concatenation, and segments with ``loss`` are the loss mask: texts of
    ``loss_role`` and nothing else.  Rows are ordered by turn (null first), ties
    by role and text.  Null texts and roles count as empty.  Repeated rows are
    repeated turns.  A null id is a conversation of its own.  An empty table
    gives an empty result; other columns are not read.
    """
    rows = turns.select(
        F.col(id_col).alias("id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(role_col, F.lit("")).alias("role"),
            F.coalesce(text_col, F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def segments(t: Column, i: Column) -> Column:
        """Mark before the text, the text, and the end mark if the block ends."""
        role = lambda k: F.get("ts", k)["role"]
        joined = F.coalesce(role(i - 1) == t["role"], F.lit(False))
        ends = ~F.coalesce(role(i + 1) == t["role"], F.lit(False))
        mark = F.when(joined, JOINT).otherwise(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE)))
        return F.array(
            F.struct(mark.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")),
            F.struct(F.when(ends, END).otherwise("").alias("text"), F.lit(False).alias("loss")),
        )

    out = sorted_turns.select("id", F.flatten(F.transform("ts", segments)).alias("segments"))
    return out.select(F.col("id").alias(id_col), "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")

    def of_block(block: Column) -> Column:
        at = F.locate(CLOSE, block)
        role = unescape(F.substr(block, F.lit(3), at - 3))
        texts = F.split(F.substr(block, at + 2), r"<\|\+\|>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, of_block))


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what can be read back from the output of ``format_chats``."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = formatted.select(id_col, "formatted", read_turns(F.col("formatted")).alias("turns"), loss.alias("loss_text"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation added to the table: both texts hold other templates' marks.
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"

ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({PROBE_ID}, 0, 'user', '{PROBE_TEXT}'), ({PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')
), m AS (
  SELECT *, role IS NOT DISTINCT FROM lag(role) OVER w AS joined FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
  SELECT *, length(text) + length(text) - length(replace(replace(text, '\', ''), '|', '')) AS n_text,
    length(role) + length(role) - length(replace(replace(role, '\', ''), '|', '')) AS n_role FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + CASE WHEN joined THEN 5 ELSE 11 + n_role END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
