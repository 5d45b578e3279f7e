"""Relational chat formatting: array and string expressions only.

A block holds adjacent turns of one role:

    <|start|>role<|message|>text<|next|>text<|end|>      and <|learn|> for <|message|> where the loss is taken

so what is under the loss mask is what stands between <|learn|> and <|end|>, without <|next|>. Control strings inside a role or
text (`<|` `<s>` `</s>` `[INST]` `[/INST]`) get a backslash after their first character, one more than they have there;
taking one away undoes it, so that every text comes back as it was and no text can open or close a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MESSAGE, LEARN, NEXT, END = "<|start|>", "<|message|>", "<|learn|>", "<|next|>", "<|end|>"
LEARNT_ROLE = "assistant"
_CONTROL = r"(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def _literal(mark: str) -> str:
    return r"\Q" + mark + r"\E"


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> (conv_id, formatted, mask): one row per conversation.

    mask is a run-length code over formatted, array<struct<learn, n_chars>>. A null text or role is an empty one; a null
    turn comes first; ties go by (role, text); repeated rows are repeated turns; rows with a null conv_id form one
    conversation. Other columns are ignored. An empty table gives an empty one."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).withColumn("n", F.size("turns"))
    begins = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: (k == 0) | (F.col("turns")[k]["role"] != F.col("turns")[F.greatest(k - 1, F.lit(0))]["role"]))
    convs = convs.withColumn("begins", begins)

    def block(k: Column, at: Column) -> Column:
        to = F.coalesce(F.get("begins", at + 1), F.col("n"))
        merged = F.slice("turns", k + 1, to - k)
        return F.struct(F.col("turns")[k]["role"].alias("role"), F.transform(merged, lambda t: escape(t["text"])).alias("texts"))

    convs = convs.withColumn("blocks", F.transform("begins", block))
    learnt = lambda b: b["role"] == LEARNT_ROLE
    head = lambda b: F.concat(F.lit(START), escape(b["role"]), F.when(learnt(b), F.lit(LEARN)).otherwise(F.lit(MESSAGE)))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(END))), "")

    def run(learn: Column, n: Column) -> Column:
        return F.struct(learn.alias("learn"), n.cast("int").alias("n_chars"))

    off = F.lit(False)
    mask = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(F.array(run(off, F.length(head(b)))), F.flatten(F.transform(b["texts"], lambda t, k: F.array(run(off, F.when(k == 0, 0).otherwise(len(NEXT))), run(learnt(b), F.length(t))))), F.array(run(off, F.lit(len(END))))),
        )
    )
    return convs.select("conv_id", formatted.alias("formatted"), F.filter(mask, lambda r: r["n_chars"] > 0).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, ...) -> (conv_id, turns array<struct<role, text, learn>>, formatted): the original turns, from the text alone."""

    def turns_of(raw: Column) -> Column:
        body = F.substring_index(raw, END, 1)
        learn = F.contains(body, F.lit(LEARN))
        role = unescape(F.substring_index(F.substring_index(body, MESSAGE, 1), LEARN, 1))
        texts = F.split(F.substring_index(F.substring_index(body, MESSAGE, -1), LEARN, -1), _literal(NEXT), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text"), learn.alias("learn")))

    raw = F.split("formatted", _literal(START), -1)
    return formatted.select("conv_id", F.flatten(F.transform(F.slice(raw, F.lit(2), F.size(raw)), turns_of)).alias("turns"), "formatted")


def digest(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM rows_
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g'))
    + CASE WHEN k > 1 AND role = before THEN 8
           ELSE 16 + (CASE WHEN role = 'assistant' THEN 9 ELSE 11 END) + length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) END AS n
  FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
