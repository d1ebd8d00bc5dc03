"""Chat formatting from an event log.

A log holds, for each conversation, events in sequence: ``message`` (a whole
message at a place), ``delta`` (text added to the message at a place), ``edit``
(a new text for that message; what was said after it is dropped) and
``regenerate`` (the message and what followed are dropped; deltas build it
anew). The log is dealt by conversation and place, sorted by sequence, and
folded into the final messages; those are rendered as a training text with a
loss mask over the assistant's words.

Template: ``<|ROLE|>\\nTEXT</s>\\n`` for each message. Control strings inside a
role or a text are broken by an escape (``~1`` after their first character;
``~`` itself is ``~0``), so a text cannot end its turn or open another one, and
reading back gives exactly what went in.

Defined results: null text counts as empty, a null role as the empty role; a
null place or sequence sorts first; events with the same sequence are taken by
kind, then text; a null conversation is one of its own; repeated rows of a
message table are messages of their own; an empty log gives no conversation;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import read, short_batches
from tidewater.llm.registry import register

#: What a template could read as its own; broken inside roles and texts.
CONTROL = ("</s>", "<s>", "<|", "|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
END = "</s>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("~"), F.lit("~0"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}~1{c[1:]}"))
    return out


def unescape(text: str) -> str:
    return text.replace("~1", "").replace("~0", "~")


def to_events(messages: DataFrame) -> DataFrame:
    """A table of whole messages as a log: conv_id, seq, kind, place, role,
    text. The place counts the rows of a conversation by turn."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return messages.select(
        "conv_id", F.row_number().over(w).cast("bigint").alias("seq"), F.lit("message").alias("kind"),
        F.row_number().over(w).cast("bigint").alias("place"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """The final messages: conv_id, place, role, text.

    An event is dropped when a later edit or regeneration stands at an earlier
    place, or a later whole message, edit or regeneration at its own. What is
    left of a message is its last whole text (if any) and the deltas after."""
    e = events.select("conv_id", "seq", "kind", "place", "role", F.coalesce("text", F.lit("")).alias("text"))
    cuts = F.col("kind").isin("edit", "regenerate")
    before = Window.partitionBy("conv_id").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("cut", F.max(F.when(cuts, F.col("seq"))).over(before))
    e = e.filter(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    parts = e.groupBy("conv_id", "place").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "text"))).alias("log"),
        F.max(F.when(F.col("kind") != "delta", F.struct("seq", "kind", "text"))).alias("whole"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.max(F.when(F.col("kind") != "regenerate", F.col("seq"))).alias("said"))
    added = F.filter("log", lambda x: (x["kind"] == "delta") & (
        F.col("whole").isNull() | (x["seq"] > F.col("whole.seq"))))
    base = F.when(F.col("whole").isNull() | (F.col("whole.kind") == "regenerate"), F.lit("")).otherwise(F.col("whole.text"))
    # a message that was regenerated and not written again is gone
    alive = F.col("whole").isNull() | (F.col("whole.kind") != "regenerate") | (F.size(added) > 0)
    return parts.filter(alive).select("conv_id", "place", "role", F.concat(
        base, F.array_join(F.transform(added, lambda x: x["text"]), "")).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, and loss, the
    (start, stop) code points of the assistant's texts in it."""
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    turns = messages.select("conv_id", "place", F.col("role").eqNullSafe(ASSISTANT).alias("learn"),
                            head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumns({
        "head_n": F.length("head").cast("bigint"), "body_n": F.length("body").cast("bigint"),
        "piece": F.concat("head", "body", F.lit(END))})
    turns = turns.withColumn("n", F.col("head_n") + F.col("body_n") + len(END))
    w = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("head_n"))
    got = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("learn"), F.struct(
            F.col("start"), (F.col("start") + F.col("body_n")).alias("stop"))))).alias("loss"))
    return got.select("conv_id", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), "loss")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece.removeprefix("<|").partition("|>\n")
        out.append((unescape(role), unescape(text)))
    return out


def digests(rendered: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them and their masks."""
    short_batches(rendered.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, text, loss in zip(b["conv_id"], b["formatted"], b["loss"], strict=True):
                turns = hashlib.sha256()
                back = read_back(text)
                for role, said in back:
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                learnt = "".join(unescape(text[s["start"]:s["stop"]]) for s in loss)
                rows.append((conv, len(back), turns.hexdigest(), len(learnt),
                             hashlib.sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = rendered.schema["conv_id"].dataType.simpleString()
    return rendered.mapInPandas(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _escape_sql(expr: str) -> str:
    out = f"replace(coalesce({expr}, ''), '~', '~0')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}~1{c[1:]}')"
    return out


SQL = f"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, COUNT(*) AS n_turns,
         string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{ASSISTANT}'), '') AS learnt,
         SUM(length({_escape_sql('role')}) + length({_escape_sql('text')}) + {len('<||>') + 1 + len(END)}) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
       sha256(learnt) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""


@register("op5_chat_format", SQL)
def op5_chat_format(spark, sf_dir):
    """All conversations formatted, with conversation -1, whose texts hold
    control strings, and read back."""
    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return digests(render(fold(to_events(talks.unionByName(probe)))))
