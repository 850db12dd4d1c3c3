"""Conversations as training text, by Spark expressions only.

A run of neighbouring turns of one role becomes one block::

    <turn ROLE>TEXT<next>TEXT</turn>

Texts are escaped so that no control string can occur in them: a backslash becomes ``\\b`` and ``<`` becomes ``\\l`` (in
roles also ``>`` becomes ``\\g``). Reading back undoes it, so every turn is recovered as it was.

``loss`` lists the character spans of the output on which a model is trained: the texts of the trained roles, without
control strings.

Defined results: a null text or role is empty; turns with equal numbers are ordered by role and text, a null number comes
first; repeated rows are repeated turns; a null conv_id is a conversation of its own. One conversation is one row, so
it is bounded by what a Spark string can hold (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD_END, NEXT, CLOSE = "<turn ", ">", "<next>", "</turn>"


def _text(value: str) -> Column:
    return F.lit(value)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, _text("\\"), _text("\\b")), _text("<"), _text("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, _text("\\l"), _text("<")), _text("\\b"), _text("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), _text(">"), _text("\\g"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, _text("\\g"), _text(">")))


def _field(name: str, *, null: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(null))


def format_chats(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, formatted, loss`` with ``loss`` an array of ``start, chars`` (from 0, in characters)."""
    rows = conversations.select("conv_id", F.struct("turn", _field("role").alias("role"), _field("text").alias("text")).alias("_turn"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    at = lambda i: F.get("_turns", i)["role"]
    firsts = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    turns = turns.withColumn("_firsts", firsts)
    after = lambda n: F.coalesce(F.get("_firsts", n + 1), F.size("_turns"))
    merged = F.transform(
        "_firsts",
        lambda i, n: F.struct(
            at(i).alias("role"),
            F.transform(F.slice("_turns", i + 1, after(n) - i), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    turns = turns.withColumn("_blocks", merged)
    head = lambda b: F.concat(F.lit(OPEN), _escape_role(b["role"]), F.lit(HEAD_END))
    block = lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(CLOSE))
    parts = F.flatten(
        F.transform(
            "_blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, k: F.struct(
                    F.when(k == 0, F.length(head(b))).otherwise(len(NEXT)).alias("skip"),
                    F.length(t).alias("chars"),
                    F.when(k == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).alias("tail"),
                    b["role"].isin(list(trained)).alias("keep"),
                ),
            ),
        )
    )
    none = F.expr("cast(array() as array<struct<start:int,chars:int>>)")
    step = lambda acc, p: F.struct(
        (acc["at"] + p["skip"] + p["chars"] + p["tail"]).alias("at"),
        F.when(p["keep"], F.array_append(acc["spans"], F.struct((acc["at"] + p["skip"]).alias("start"), p["chars"].alias("chars")))).otherwise(acc["spans"]).alias("spans"),
    )
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return turns.select("conv_id", F.array_join(F.transform("_blocks", block), "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation, in order: array of ``role, text``."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.instr(block, HEAD_END)
        role = _unescape_role(F.substring(block, F.lit(len(OPEN) + 1), head - len(OPEN) - 1))
        texts = F.split(F.substring(block, head + 1, F.length(block)), NEXT)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["chars"]))), "")
