"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs, sorted, merged where neighbours
have the same role, and joined to one string.  A template mark starts with ``<``;
inside roles and texts ``&``, ``<`` and ``[`` become entities, so no text can hold a
mark and the original is read back exactly.

Defined cases: a null role or text is the empty string; a null conversation id is
one conversation; turns are ordered by (turn, role, text), a null turn first, so
ties and repeated rows have one order and repeated rows stay repeated; other
columns of the input are ignored, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreledger.functions.variants import let

ROLE_MARK, TEXT_MARK, NEXT_MARK, END_MARK = "<|role|>", "<|text|>", "<|next|>", "<|end|>"
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    """Text in which no template mark and no other bracketed control string can occur."""
    for plain, coded in _ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`."""
    for plain, coded in reversed(_ENTITIES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _merged(turns: Column) -> Column:
    """Runs of one role as (role, texts), in order; work is linear in the turns."""
    position = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(position, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return let(starts, lambda begin: F.transform(begin, lambda s, j: F.struct(
        F.get(turns, s)["role"].alias("role"),
        F.slice(turns, s + 1, F.coalesce(F.get(begin, j + 1), F.size(turns)) - s)["text"].alias("texts"))))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _segments(runs: Column, trained: tuple[str, ...]) -> Column:
    """Marks and texts of every run, each with whether it is under the loss mask."""
    off = F.lit(False)

    def of_run(run: Column) -> Column:
        learn = run["role"].isin(*trained)
        texts = F.flatten(F.transform(run["texts"], lambda t, i: F.array(
            _segment(F.when(i > 0, NEXT_MARK).otherwise(""), off), _segment(escape(t), learn))))
        head = F.array(_segment(F.concat(F.lit(ROLE_MARK), escape(run["role"]), F.lit(TEXT_MARK)), off))
        return F.concat(head, texts, F.array(_segment(F.lit(END_MARK), off)))

    return F.flatten(F.transform(runs, of_run))


def format_conversations(
    rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text",
    trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: (key, segments, formatted).

    ``segments`` are the pieces of ``formatted`` in order with their loss flag.  One
    shuffle on the key; a conversation is one output string, so its turns meet.
    """
    turns = rows.select(
        F.col(key).alias("_key"),
        F.struct(
            F.col(order).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_turn"))
    grouped = turns.groupBy("_key").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    runs = grouped.select("_key", let(F.col("_turns"), _merged).alias("_runs"))
    pieces = runs.select(F.col("_key").alias(key), _segments(F.col("_runs"), trained).alias("segments"))
    return pieces.withColumn("formatted", F.array_join(F.col("segments")["text"], ""))


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""

    def of_block(block: Column) -> Column:
        role = unescape(F.substring_index(block, TEXT_MARK, 1))
        body = F.substring_index(F.substring_index(block, TEXT_MARK, -1), END_MARK, 1)
        return F.transform(
            F.split(body, r"<\|next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, r"<\|role\|>")
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), of_block))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts and hashes read back from the formatted strings and their masks."""
    back = formatted.select(
        key, F.length("formatted").cast("long").alias("formatted_chars"),
        parse_formatted(F.col("formatted")).alias("_turns"), learned_text(F.col("segments")).alias("_loss"))
    told = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        key, F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"),
        "formatted_chars")
