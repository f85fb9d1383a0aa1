"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted; runs of adjacent turns of the same role become one block, its
turns joined by a mark; blocks are concatenated under a template whose marks cannot occur inside texts, because control
strings in texts are escaped reversibly: one backslash is put behind the first character of every ``<|``, ``<s>``,
``</s>``, ``[INST]``, ``[/INST]``, ``SYS>>`` form, and of every form that already carries backslashes there.

Edge cases: a null text or role is an empty one; turns with a null number come first; ties of the number are ordered by
role, then text; repeated rows are repeated turns. A null conversation id is a conversation of its own. No rows give no
conversations. Very long texts and conversations of many turns are formatted whole, in time that grows with them. Other columns
are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template: begin of a block (its role follows), begin of its text, between merged turns, end of a block.
OPEN, BODY, NEXT, CLOSE = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Forms that are control strings in chat templates, behind their first character.
_FORMS = r"(\||/?s>|/?INST\]|/?SYS>>)"
#: Turns whose spans are summed at once.
BLOCK = 256
_PLAIN, _ESCAPED = r"([<\[])(\\*)" + _FORMS, r"([<\[])\\(\\*)" + _FORMS


def escaped(text: Column) -> Column:
    """Without any control string; ``unescaped`` gives the text back."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, r"\Q" + mark + r"\E", -1)


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 learned: str = "assistant") -> DataFrame:
    """``(key, formatted, loss)`` for every conversation.

    ``loss`` lists the spans of ``formatted`` (begin and length in code points) under the loss mask: each turn of the
    ``learned`` role, without marks. Turns are gathered by conversation, which is one cell of the result anyway; they are
    escaped before the shuffle and packed map-side.
    """
    rows = turns.select(F.col(key).alias(key), F.col(turn).alias("turn"),
                        escaped(F.coalesce(F.col(role).cast("string"), F.lit(""))).alias("role"),
                        escaped(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    sorted_turns = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # A turn opens a block where its role differs from that of the turn before it, which is read from the sorted list itself:
    # a list of flags would be built again for every turn.
    head = lambda t, i: (F.when(i == 0, F.concat(F.lit(OPEN), t["role"], F.lit(BODY)))
                         .when(F.get("turns", i - 1)["role"] == t["role"], F.lit(NEXT))
                         .otherwise(F.concat(F.lit(CLOSE + OPEN), t["role"], F.lit(BODY))))
    parts = sorted_turns.select(key, F.transform("turns", lambda t, i: F.struct(
        head(t, i).alias("head"), t["text"].alias("text"), (t["role"] == escaped(F.lit(learned))).alias("learned"))).alias("parts"))
    lengths = parts.select(key, "parts", F.transform("parts", lambda p: F.struct(
        F.length(p["head"]).alias("head"), F.length(p["text"]).alias("text"), p["learned"].alias("learned"))).alias("sizes"))
    # Where each turn's text begins is a running sum of lengths, taken over blocks of turns, as a list is copied when it grows.
    spans = F.expr(f"""transform(sequence(0, greatest(size(sizes) - 1, 0) div {BLOCK}), b -> aggregate(slice(sizes, cast(b * {BLOCK} + 1 as int), {BLOCK}),
        named_struct('at', 0, 'spans', cast(array() as array<struct<begin:int,length:int>>)),
        (done, s) -> named_struct('at', done.at + s.head + s.text, 'spans', if(s.learned,
            concat(done.spans, array(named_struct('begin', done.at + s.head, 'length', s.text))), done.spans))))""")
    blocks = lengths.select(key, "parts", spans.alias("blocks"))
    moved = F.expr("""aggregate(blocks, named_struct('at', 0, 'starts', cast(array() as array<int>)),
        (done, b) -> named_struct('at', done.at + b.at, 'starts', concat(done.starts, array(done.at))), done -> done.starts)""")
    placed = blocks.select(key, "parts", F.arrays_zip(F.col("blocks.spans").alias("spans"), moved.alias("start")).alias("blocks"))
    loss = F.flatten(F.transform("blocks", lambda b: F.transform(b["spans"], lambda s: F.struct(
        (s["begin"] + b["start"]).alias("begin"), s["length"].alias("length")))))
    formatted = F.concat(F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["text"]))), F.lit(CLOSE))
    return placed.select(key, formatted.alias("formatted"), loss.alias("loss"))


def read_back(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, turns array<struct<role, text>>, learned array<string>, ...)``: the turns that a formatted text holds, and the
    unescaped texts under its loss mask, read from the output alone."""
    blocks = F.filter(_split(F.col("formatted"), OPEN), lambda _, i: i > 0)

    def turns_of(block: Column) -> Column:
        sides = _split(block, BODY)
        body = F.regexp_replace(sides[1], r"\Q" + CLOSE + r"\E$", "")
        return F.transform(_split(body, NEXT), lambda t: F.struct(unescaped(sides[0]).alias("role"), unescaped(t).alias("text")))
    return chats.select(key, "formatted", F.flatten(F.transform(blocks, turns_of)).alias("turns"),
                        F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["begin"] + 1, s["length"]))).alias("learned"))
