"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all preceding turns are context and only that reply is trainable.
Where the last turn of a conversation isn't the assistant's, one more example without a target keeps the tail, so that
the output holds every turn. The examples of a conversation of n turns hold O(n^2) turns; that is the format.

A turn is written `<|turn|>role\\ntext<|end|>\\n`. Control strings inside roles and texts are broken by entities, and the
entities that a text already holds are escaped, so `unescape` restores every text.

Defined cases: null text and null role count as empty; turns are ordered by (turn, role, text), nulls first, so ties
and repeated rows have a fixed order and all stay; a null conv_id is one conversation. Extra columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Strings that a chat template or tokenizer may take for control; none may stand in a formatted text.
CONTROL = r"<(?=\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)"
BRACKET = r"\[(?=INST\]|/INST\])"
ENTITY = "(amp;|lt;|#91;|#10;)"


def escape(text: Column) -> Column:
    """Breaks the control strings of a text, reversibly."""
    text = F.regexp_replace(text, "&" + ENTITY, "&amp;$1")
    return F.regexp_replace(F.regexp_replace(text, CONTROL, "&lt;"), BRACKET, "&#91;")


def unescape(text: Column) -> Column:
    """The text that escape() was given."""
    for entity, char in (("&lt;", "<"), ("&#91;", "["), ("&#10;", "\n")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, "&amp;" + ENTITY, "&$1")


def prefix_target_examples(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """One row for each example: conv_col, example (from 0), n_turns, text, loss_start, loss_chars.

    Code points loss_start .. loss_start + loss_chars - 1 (from 0) of text are trainable; both are null without a target.
    """
    turns = pick(turns, [conv_col, turn_col, role_col, text_col])
    empty = F.lit("")
    role = F.replace(escape(F.coalesce(turns[role_col], empty)), F.lit("\n"), F.lit("&#10;"))
    turn = F.struct(
        turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("raw"),
        F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), escape(F.coalesce(turns[text_col], empty)).alias("body"),
    )
    whole = turns.groupBy(turns[conv_col]).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.get("turns", i - 1)["role"].eqNullSafe(target_role)) | (i == F.size("turns")))
    parts = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    each = whole.select(conv_col, "turns", parts.alias("parts"), F.posexplode(places).alias("example", "n_turns"))
    last = F.get("turns", F.col("n_turns") - 1)
    context = F.array_join(F.slice("parts", F.lit(1), F.col("n_turns") - 1), "")
    is_target = last["role"].eqNullSafe(target_role)
    return each.select(
        conv_col, "example", F.col("n_turns").cast("long").alias("n_turns"), F.concat(context, F.get("parts", F.col("n_turns") - 1)).alias("text"),
        F.when(is_target, F.length(context) + F.length(last["head"])).cast("long").alias("loss_start"), F.when(is_target, F.length(last["body"])).cast("long").alias("loss_chars"),
    )


def parse_turns(text: Column) -> Column:
    """The turns of a formatted text, read back: an array of (role, text)."""
    pieces = F.filter(F.split(text, r"\Q" + OPEN + r"\E"), lambda x, i: i > 0)
    return F.transform(pieces, lambda p: let(F.instr(p, "\n"), lambda at: F.struct(unescape(F.substring(p, F.lit(1), at - 1)).alias("role"), unescape(F.substring(p, at + 1, F.length(p) - at - len(CLOSE))).alias("text"))))


def loss_text(text: Column, start: Column, chars: Column) -> Column:
    """The unescaped text under the loss mask; empty without one."""
    return F.coalesce(unescape(F.substring(text, (start + 1).cast("int"), chars.cast("int"))), F.lit(""))
