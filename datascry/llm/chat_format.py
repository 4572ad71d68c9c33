"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes its own example: all preceding turns are context
and only that reply is under the loss mask.  The template is

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>\\n

Control strings inside roles and texts are escaped by one backslash after
their first character; one that already has backslashes there gets one more,
so the escape is reversible and texts without control strings stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
_OPEN = r"([<\[])"
_REST = r"(?=\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + r"(\\*)" + _REST, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN + r"\\(\\*)" + _REST, "$1$2")


def expand_prefix_targets(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """One row per example: ``conv_id, example, n_turns, text, loss_start, loss_end``.

    ``text`` holds the formatted turns up to and including the target;
    ``[loss_start, loss_end)`` are code points of it: the target's escaped
    text.  A conversation that does not end in a target turn gets one last
    example with all its turns and an empty mask (``loss_start`` null), so no
    turn is lost.

    Null texts and roles count as empty.  Turns are ordered by turn, role and
    text, nulls first; repeated rows are all kept; rows with a null id form
    one conversation.  An empty table gives no rows.  Other columns are
    ignored.  A conversation is gathered in one row, since its longest example
    is one string of all its turns anyway.
    """
    r = F.coalesce(F.col(role), F.lit(""))
    t = F.coalesce(F.col(text), F.lit(""))
    body = escape(t)
    head = F.concat(F.lit(START), escape(r), F.lit(SEP))
    one = F.struct(
        F.col(turn).alias("turn"),
        r.alias("role"),
        t.alias("raw"),
        F.concat(head, body, F.lit(END)).alias("block"),
        F.length(head).alias("head"),
    )
    convs = (
        turns.select(F.col(conv).alias("conv_id"), one.alias("one"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("one")).alias("turns"))
        .select(
            "conv_id",
            F.transform("turns", lambda x: x["block"]).alias("blocks"),
            F.transform("turns", lambda x: x["head"]).alias("heads"),
            F.transform("turns", lambda x: x["role"] == target_role).alias("targets"),
        )
    )
    n = F.size("blocks")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("targets", i) | (i == n))
    out = convs.select("conv_id", "blocks", "heads", "targets", F.posexplode(ends).alias("pos", "upto"))
    whole = F.array_join(F.slice("blocks", F.lit(1), F.col("upto")), "")
    trained = F.element_at("targets", F.col("upto"))
    block_chars = F.length(F.element_at("blocks", F.col("upto")))
    out = out.select(
        "conv_id",
        (F.col("pos") + 1).cast("long").alias("example"),
        F.col("upto").cast("long").alias("n_turns"),
        whole.alias("text"),
        trained.alias("trained"),
        block_chars.alias("block_chars"),
        F.element_at("heads", F.col("upto")).alias("head"),
    )
    total = F.length("text")
    return out.select(
        "conv_id",
        "example",
        "n_turns",
        "text",
        F.when(F.col("trained"), (total - F.col("block_chars") + F.col("head")).cast("long")).alias("loss_start"),
        F.when(F.col("trained"), (total - len(END)).cast("long")).alias("loss_end"),
    )


def parse_turns(text: Column) -> Column:
    """Array of ``(role, text)`` read back from one formatted text."""
    blocks = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda b: b != "")
    bodies = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(START) + 1)), r"<\|im_sep\|>", 2))
    return F.transform(
        bodies, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text"))
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what its examples say: turns from the longest one, loss
    text from every mask in order, and the characters of all of them."""
    masked = F.when(
        F.col("loss_start").isNotNull(),
        unescape(F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))),
    )
    got = (
        examples.select(
            "conv_id",
            "example",
            F.length("text").cast("long").alias("chars"),
            "text",
            F.when(masked.isNotNull(), F.struct("example", masked.alias("said"))).alias("loss"),
        )
        .groupBy("conv_id")
        .agg(
            F.sum("chars").alias("formatted_chars"),
            F.max_by("text", "example").alias("whole"),
            F.sort_array(F.collect_list("loss")).alias("losses"),
        )
    )
    turns = parse_turns(F.col("whole"))
    said = F.array_join(F.transform("losses", lambda x: x["said"]), "")
    joined = F.array_join(F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return (
        got.select("conv_id", "formatted_chars", turns.alias("parsed"), said.alias("said"))
        .select(
            "conv_id",
            F.size("parsed").cast("long").alias("n_turns"),
            F.sha2(joined, 256).alias("turns_sha256"),
            F.length("said").cast("long").alias("loss_chars"),
            F.sha2(F.col("said"), 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
