"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only its text is trainable. A conversation that does not end with an
assistant turn gets one more example, whole and without a trainable part, so
that the output holds every turn.

A turn is written ``<s>ROLE[INST]TEXT[/INST]</s>``. In roles and texts the control
strings ``<s> </s> [INST] [/INST]`` get a backslash after their first character,
and such strings that already carry backslashes get one more, so the way back
(one backslash less) is exact and written turns hold no foreign control string.

``format_conversations`` returns one row per example: conv_id, example (1, 2, ...),
n_turns, formatted, loss_start and loss_end (code points, end exclusive; null
without a trainable part). ``read_back`` needs nothing but these rows.

Cases: null texts and roles are empty; rows of one conversation go by (turn, role,
text) with nulls first, repeated rows stay; rows with a null conv_id are one
conversation; only the role ``assistant`` is trainable; other columns are ignored. A
conversation is a row, so its examples must fit in memory, each with all its context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, TEXT, TEXT_END, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"


def escape(col):
    return F.regexp_replace(col, _CONTROL, r"$1$2\\$3")


def unescape(col):
    return F.regexp_replace(col, r"([<\[])(\\*)\\(/?(?:s>|INST\]))", "$1$2$3")


def format_conversations(turns: DataFrame) -> DataFrame:
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    marked = rows.select(
        "conv_id", "t", escape(F.col("t.role")).alias("role"), escape(F.col("t.text")).alias("text")
    ).select(
        "conv_id",
        F.struct(
            "t.turn", F.col("t.role").alias("by"), F.col("t.text").alias("said"),
            F.concat(F.lit(BEGIN), "role", F.lit(TEXT)).alias("head"), "text",
        ).alias("t"),
    )
    # In order of (turn, role, text): the first fields of the struct.
    whole = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    spots = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (F.element_at("turns", i)["by"] == "assistant") | (i == F.size("turns")),
    )
    one = whole.select("conv_id", "turns", F.posexplode(spots).alias("at", "n"))
    last = F.element_at("turns", F.col("n"))
    context = F.array_join(
        F.transform(
            F.slice("turns", F.lit(1), F.col("n") - 1),
            lambda t: F.concat(t["head"], t["text"], F.lit(TEXT_END + END)),
        ),
        "",
    )
    built = one.select(
        "conv_id", (F.col("at") + 1).alias("example"), F.col("n").alias("n_turns"), context.alias("context"),
        last["head"].alias("head"), last["text"].alias("reply"), (last["by"] == "assistant").alias("trains"),
    )
    start = F.char_length(F.concat("context", "head"))
    return built.select(
        "conv_id", "example", "n_turns",
        F.concat("context", "head", "reply", F.lit(TEXT_END + END)).alias("formatted"),
        F.when(F.col("trains"), start).cast("long").alias("loss_start"),
        F.when(F.col("trains"), start + F.char_length("reply")).cast("long").alias("loss_end"),
    )


def read_turns(formatted):
    """Array of (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")

    def parse(p):
        role = F.substring(F.substring_index(p, TEXT, 1), len(BEGIN) + 1, 2**31 - 1)
        said = F.element_at(F.split(p, r"\[INST\]", 2), 2)
        text = F.substring_index(said, TEXT_END, 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, parse)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its formatted examples alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars (of all its examples), n_examples."""
    loss = F.when(
        F.col("loss_start").isNotNull(),
        F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))"),
    )
    one = examples.select(
        "conv_id", "example", "n_turns", F.char_length("formatted").cast("long").alias("chars"),
        unescape(loss).alias("loss"), "formatted",
    )
    per = one.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    read = per.select(
        "conv_id", read_turns(F.col("whole")).alias("turns"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars", "n_examples",
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
