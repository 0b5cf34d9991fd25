r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context and only its reply is trainable.  Turns after the last reply, or a
conversation without replies, end in one more example that trains nothing, so
no turn is lost.

A turn reads ``<s>[INST] role [/INST]text</s>``.  Inside roles and texts every
backslash is doubled and every control string gets a backslash after its first
character, so none is left; taking one backslash away before each character
that follows one gives the text back.

A conversation is one group: its turns meet in one row, because each example
holds its whole prefix.  Conversations are dealt by conv_id in one shuffle;
examples are made and read back without another.

Defined results: a null role or text is empty; rows are ordered by turn, ties
by role, then text, nulls first; equal rows are separate turns; rows with a null
conv_id are one conversation; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"\\|(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])"
OPEN, NAMED, CLOSE = "<s>[INST] ", " [/INST]", "</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(turn["role"]), F.lit(NAMED))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and its turns (turn, role, text) in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def examples(rows: DataFrame, reply: str = "assistant") -> DataFrame:
    """conv_id, example, target_turn, formatted, loss_start, loss_stop (code points).

    ``target_turn`` is the index of the trainable turn, null where there is none.
    """
    told = conversations(rows).select(
        "conv_id", "turns", F.transform("turns", lambda t: F.concat(head(t), escaped(t["text"]), F.lit(CLOSE))).alias("said")
    )
    last = F.size("turns") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(F.col("turns"), i)["role"] == reply) | (i == last))

    each = told.select("conv_id", "turns", "said", F.posexplode(targets).alias("example", "target"))  # one prefix a row
    target, turn = F.col("target"), F.get(F.col("turns"), F.col("target"))
    trains, body = turn["role"] == reply, escaped(turn["text"])
    prefix = F.concat(F.array_join(F.slice("said", F.lit(1), target), ""), head(turn))
    made = each.select("conv_id", "example", F.when(trains, target).alias("target_turn"), trains.alias("trains"), prefix.alias("prefix"), body.alias("body"))
    start = F.length("prefix")
    return made.select(
        "conv_id", "example", "target_turn", F.concat("prefix", "body", F.lit(CLOSE)).alias("formatted"),
        start.alias("loss_start"), F.when(F.col("trains"), start + F.length("body")).otherwise(start).alias("loss_stop"),
    )


def read_turns(formatted: Column) -> Column:
    """role and text of every turn of a formatted example."""
    pieces = F.split(formatted, CLOSE, -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        parts = F.split(F.substr(piece, F.lit(len(OPEN) + 1)), r" \[/INST\]", 2)
        return F.struct(unescaped(parts[0]).alias("role"), unescaped(parts[1]).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, start: Column, stop: Column) -> Column:
    return unescaped(F.substr(formatted, start + 1, stop - start))


def digest(made: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from their text."""
    loss = loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_stop"))
    read = made.select("conv_id", "example", "formatted", loss.alias("loss"))
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    whole = whole.select("conv_id", read_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
