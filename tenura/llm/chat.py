"""Chat formatting with a checked round trip.

A conversation is rendered turn by turn between control strings; turns whose text or role holds a
control string are escaped. The rendered text is parsed again by a regular expression that reads it
in one way only, and the turns it gives back are compared with the source; a conversation that
differs is rendered with all its content escaped. Escaped content is marked, so the parser knows
what to undo, and ``&`` is escaped with ``<`` and brackets, so every escape can be undone exactly.

Grammar of the rendered text (RAW has no control string, ESC no ``<`` and brackets at all):

    conversation = turn*
    turn         = "[INST] " text " [/INST]"        a user's turn
                 | "<s>" text "</s>"                an assistant's turn, under the loss mask
                 | "[ROLE=" role "] " text " [/ROLE]"
    text         = RAW | "<esc>" ESC

All work is DataFrame functions. A conversation is one record and must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER, ASSISTANT = "user", "assistant"
_ESC = "<esc>"
_TURN = (r"(?s)\[INST\] (.*?) \[/INST\]|<s>(.*?)</s>|\[ROLE=(.*?)\] (.*?) \[/ROLE\]")


def escape(text: Column) -> Column:
    """``text`` without ``<``, ``[`` and ``]``; ``&`` is escaped first, so this can be undone."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit("["), F.lit("&lb;"))
    return F.replace(out, F.lit("]"), F.lit("&rb;"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("&rb;"), F.lit("]"))
    out = F.replace(out, F.lit("&lb;"), F.lit("["))
    out = F.replace(out, F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def _text_of(turn: Column, escaped: Column) -> Column:
    return F.when(escaped, F.concat(F.lit(_ESC), escape(turn["text"]))).otherwise(turn["text"])


def _rendered(turn: Column, escaped: Column) -> Column:
    text = _text_of(turn, escaped)
    role = F.when(escaped, F.concat(F.lit(_ESC), escape(turn["role"]))).otherwise(turn["role"])
    return (F.when(turn["role"] == USER, F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(turn["role"] == ASSISTANT, F.concat(F.lit("<s>"), text, F.lit("</s>")))
            .otherwise(F.concat(F.lit("[ROLE="), role, F.lit("] "), text, F.lit(" [/ROLE]"))))


def _plain(value: Column) -> Column:
    return F.when(value.startswith(_ESC), unescape(F.substring(
        value, F.lit(len(_ESC) + 1), F.length(value)))).otherwise(value)


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a rendered conversation.

    The pieces of one pass: each group holds its turn's text, or nothing in turns of other kinds,
    whose whole match tells the kind.
    """
    whole = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    groups = [F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(i)) for i in (1, 2, 3, 4)]
    zipped = F.arrays_zip(whole.alias("m"), *[g.alias(f"g{i}") for i, g in enumerate(groups, 1)])

    def turn(z: Column) -> Column:
        m = z["m"]
        role = (F.when(m.startswith("[INST] "), F.lit(USER)).when(m.startswith("<s>"), F.lit(ASSISTANT))
                .otherwise(_plain(z["g3"])))
        text = (F.when(m.startswith("[INST] "), z["g1"]).when(m.startswith("<s>"), z["g2"])
                .otherwise(z["g4"]))
        return F.struct(role.alias("role"), _plain(text).alias("text"))

    return F.transform(zipped, turn)


def _join(turns: Column, chosen) -> Column:
    return F.array_join(F.transform(turns, chosen), "")


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns, formatted, recovered, level) for each conversation of ``rows``.

    ``turns`` and ``recovered`` are arrays of (role, text); they are equal for every row. ``level``
    says how much was escaped: 0 nothing, 1 turns with control strings, 2 everything. Null texts and
    roles count as empty; turns sort by turn, role and text, null turns first; equal rows are all
    kept; rows without a conversation id form one conversation.
    """
    clean = rows.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text")).alias("t"))
    convs = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda t: F.struct(t["role"], t["text"]))
                         .alias("turns"))
    convs = convs.withColumn("hard", F.exists("turns", _conflicts))
    convs = convs.withColumn("f1", _join(F.col("turns"), lambda t: _rendered(t, _conflicts(t))))
    convs = convs.withColumn("same", parse(F.col("f1")) == F.col("turns"))
    # Whatever the comparison still rejects is rendered with everything escaped.
    convs = convs.withColumn("formatted", F.when(F.col("same"), F.col("f1")).otherwise(
        _join(F.col("turns"), lambda t: _rendered(t, F.lit(True)))))
    level = F.when(~F.col("same"), 2).when(F.col("hard"), 1).otherwise(0)
    return convs.select("conv_id", "turns", "formatted", parse(F.col("formatted"))
                        .alias("recovered"), level.alias("level"))


def _conflicts(turn: Column) -> Column:
    return (turn["text"].contains("[INST] ") | turn["text"].contains(" [/INST]")
            | turn["text"].contains("<s>") | turn["text"].contains("</s>")
            | turn["text"].contains(" [/ROLE]") | turn["text"].contains("[ROLE=")
            | turn["text"].startswith(_ESC) | turn["role"].contains("] ")
            | turn["role"].startswith(_ESC))


def loss_spans(turns: Column) -> Column:
    """The assistant's texts in order: what the loss mask covers."""
    return F.transform(F.filter(turns, lambda t: t["role"] == ASSISTANT), lambda t: t["text"])


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted text gets back, as lengths and digests per conversation."""
    turns = F.col("recovered")
    text = _join(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(loss_spans(turns), "")
    return formatted.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "level")
