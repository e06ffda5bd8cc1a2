"""Chat formatting with a grammar round trip, with DataFrame functions only.

A turn is rendered as ``<|turn|>`` role ``<|text|>`` text ``</s>``. A deterministic parser reads it back: it cuts at the end marks,
takes the role up to the first text mark and undoes the escapes; it refuses texts that hold control strings. Each turn is rendered,
parsed and compared with its source; what doesn't come back identical is escaped further:

* level 0: the text as it is;
* level 1: the first character of each control string, and the escape character, stand as ``\\`` and a digit;
* level 2: every ``<``, ``[`` and ``\\`` does.

The conversation is then parsed as a whole and compared once more; should it differ, all its turns go to level 2.

Scale: one shuffle by conversation. A conversation is one output row, so its turns meet in one task; nothing else is gathered.

Defined results
---------------
* Turns go by turn number (null last), then role and text, so ties and repeated rows have a fixed order; each row is a turn.
* Null texts and roles are empty. Rows with a null conversation id form one conversation. Extra columns are ignored.
* An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"
#: Control strings of this template and of common others.
CONTROLS = (TURN, TEXT, END, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>")
#: Escapes: the escape character itself, and the characters that control strings begin with.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))
ANY_CONTROL = "|".join(f"\\Q{c}\\E" for c in CONTROLS)


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column, level: int) -> Column:
    if level == 0:
        return text
    out = _replace(text, *ESCAPES[0])
    if level == 1:
        for control in CONTROLS:
            out = _replace(out, control, dict(ESCAPES)[control[0]] + control[1:])
        return out
    for old, new in ESCAPES[1:]:
        out = _replace(out, old, new)
    return out


def unescaped(text: Column) -> Column:
    for old, new in reversed(ESCAPES):
        text = _replace(text, new, old)
    return text


def rendered(role: Column, text: Column) -> Column:
    """One turn; role and text are escaped already."""
    return F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END))


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation as structs of role and text; a turn that breaks the grammar is null."""
    pieces = F.split(formatted, f"\\Q{END}\\E", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(TURN) + 1), F.length(piece))
        cut = F.locate(TEXT, body)
        role, text = F.substring(body, F.lit(1), cut - 1), F.substring(body, cut + len(TEXT), F.length(body))
        good = piece.startswith(TURN) & (cut > 0) & ~text.rlike(ANY_CONTROL) & ~role.rlike(ANY_CONTROL)
        return F.when(good, F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")))

    return F.transform(turns, turn)


def format_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn_from: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, round_trip): one row per conversation.

    loss_spans are the stretches of formatted (start from 0, length; in code points) that are texts of the roles in learn_from.
    round_trip tells whether the parser gives back the source, which it does for every conversation.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    same = lambda level: F.get(parsed(rendered(escaped(F.col("role"), 2), escaped(F.col("text"), level))), F.lit(0)).eqNullSafe(
        F.struct("role", "text")
    )
    level = F.when(same(0), escaped(F.col("text"), 0)).when(same(1), escaped(F.col("text"), 1)).otherwise(escaped(F.col("text"), 2))
    rows = rows.withColumns({"head": F.concat(F.lit(TURN), escaped(F.col("role"), 2), F.lit(TEXT)), "least": level, "full": escaped(F.col("text"), 2)})
    earlier = W.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text").rowsBetween(W.unboundedPreceding, -1)
    size = lambda c: F.length("head") + F.length(c) + len(END)
    rows = rows.withColumns(
        {f"{c}_at": (F.coalesce(F.sum(size(c)).over(earlier), F.lit(0)) + F.length("head")).cast("long") for c in ("least", "full")}
        | {"place": F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text"))}
    )
    turns = F.sort_array(F.collect_list(F.struct("place", "role", "text", "head", "least", "full", "least_at", "full_at")))
    rows = rows.groupBy("conv_id").agg(turns.alias("turns"))
    joined = lambda c: F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t[c], F.lit(END))), "")
    rows = rows.withColumn("source", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    rows = rows.withColumn("formatted", joined("least"))
    rows = rows.withColumn("good", parsed(F.col("formatted")).eqNullSafe(F.col("source")))
    rows = rows.withColumn("formatted", F.when(F.col("good"), F.col("formatted")).otherwise(joined("full")))
    learned = F.filter("turns", lambda t: t["role"].isin(*learn_from))
    span = lambda c: F.transform(learned, lambda t: F.struct(t[f"{c}_at"].alias("start"), F.length(t[c]).cast("long").alias("length")))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        "formatted",
        F.when(F.col("good"), span("least")).otherwise(span("full")).alias("loss_spans"),
        parsed(F.col("formatted")).eqNullSafe(F.col("source")).alias("round_trip"),
    )


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, read back from a formatted conversation."""
    cut = lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
    return F.transform(spans, lambda s: unescaped(cut(s)))
