"""Chat formatting with Spark expressions alone: turns to one marked text, and back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template.  All control strings begin with "<", which escaped texts do not hold.
OPEN, CLOSE_ROLE, NEXT, CLOSE = "<turn ", ">", "<next/>", "</turn>\n"
ASSISTANT = "assistant"


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\b``, ``<`` becomes ``\l``, ``>`` becomes ``\g``."""
    return _swap(text, ("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``; each backslash in an escaped text begins a pair, so the order is safe."""
    return _swap(text, ("\\g", ">"), ("\\l", "<"), ("\\b", "\\"))


def _piece(text: Column, loss: Column | bool) -> Column:
    return F.struct(text.alias("piece"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, pieces`` of ``turns (conv_id, turn, role, text)``.

    Turns are sorted by ``turn``, repeated ones also by role and text, a null turn
    first.  Adjacent turns of one role form a block ``<turn role>text<next/>text</turn>``;
    null texts and roles are empty.  ``pieces`` cuts ``formatted`` into consecutive
    pieces, and ``loss`` marks those under the loss mask: the texts of assistant
    turns, without any control string.  Each piece is made from its own row and the
    row before, so the cost is linear in the turns.  An empty table gives an empty
    one; rows of a null ``conv_id`` form one conversation.  A conversation is one
    row of output, which bounds it to what a row can hold.
    """
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = ordered.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("turns") - 1),
            lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]),
        ),
    )
    blocks = blocks.withColumn("ends", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns"))))
    merged = blocks.withColumn(
        "blocks",
        F.transform(
            F.arrays_zip("starts", "ends"),
            lambda b: F.struct(
                F.get("turns", b["starts"])["role"].alias("role"),
                F.transform(F.slice("turns", b["starts"] + 1, b["ends"] - b["starts"]), lambda t: t["text"]).alias("texts"),
            ),
        ),
    )
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.concat(
                F.array(_piece(F.concat(F.lit(OPEN), escape(b["role"]), F.lit(CLOSE_ROLE)), False)),
                F.flatten(
                    F.transform(
                        b["texts"],
                        lambda x, i: F.concat(
                            F.when(i > 0, F.array(_piece(F.lit(NEXT), False))).otherwise(
                                F.array(_piece(F.lit(""), False))
                            ),
                            F.array(_piece(escape(x), b["role"] == ASSISTANT)),
                        ),
                    )
                ),
                F.array(_piece(F.lit(CLOSE), False)),
            ),
        )
    )
    result = merged.select("conv_id", pieces.alias("pieces"))
    return result.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
        F.filter("pieces", lambda p: p["piece"] != "").alias("pieces"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped: an array of ``role, text``."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substr(b, F.locate(CLOSE_ROLE, b) + 1), NEXT),
                lambda x: F.struct(
                    unescape(F.substr(b, F.lit(len(OPEN) + 1), F.locate(CLOSE_ROLE, b) - 1 - len(OPEN))).alias("role"),
                    unescape(x).alias("text"),
                ),
            ),
        )
    )


def loss_text(pieces: Column) -> Column:
    """What lies under the loss mask, unescaped and joined without anything between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["piece"])), "")
