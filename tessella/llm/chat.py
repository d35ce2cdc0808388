"""Chat formatting by a grammar round trip. DataFrame functions only.

A turn is written ``<s>[INST]role[/INST]text</s>``, a conversation is its turns in order. The grammar is
deterministic: turns end at ``</s>``, the role at the first ``[/INST]``, and a control string anywhere
else (a lone ``[INST]`` in a text, say) is an error. Each turn is written plainly, parsed again and
compared with its source; if it is no turn of the grammar, or reads as another one, its role and text are
escaped. Escaping puts a backslash after the first character of each control string, and of each that
is escaped already, so that reading takes one away again; the whole is then parsed and compared once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
_LIVE = r"[<\[]/?(?:s>|INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def written(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit(MIDDLE), text, F.lit(END))


def parsed(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text; a turn that isn't of the grammar has a null role."""
    pieces = F.split(formatted, END, -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"\[/INST\]", 2)
        role, text = F.substr(halves[0], F.lit(len(BEGIN) + 1)), F.get(halves, F.lit(1))
        whole = piece.startswith(BEGIN) & (F.size(halves) == 2) & ~role.rlike(_LIVE) & ~text.rlike(_LIVE)
        return F.struct(F.when(whole, unescape(role)).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def formatted(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): a row for each conversation, with the spans (code points, end exclusive) under the loss mask.

    The mask covers the texts of the role ``learn``. Rows are ordered by turn, then role and text; null
    turns come first. A null role or text counts as empty. Repeated rows are repeated turns. Rows with a
    null id are one conversation. A conversation is one text, and has to fit a task.
    """
    source = conversations.select(F.col(conv_id).alias("c"), F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    plain = written(F.col("r"), F.col("t"))
    same = F.coalesce(parsed(plain) == F.array(F.struct(F.col("r").alias("role"), F.col("t").alias("text"))), F.lit(False))
    rows = source.withColumn("same", same)
    for c in ("r", "t"):
        rows = rows.withColumn(f"{c}w", F.when(F.col("same"), F.col(c)).otherwise(escape(F.col(c))))
    rows = rows.withColumn("w", written(F.col("rw"), F.col("tw"))).withColumn("size", F.length("w").cast("long"))
    order = Window.partitionBy("c").orderBy("n", "r", "t")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.coalesce("before", F.lit(0)) + F.length("rw") + len(BEGIN) + len(MIDDLE)
    span = F.when(F.col("r") == learn, F.struct(start.alias("start"), (start + F.length("tw")).alias("end")))
    each = rows.select("c", F.struct("at", "w", F.struct(F.col("r").alias("role"), F.col("t").alias("text")).alias("s"), span.alias("span")).alias("x"))
    whole = each.groupBy("c").agg(F.sort_array(F.collect_list("x")).alias("x")).withColumn("formatted", F.array_join("x.w", ""))
    true = F.coalesce(parsed(F.col("formatted")) == F.col("x.s"), F.lit(False))
    checked = F.when(true, F.col("formatted")).otherwise(F.raise_error(F.lit("a formatted conversation doesn't read back as its source")).cast("string"))
    return whole.select(F.col("c").alias(conv_id), checked.alias("formatted"), F.filter("x.span", lambda s: s.isNotNull()).alias("loss"))


def read_back(out: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """What the formatted texts and their masks say: turns, and the texts to be learned."""
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    turns = out.select(conv_id, "formatted", parsed(F.col("formatted")).alias("turns"), loss.alias("loss"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return turns.select(conv_id, F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
