r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it as context, its reply as the only
trainable span. A conversation that does not end with an assistant turn gets one more example, with
all turns and nothing to train on, so the output always holds the whole conversation.

A turn is `### <role>:\n<text></turn>\n`. In texts and roles a backslash goes after every
backslash, # and < (in roles also :), so no marker can stand inside them; reading removes it.

Nulls: a null text or role is empty; null turns come first; turns of equal number go by role, then
text; a null conv_id is a conversation. Repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"


def _escaped(column: str, chars: str) -> str:
    return rf"regexp_replace({column}, '([{chars}])', '$1\\\\')"


def _plain(column: str) -> str:
    return rf"regexp_replace({column}, '([\\\\#<:])\\\\', '$1')"


def expand_prefixes(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, example, last, text, loss_start, loss_chars: one row per assistant turn.

    loss_start and loss_chars (code points) mark the trainable part of `text`; loss_chars is null
    where nothing is. A conversation is one row until it is expanded row by row."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    escaped = f"transform(turns, t -> struct(concat('### ', {_escaped('t.role', r'\\\\#<:')}, ':\\n') as head, {_escaped('t.text', r'\\\\#<')} as body, t.role = '{assistant}' as own))"
    d = d.select("conv_id", F.expr(escaped).alias("turns")).withColumn("n", F.size("turns"))
    ends = "filter(sequence(1, n), i -> element_at(turns, i).own or i = n)"
    d = d.select("conv_id", "turns", "n", F.posexplode(F.expr(ends)).alias("example", "i"))
    before = r"concat_ws('', transform(slice(turns, 1, i - 1), t -> concat(t.head, t.body, '</turn>\n')))"
    d = d.select("conv_id", "example", (F.col("i") == F.col("n")).alias("last"), F.expr(f"concat({before}, element_at(turns, i).head)").alias("context"), F.expr("element_at(turns, i)").alias("turn"))
    return d.select(
        "conv_id", "example", "last", F.concat("context", "turn.body", F.lit(END)).alias("text"),
        F.when(F.col("turn.own"), F.length("context")).alias("loss_start"), F.when(F.col("turn.own"), F.length("turn.body")).alias("loss_chars"),
    )


def read_examples(examples: DataFrame) -> DataFrame:
    """Contract columns of op10, from the formatted examples alone."""
    piece = r"regexp_extract(p, '(?s)^### (.*?):\n(.*)$', {})"
    pieces = r"filter(split(text, '</turn>\n', -1), (p, i) -> i < size(split(text, '</turn>\n', -1)) - 1)"
    whole = F.when(F.col("last"), F.expr(f"transform({pieces}, p -> concat({_plain(piece.format(1))}, '\\n', {_plain(piece.format(2))}, '\\n'))"))
    loss = F.expr(_plain("substring(text, loss_start + 1, loss_chars)"))
    d = examples.select("conv_id", "example", F.length("text").cast("long").alias("chars"), F.size(whole).alias("n_turns"), F.when(F.col("last"), F.sha2(F.array_join(whole, "").cast("binary"), 256)).alias("turns_sha256"), F.when(F.col("loss_chars").isNotNull(), loss).alias("loss"))
    d = d.groupBy("conv_id").agg(F.max(F.when(F.col("n_turns") >= 0, F.col("n_turns"))).alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.array_sort(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"))
    text = F.array_join(F.expr("transform(losses, x -> x.loss)"), "")
    return d.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "turns_sha256", F.length(text).cast("long").alias("loss_chars"), F.sha2(text.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")
