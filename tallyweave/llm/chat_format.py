"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are context, and its text alone is under the
loss mask. Turns after the last assistant turn, or of a conversation without one, make one more example under no
loss, so that nothing of a conversation is lost.

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

A backslash in a text is written \\e and `<|` is written \\p, so no text can hold a control string and the original
comes back by undoing both; in a role a newline is written \\n too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column, newline: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<|"), F.lit("\\p"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if newline else c


def unescape(c: Column, newline: bool = False) -> Column:
    c = F.replace(c, F.lit("\\n"), F.lit("\n")) if newline else c
    return F.replace(F.replace(c, F.lit("\\p"), F.lit("<|")), F.lit("\\e"), F.lit("\\"))


def chat_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length) from rows (conv_id, turn, role, text).

    loss_start and loss_length count code points of formatted; loss_length is null in an example without a target.
    Null roles and texts are empty, a null turn comes first, and turns with one number go by role, then text.
    Repeated rows are turns of their own. A conversation is put together in one row, as its formatted text is.
    """
    # Both of a turn's parts are known before the shuffle: its head, and its escaped text.
    said = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(START), escape(t["role"], True), F.lit("\n"))
    convs = convs.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("pieces"),
        F.transform("ts", lambda t: F.struct((t["role"] == "assistant").alias("target"), F.length(head(t)).alias("head"), F.length(escape(t["text"])).alias("body"))).alias("marks"),
    )
    n = F.size("marks")
    # Targets by position from 1; the closing example ends at the last turn if that is no target.
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("marks", i)["target"] | (i == F.size("marks")))
    each = convs.select("conv_id", "pieces", "marks", F.posexplode(targets).alias("example", "k"))
    mark, context = F.element_at("marks", F.col("k")), F.array_join(F.slice("pieces", F.lit(1), F.col("k") - 1), "")
    return each.select("conv_id", "example", mark.alias("mark"), context.alias("context"), F.element_at("pieces", F.col("k")).alias("own")).select(
        "conv_id", "example", F.concat("context", "own").alias("formatted"), (F.length("context") + F.col("mark.head")).cast("long").alias("loss_start"), F.when(F.col("mark.target"), F.col("mark.body")).cast("long").alias("loss_length")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    parts = F.slice(F.split(formatted, "<\\|im_start\\|>"), 2, 1 << 30)

    def turn(x: Column) -> Column:
        at = F.locate("\n", x)
        body = F.substring(x, at + 1, F.length(x) - at - len(END))
        return F.struct(unescape(F.substring(x, F.lit(1), at - 1), True).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def op4_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the examples of all conversations and of conversation -1, made of control strings."""
    trap = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    examples = chat_examples(rows)
    loss = F.when(F.col("loss_length").isNotNull(), unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))))
    read = examples.select("conv_id", "example", "formatted", F.length("formatted").cast("long").alias("chars"), loss.alias("loss"))
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
    )
    turns = whole.select("conv_id", "formatted_chars", "loss", read_turns(F.col("longest")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
