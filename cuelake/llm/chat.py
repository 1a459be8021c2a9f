"""Prefix-target expansion of conversations.

Every assistant turn becomes an example: all turns before it as context, and only its own text trainable. A conversation that does
not end with an assistant turn also gives one example without a target ("rest"), so no turn is lost.

Template: each turn starts with <s> and ends with </s>; a user's text stands in [INST] [/INST], and any role but user and assistant
is named in <<SYS>> <</SYS>>. These control strings inside texts and role names get a backslash after their first character, one
more than they may already have there, which `unescape` takes away again.

Only DataFrame functions are used. Defined cases: rows are ordered by (turn, role, text), nulls first; a null role or text is empty; a null
conv_id is a conversation of its own; repeated rows are repeated turns. An example is one string and holds its whole context,
so a conversation's examples together grow with the square of its turns: that is what the expansion is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = r"(<)(\\*)(/?s>|</?SYS>>)|(\[)(\\*)(/?INST\])"
ESCAPED = r"(<)\\(\\*)(/?s>|</?SYS>>)|(\[)\\(\\*)(/?INST\])"
START, END = "<s>", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$4\\$2$5$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$4$2$5$3$6")


def render(role: Column, text: Column) -> Column:
    """One turn in the template."""
    body = (F.when(role == "user", F.concat(F.lit("[INST]"), escape(text), F.lit("[/INST]")))
            .when(role == "assistant", escape(text))
            .otherwise(F.concat(F.lit("<<SYS>>"), escape(role), F.lit("<</SYS>>"), escape(text))))
    return F.concat(F.lit(START), body, F.lit(END))


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turn (of the last turn in the example), kind (reply or rest), formatted, loss_start, loss_chars (code points)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = (turns.withColumn("part", render(F.col("role"), F.col("text")))
             .withColumn("n_turn", F.row_number().over(order))
             .withColumn("last", F.lead(F.lit(False), 1, True).over(order))
             .withColumn("parts", F.collect_list("part").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    reply = F.col("role") == "assistant"
    formatted = F.array_join("parts", "")
    loss = F.length("part") - len(START) - len(END)
    return (turns.where(reply | F.col("last")).withColumn("formatted", formatted)
            .select("conv_id", "n_turn", F.when(reply, "reply").otherwise("rest").alias("kind"), "formatted",
                    F.when(reply, F.length("formatted") - F.length("part") + len(START)).alias("loss_start"),
                    F.when(reply, loss).otherwise(0).alias("loss_chars")))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example as array<struct<role, text>>."""
    def turn(part: Column) -> Column:
        system = part.startswith("<s><<SYS>>")
        role = (F.when(system, unescape(F.regexp_extract(part, r"(?s)^<s><<SYS>>(.*?)<</SYS>>", 1)))
                .when(part.startswith("<s>[INST]"), "user").otherwise("assistant"))
        text = (F.when(system, F.regexp_replace(part, r"(?s)^<s><<SYS>>.*?<</SYS>>", ""))
                .when(part.startswith("<s>[INST]"), F.substring(part, F.lit(10), F.length(part) - 16))
                .otherwise(F.substring(part, F.lit(4), F.length(part))))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    parts = F.split(formatted, END, -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def format_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, all read back from the examples: its turns, and the text under the loss masks."""
    examples = prefix_targets(conversations)
    lost = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars")))
    per = (examples.withColumn("loss", F.when(F.col("kind") == "reply", lost))
           .groupBy("conv_id").agg(F.max_by("formatted", "n_turn").alias("whole"), F.sum(F.length("formatted")).alias("formatted_chars"),
                                   F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("n_turn", "loss")))).alias("losses")))
    turns, loss = F.col("turns"), F.array_join("losses.loss", "")
    flat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (per.withColumn("turns", read_turns(F.col("whole")))
            .select("conv_id", F.size(turns).cast("bigint").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
                    F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars"))
