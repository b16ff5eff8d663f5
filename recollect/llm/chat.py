"""Chat formatting with Spark expressions alone.

Turns are collected as structs per conversation and block of places in it, sorted, and
adjacent turns of one role become one message: `<s>[INST] role [/INST] part<part>part</s>`.
Control strings inside roles and texts are escaped, so the output reads back to the very
turns.  The loss mask is a list of code-point ranges of the output, one per assistant turn.

Blocks keep a very long conversation from being one array of turns: `BLOCK_TURNS` turns are
formatted at a time, whatever their numbers, and only a block's text, last role and length
meet the neighbours'.  The formatted conversation itself is one cell.

Null texts and roles are empty, a null conversation or turn number groups and sorts (first)
as one more value, equal turn numbers sort by role and text, and an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE_ROLE, PART, END = "<s>[INST] ", " [/INST] ", "<part>", "</s>"
#: Escapes, in order: the escape character first.
ESCAPES = (("&", "&amp;"), ("<s>", "&lt;s>"), ("</s>", "&lt;/s>"), ("<part>", "&lt;part>"), ("[INST]", "&lsq;INST]"), ("[/INST]", "&lsq;/INST]"))
TRAINED_ROLE = "assistant"
BLOCK_TURNS = 256


def escaped(c: Column) -> Column:
    for plain, safe in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&lsq;"), F.lit("[")), F.lit("&amp;"), F.lit("&"))


def _split(c: Column, marker: str) -> Column:
    return F.split(c, rf"\Q{marker}\E", -1)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: array of struct(start, n) in code points of formatted."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("t"))
    turns = turns.withColumn("block", F.floor((place - 1) / BLOCK_TURNS))
    blocks = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("t"))
    blocks = blocks.select("conv_id", "block", "t", F.element_at("t", 1)["role"].alias("first_role"), F.element_at("t", -1)["role"].alias("last_role"))
    in_order = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.withColumn("before", F.lag("last_role").over(in_order))

    def lead_in(previous: Column, role: Column) -> Column:
        """What stands between the previous turn and a text of this role; a null previous: nothing came before."""
        opened = F.concat(F.lit(OPEN), escaped(role), F.lit(CLOSE_ROLE))
        return F.when(previous.isNull(), opened).when(previous == role, F.lit(PART)).otherwise(F.concat(F.lit(END), opened))

    def piece(t: Column, i: Column) -> Column:
        previous = F.when(i == 0, F.col("before")).otherwise(F.get(F.col("t"), i - 1)["role"])
        return F.struct(lead_in(previous, t["role"]).alias("lead"), escaped(t["text"]).alias("text"), (t["role"] == TRAINED_ROLE).alias("loss"))

    blocks = blocks.select("conv_id", "block", F.transform("t", piece).alias("p"))
    sizes = F.transform("p", lambda p: F.char_length(p["lead"]).cast("long") + F.char_length(p["text"]))
    blocks = blocks.withColumn("sizes", sizes)
    blocks = blocks.select(
        "conv_id",
        "block",
        F.array_join(F.transform("p", lambda p: F.concat(p["lead"], p["text"])), "").alias("text"),
        F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"),
        F.filter(
            F.transform(
                "p",
                lambda p, i: F.struct(
                    (F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x) + F.char_length(p["lead"])).alias("start"),
                    F.char_length(p["text"]).cast("long").alias("n"),
                    p["loss"].alias("loss"),
                ),
            ),
            lambda s: s["loss"],
        ).alias("spans"),
    )
    before = F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("at", before)
    placed = placed.select(
        "conv_id",
        F.struct("block", "text", F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["n"].alias("n"))).alias("spans")).alias("b"),
    )
    joined = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("b"))
    return joined.select(
        "conv_id",
        F.concat(F.array_join(F.transform("b", lambda b: b["text"]), ""), F.lit(END)).alias("formatted"),
        F.flatten(F.transform("b", lambda b: b["spans"])).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of struct(role, text)), loss_text: parsed from formatted and its mask alone."""
    messages = F.filter(_split(F.col("formatted"), END), lambda m: m != "")

    def parts(m: Column) -> Column:
        body = F.substring(m, F.lit(len(OPEN) + 1), F.char_length(m))
        role = F.element_at(_split(body, CLOSE_ROLE), 1)
        text = F.substring(body, F.char_length(role) + F.lit(len(CLOSE_ROLE) + 1), F.char_length(body))
        return F.transform(_split(text, PART), lambda x: F.struct(unescaped(role).alias("role"), unescaped(x).alias("text")))

    masked = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["n"].cast("int"))))
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(messages, parts)).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are control strings of the template."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, TRAINED_ROLE, text)], "conv_id long, turn long, role string, text string")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id and the digests of what the formatted output reads back to."""
    back = read_back(format_conversations(conversations))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
