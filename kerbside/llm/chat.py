"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its reply trainable.
A conversation that does not end with an assistant turn also gives an example without a target, so that every
turn is in the output. A turn is a header line with the role, the text, and a closing line; a backslash goes
before every backslash and control string of a text, so that the template can be read back.

Defined cases: null roles and texts are empty; turns of equal number are ordered by role, then text; repeated
rows are turns of their own; rows with a null conv_id form one conversation; extra columns are ignored; an empty
table gives no examples. The examples of one conversation hold the square of its turns, as the method has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "\n</turn>\n"
TARGET = "assistant"
_CONTROL = r"(\\|###|</turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|###|</turn>)", "$1")


def _header(role: Column) -> Column:
    """A line; line breaks in a role are written as \\n."""
    return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit(":\n"))


def expand(conversations: DataFrame) -> DataFrame:
    """``conv_id, target, formatted, loss_start, loss_end``: the examples, with their target's place among the
    turns (null without one) and its loss mask in code points of ``formatted``."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == TARGET).alias("targets"),
        F.transform("turns", lambda t: _header(t["role"])).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
    )
    whole = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE)))
    convs = convs.select("conv_id", "targets", "heads", "bodies", whole.alias("whole"), F.size("targets").alias("n"))
    place = F.sequence(F.lit(0), F.col("n") - 1)
    wanted = F.filter(place, lambda i: F.get("targets", i) | (i == F.col("n") - 1))
    one = convs.select("*", F.explode(wanted).alias("k"))
    is_target = F.get("targets", F.col("k"))
    before = F.array_join(F.slice("whole", 1, F.col("k")), "")
    one = one.select(
        "conv_id", F.when(is_target, F.col("k")).alias("target"), before.alias("before"),
        F.get("heads", F.col("k")).alias("head"), F.get("bodies", F.col("k")).alias("body"),
    )
    start = F.when(F.col("target").isNotNull(), F.length("before") + F.length("head"))
    return one.select(
        "conv_id", "target", F.concat("before", "head", "body", F.lit(CLOSE)).alias("formatted"),
        start.cast("long").alias("loss_start"), (start + F.length("body")).cast("long").alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as (role, text)."""
    # texts have no closing line without a backslash in it; the last part, behind the last one, is empty
    parts = F.split(formatted, "\n</turn>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    cut = lambda p: F.instr(p, ":\n")  # noqa: E731  roles have no line break
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.regexp_replace(p.substr(F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")).alias("role"),
            unescape(p.substr(cut(p) + 2, F.length(p))).alias("text"),
        ),
    )


def trained(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, as it was."""
    return unescape(formatted.substr(start.cast("int") + 1, (end - start).cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from them."""
    turns = F.transform(parse(F.col("longest")["formatted"]), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.array_sort("targets"), lambda x: x["text"]), "")
    own = F.struct("target", trained(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text"))
    by = examples.groupBy("conv_id").agg(
        F.max(F.struct(F.length("formatted").alias("n"), "formatted")).alias("longest"),
        F.collect_list(F.when(F.col("target").isNotNull(), own)).alias("targets"),
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
    )
    read = by.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
