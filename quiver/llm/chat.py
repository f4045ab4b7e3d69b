"""Chat formatting by a grammar round trip (operator 12), DataFrame functions only.

A turn is rendered as ``open role head text close`` (:class:`Template`), and a
deterministic parser reads rendered text back: the control strings cut it into
pieces, and the sequence of controls must be ``open head close`` over and over
with nothing outside.  Every turn is rendered as it is first and read back; a
turn that does not come back the same is escaped and rendered again until it
does.  A control string with n backslashes after its first character is
escaped to n + 1 of them, so unescaping is exact and no control string is ever
left inside a text.  A control string begins with a character that stands
nowhere else in it and ends with one that stands nowhere else in it, so none
can arise where two pieces meet; what holds for each turn holds for the
conversation.

Conversations are stored in parts of ``PART_TURNS`` turn numbers, so a
conversation of any length is many rows; only :func:`chat_digest`, whose
digests are defined on a whole conversation, brings one conversation's text
together in a row.

Defined results: rows are ordered by turn, then role, then text, nulls first
(repeated rows are kept); a null text or role counts as empty; rows without a
``conv_id`` form one conversation with a null id; any role is kept as it is
(``assistant``, exactly, is the one with loss); other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiver.llm.common import written

#: Turn numbers per stored part of a conversation.
PART_TURNS = 64


@dataclass(frozen=True)
class Template:
    """Control strings of the format; ``reserved`` ones mark nothing here but
    are escaped like the others, as a tokenizer would read them as controls."""

    open: str = "[INST]"
    head: str = "[/INST]"
    close: str = "</s>"
    reserved: tuple[str, ...] = ("<s>",)

    def __post_init__(self):
        controls = self.controls
        if len(set(controls)) < len(controls):
            raise ValueError("control strings must differ")
        for c in controls:
            if len(c) < 3 or "\\" in c or c[1:].count(c[0]) or c[:-1].count(c[-1]):
                raise ValueError(f"{c!r} must hold its first and its last character once, and no backslash")
            if any(c[0] in d[1:] or c[-1] in d[:-1] for d in controls):
                raise ValueError(f"the first and the last character of {c!r} stand inside another control string")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.head, self.close, *self.reserved)

    @property
    def control(self) -> str:
        """Pattern of a control string."""
        return "|".join(re.escape(c) for c in self.controls)

    @property
    def marked(self) -> str:
        """Pattern of a control string with any number of backslashes in it."""
        return "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in self.controls)


def escape(text: Column, template: Template) -> Column:
    """One backslash more in every control string, escaped or not."""
    return F.regexp_replace(text, rf"(?s)(?={template.marked})(.)", r"$1\\")


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"(?s)(?={template.marked})(.)\\", "$1")


def render(role: Column, text: Column, template: Template) -> Column:
    return F.concat(F.lit(template.open), role, F.lit(template.head), text, F.lit(template.close))


def parse(formatted: Column, template: Template) -> Column:
    """``array<struct<role, text>>`` of rendered turns, unescaped; null when the
    text is not a sequence of turns."""
    cut = F.split(formatted, template.control, -1)
    seen = F.regexp_extract_all(formatted, F.lit(f"({template.control})"), 1)
    turns = F.floor(F.size(seen) / 3).cast("int")
    cycle = F.array(*[F.lit(c) for c in (template.open, template.head, template.close)])
    outside = F.filter(cut, lambda piece, i: (i % 3 == 0) & (piece != ""))
    valid = (seen == F.flatten(F.array_repeat(cycle, turns))) & (F.size(outside) == 0)
    read = F.transform(
        F.filter(cut, lambda _, i: i % 3 == 1),
        lambda role, i: F.struct(
            unescape(role, template).alias("role"),
            unescape(F.get(cut, i * 3 + 2), template).alias("text"),
        ),
    )
    return F.when(valid, read)


def rendered_turns(turns: DataFrame, template: Template, max_rounds: int = 8) -> DataFrame:
    """``conv_id, turn, role, text, body_role, body_text, formatted``: each turn
    as it is rendered, having been read back to its own role and text.

    A round renders, parses and compares the turns that are left; the ones that
    differ are escaped once more for the next round.  ``max_rounds`` only stops
    an endless loop (with an error), as one escape is enough for any text."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    left = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), role.alias("body_role"), text.alias("body_text"))
    settled = []
    for _ in range(max_rounds):
        tried = left.withColumn("formatted", render(F.col("body_role"), F.col("body_text"), template))
        same = parse(F.col("formatted"), template) == F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
        tried = written(tried.withColumn("same", F.coalesce(same, F.lit(False))), "chat-round")
        settled.append(tried.where("same"))
        left = tried.where("not same").drop("same", "formatted").withColumns(
            {c: escape(F.col(c), template) for c in ("body_role", "body_text")}
        )
        if left.isEmpty():
            break
    else:
        raise ValueError("turns that cannot be read back")
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    return done.drop("same")


def format_conversations(turns: DataFrame, template: Template = Template(), loss_role: str = "assistant") -> DataFrame:
    """``conv_id, part, n_turns, formatted, loss``: conversations as training
    text, ``PART_TURNS`` turn numbers to a row (in order of ``part``), and the
    loss mask as ``array<struct<start, length>>`` in code points of the part."""
    size = F.length("formatted")
    rows = rendered_turns(turns, template).withColumn("part", F.floor(F.col("turn") / PART_TURNS).cast("long"))
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    before = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    ahead = F.length("body_role") + len(template.open) + len(template.head)
    span = F.struct((before + ahead).cast("long").alias("start"), F.length("body_text").cast("long").alias("length"))
    placed = rows.select(
        "conv_id", "part",
        F.struct(
            F.row_number().over(order).alias("at"), "formatted",
            F.when(F.col("role") == loss_role, span).alias("loss"),
        ).alias("t"),
    )
    one = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return one.select(
        "conv_id", "part", F.size("t").cast("long").alias("n_turns"),
        F.array_join("t.formatted", "").alias("formatted"), F.array_compact("t.loss").alias("loss"),
    )


def read_conversations(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """``conv_id, part, turns array<struct<role, text>>, loss array<string>,
    formatted_chars`` parsed back from the formatted text and its mask."""
    under = F.transform(
        "loss", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")), template)
    )
    return parts.select(
        "conv_id", "part", parse(F.col("formatted"), template).alias("turns"), under.alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_digest(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation what its formatted parts hold: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    read = read_conversations(parts, template).select(
        "conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"),
        F.struct("part", said.alias("said"), F.array_join("loss", "").alias("loss")).alias("p"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
        F.sort_array(F.collect_list("p")).alias("p"),
    )
    loss = F.array_join("p.loss", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("p.said", "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: two turns that quote the format's control strings."""
    quoted = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", quoted), (-7, 1, "assistant", quoted)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def formatted_digest(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Format, write, read the written parts back and digest them."""
    return chat_digest(written(format_conversations(turns, template), "chat-parts"), template)
