"""Chat formatting with a declarative template, with SQL functions only.

A finite-state machine over roles checks the order of turns: it starts in ``start``, each
role moves it along ``transitions``, and a role without a transition leads to the state
``bad``, which nothing leaves. The template turns each turn into three segments (opening
marker with the role, text, closing marker), each with a loss flag; the text of the roles
in ``loss_roles`` is under the loss mask, markers never are.

Control strings inside roles and texts are escaped reversibly: the escape character is
doubled and one is put inside every marker opening ``<|``, so a formatted conversation holds
``<|`` only where the template put it. In roles line feeds are escaped too.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = "bad"


@dataclass(frozen=True)
class Template:
    opening: str = "<|im_start|>"
    closing: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    transitions: Mapping[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def __post_init__(self):
        if not (self.opening.startswith("<|") and self.closing.startswith("<|")):
            raise ValueError("markers begin with <|, the only thing that is escaped in texts")


CHATML = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Each escape character goes and what follows it stays, from left to right."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # Pieces between doubled escapes hold single escapes only.
    pieces = F.transform(
        F.split(role, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    )
    return F.array_join(pieces, "\\")


def final_state(roles: Column, template: Template) -> Column:
    """State of the machine after all roles."""
    table = F.create_map(
        *(F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}>{role}", to))
    )
    return F.aggregate(
        roles,
        F.lit(template.start),
        lambda s, role: F.coalesce(F.element_at(table, F.concat(s, F.lit(">"), role)), F.lit(BAD)),
    )


def collect_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation, its turns in order.

    A conversation is one output value, so its turns meet in one row by nature. Ties and
    null turns (first) are put in order by role and text; null roles and texts are empty.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def format_chats(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, n_turns, segments, formatted, state, valid), one row per conversation.

    ``segments`` is an array of (text, loss); joined, they are ``formatted``. ``valid`` says
    that the machine ended in an accepting state; conversations out of order are formatted
    all the same. All rows with a null conv_id are one conversation. Extra columns are not
    read; no rows give no rows.
    """
    # The turn array is used several times below; one more aggregate would collapse into
    # the same node, so the expressions are kept as array functions over it.
    turns = collect_turns(rows)
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                _segment(F.concat(F.lit(template.opening), escape_role(t["role"]), F.lit("\n")), F.lit(False)),
                _segment(escape(t["text"]), t["role"].isin(list(template.loss_roles))),
                _segment(F.lit(template.closing), F.lit(False)),
            ),
        )
    )
    made = turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        segments.alias("segments"),
        final_state(F.transform("turns", lambda t: t["role"]), template).alias("state"),
    )
    return made.withColumn("formatted", joined(F.col("segments"))).withColumn(
        "valid", F.col("state").isin(list(template.accepting))
    )


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def joined(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def parse_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The (role, text) turns of a formatted conversation."""
    pieces = F.split(formatted, _literal(template.opening))
    return F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: _turn(F.split(F.substring_index(p, template.closing, 1), "\n", 2)),
    )


def _turn(parts: Column) -> Column:
    return F.struct(
        unescape_role(F.get(parts, F.lit(0))).alias("role"), unescape(F.get(parts, F.lit(1))).alias("text")
    )


def _literal(text: str) -> str:
    return "".join("\\" + c if c in "|<>.[](){}^$*+?\\" else c for c in text)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescape(s["text"])), "")


def digest_chats(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digest columns, read back from the formatted text and its segments."""
    back = F.transform(
        parse_turns(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    loss = loss_text(F.col("segments"))
    return formatted.select(
        "conv_id",
        F.size(back).cast("long").alias("n_turns"),
        F.sha2(F.array_join(back, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
