"""Chat formatting with column functions only: a declarative template, a finite-state machine over roles, loss flags.

A template names the strings that mark turns, the roles whose text carries the loss, the allowed steps between roles
and the strings that may never appear inside a text. A turn is written as open + role + body + text + close. Inside
roles and texts every backslash is doubled and a backslash is put after the first character of every control string,
so no control string remains and unescaping gives back the exact text.

Defined cases: a null role or text is empty; turns are in the order of turn (null first), then role, then text, so
repeated rows give repeated turns; rows with a null conversation form one conversation; a conversation that the
machine does not accept is still written, with valid = false; roles that the template does not know are written
without loss; texts of any length are written whole; other columns of the input are not carried; an empty table gives an empty table. A conversation is one
record, so its turns meet in one row; nothing wider is collected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a conversation is written. steps: state -> {role: next state}; accepting: states in which one may end."""

    start: str = "<s>"
    open: str = "<|turn|>"
    body: str = "<|text|>"
    close: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    steps: dict = field(default_factory=lambda: {"begin": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    accepting: tuple[str, ...] = ("answered",)
    more_controls: tuple[str, ...] = ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.open, self.body, self.close, *self.more_controls)


def escape(text: Column, template: Template) -> Column:
    """Text in which no control string of the template appears."""
    firsts = sorted({c[0] for c in template.controls})
    found = "|".join(f"{re.escape(a)}(?={'|'.join(sorted(re.escape(c[1:]) for c in template.controls if c[0] == a))})" for a in firsts)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({found})", r"$1\\")


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def end_state(roles: Column, template: Template) -> Column:
    """The machine's state after the roles; 'refused' once a step is not allowed."""
    pairs = [F.lit(x) for state, by_role in template.steps.items() for role, to in by_role.items() for x in (f"{state}\n{role}", to)]
    steps = F.create_map(*pairs)
    return F.aggregate(roles, F.lit("begin"), lambda state, role: F.coalesce(F.try_element_at(steps, F.concat(state, F.lit("\n"), role)), F.lit("refused")))


def format_chats(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, state, valid, segments (text and loss flag, in order) and formatted (the segments' texts joined)."""
    of_turn = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = df.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(of_turn)).alias("turns"))
    segment = lambda words, loss: F.struct(words.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    written = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.body)), no),
                segment(escape(t["text"], template), t["role"].isin(*template.loss_roles)),
                segment(F.lit(template.close), no),
            ),
        )
    )
    state = end_state(F.transform("turns", lambda t: t["role"]), template)
    return chats.select(
        "conv_id",
        state.alias("state"),
        state.isin(*template.accepting).alias("valid"),
        F.concat(F.array(segment(F.lit(template.start), no)), written).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation as array<struct<role,text>>."""
    inside = F.substring(formatted, len(template.start) + 1, 2**31 - 1)
    parts = F.filter(F.split(inside, re.escape(template.close), -1), lambda p: p != "")

    def turn(part):
        both = F.split(F.substring(part, len(template.open) + 1, 2**31 - 1), re.escape(template.body), 2)
        return F.struct(unescape(both[0]).alias("role"), unescape(both[1]).alias("text"))

    return F.transform(parts, turn)


def read_loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
