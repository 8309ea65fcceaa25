"""Chat formatting: a role automaton over turns and a declarative template (built-in functions only).

A conversation becomes one string and the list of its segments, each with a loss
flag. Every control string of the template is broken up inside texts by an escape
character, so the markers found in the output are the template's own, and
:func:`read_back` recovers roles and texts exactly.

Defined results: a null text is empty; a null role is the empty role; a role that
the template doesn't know is written in hexadecimal and makes the conversation
invalid; turns with equal number are ordered by role, then text; null turns come
first; rows without a conversation id form one conversation; no rows, no output.
Invalid conversations are formatted all the same, `valid` is false and `bad_turn`
is the position of the first turn that the automaton refuses (the number of turns
if it only ends in the wrong state). Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm._io import renamed


@dataclass(frozen=True)
class Template:
    """What a turn looks like, which text is trained on, and which order of roles is right."""

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    head: str = "### "
    after_label: str = ": "
    close: str = "</turn>\n"
    control: tuple[str, ...] = ("###", "</turn>")
    escape: str = "\\"
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed",
            ("start", "user"): "asked",
            ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accept: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        if any(len(c) < 2 or self.escape in c for c in self.control):
            raise ValueError("a control string has two characters or more and no escape character")
        if any(self.after_label in x or x.startswith("?") for x in self.labels.values()) or len(set(self.labels.values())) < len(self.labels):
            raise ValueError("labels are distinct, hold no separator and begin with no question mark")
        if not any(c in self.head for c in self.control) or not any(c in self.close for c in self.control):
            raise ValueError("the head and the close each hold a control string")


def _java(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text)


def escaped(text: Column, t: Template) -> Column:
    """No control string is left whole: the escape character goes in after its first character."""
    e = _java(t.escape)
    out = F.regexp_replace(text, f"({e})", "$1$1")
    for c in t.control:
        out = F.regexp_replace(out, f"({_java(c[0])})(?={_java(c[1:])})", "$1" + _java(t.escape))
    return out


def unescaped(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"(?s){_java(t.escape)}(.)", "$1")


def _lookup(pairs: dict[str, str], key: Column, default: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, key), default)


def format_chat(rows: DataFrame, template: Template | None = None, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`conv_id`, `n_turns`, `formatted`, `segments` (text, loss), `valid`, `bad_turn`.

    The one shuffle gathers a conversation's turns; its output is one string, so a
    conversation is the smallest unit that can be split off.
    """
    t = template or Template()
    turns = (
        renamed(rows, [conv_id, turn, role, text])
        .toDF("conv_id", "turn", "role", "text")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    )
    moves = {f"{state}\n{who}": to for (state, who), to in t.moves.items()}

    def step(acc: Column, x: Column) -> Column:
        to = F.when(acc["state"].isNotNull(), _lookup(moves, F.concat(acc["state"], F.lit("\n"), x["role"]), F.lit(None).cast("string")))
        return F.struct(to.alias("state"), F.when(acc["state"].isNotNull() & to.isNotNull(), acc["good"] + 1).otherwise(acc["good"]).alias("good"))

    first = F.struct(F.lit(t.start).cast("string").alias("state"), F.lit(0).alias("good"))
    # the fold's types must not differ in nullability
    first = F.struct(F.nullif(first["state"], F.lit("\n")).alias("state"), first["good"].alias("good"))
    label = lambda r: _lookup(t.labels, r, F.concat(F.lit("?"), F.hex(r.cast("binary"))))
    parts = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(F.concat(F.lit(t.head), label(x["role"]), F.lit(t.after_label)).alias("text"), F.lit(False).alias("loss")),
                F.struct(escaped(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return (
        turns.withColumn("walk", F.aggregate("turns", first, step))
        .withColumn("segments", parts)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
            F.coalesce(F.col("walk.state").isin(*t.accept), F.lit(False)).alias("valid"),
            F.when(~F.coalesce(F.col("walk.state").isin(*t.accept), F.lit(False)), F.col("walk.good")).alias("bad_turn"),
        )
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text) from a formatted string alone."""
    t = template or Template()
    whole = F.split(formatted, _java(t.close).replace("\n", "\\n"), -1)
    roles = {label: role for role, label in t.labels.items()}

    def turn(x: Column) -> Column:
        cut = F.instr(x, t.after_label)
        label = F.substring(x, F.lit(len(t.head) + 1), cut - (len(t.head) + 1))
        other = F.decode(F.unhex(F.substring(label, F.lit(2), F.length(label))), "UTF-8")
        text = F.substring(x, cut + len(t.after_label), F.length(x))
        return F.struct(F.when(label.startswith("?"), other).otherwise(_lookup(roles, label, F.lit(""))).alias("role"), unescaped(text, t).alias("text"))

    return F.transform(F.slice(whole, F.lit(1), F.size(whole) - 1), turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, as it was before escaping."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
