"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions.

A template names, for each role, the strings before and after a turn's text and
whether the text is under the loss, and the moves of a machine whose states are
names and whose input is the roles.  A conversation becomes segments (text,
loss): for each turn its opening, its text and its closing.  Joined, they are
the formatted conversation; every text is under the loss or not as a whole, and
no opening or closing is.  A role that the template doesn't name is written out
in its opening.

Control strings inside texts and roles are broken up by a backslash after their
first character, and a backslash is doubled, so that the formatted conversation
holds control strings only where the template put them and `read_back` gives
each role and text as it was.  `Template` refuses controls that could arise in
another way: their first characters occur nowhere else in them, none begins
another, and they hold no white space or backslash.

The machine judges the order of the turns: `valid` tells whether every move was
allowed and the last state accepts, `error_turn` the place (from 0) of the first
turn without a move, or the number of turns if only the end is not accepted.
Conversations of any order are formatted; the caller filters by `valid`.

A conversation is one row of the result and has to fit one: its turns are
gathered by its id and nothing else is, so that many turns of one conversation
make one long row, as the formatted text does anyway.

Nulls, ties and empties: turns go by `turn` (null first), then role, then text; a
null role or text is empty; rows of a null conv_id are one conversation of a null
id; rows that repeat are turns of their own.  An empty table gives no rows.
Columns of other names are not read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "error"


@dataclass(frozen=True)
class Turn:
    """What stands before and after a text, and whether the text is under the loss."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: Mapping[str, Turn]
    #: (state, role) to the next state
    moves: Mapping[tuple[str, str], str]
    start: str = "start"
    accepting: frozenset[str] = frozenset()
    #: for roles without an entry: open, role, said, text, close
    other: Turn = field(default_factory=lambda: Turn("[ROLE]", "[/ROLE]"))
    said: str = "[SAID]"

    def __post_init__(self) -> None:
        controls = self.controls()
        firsts = {c[:1] for c in controls}
        if len(set(controls)) < len(controls):
            raise ValueError("control strings must differ")
        for c in controls:
            if len(c) < 2 or re.search(r"[\s\\]", c) or any(x in firsts for x in c[1:]) or any(c != d and d.startswith(c) for d in controls):
                raise ValueError(f"control string {c!r} can't be told from text")

    def controls(self) -> list[str]:
        return [m.strip() for t in [*self.roles.values(), self.other] for m in (t.open, t.close)] + [self.said.strip()]

    def escaped(self, text: Column) -> Column:
        any_control = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls())
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({any_control})", r"$1\\")

    def turn_pattern(self) -> str:
        return "(?s)" + "|".join(f"{re.escape(t.open)}.*?{re.escape(t.close)}" for t in [*self.roles.values(), self.other])


INST = Template(
    roles={
        "system": Turn("[SYS]", "[/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    moves={
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    accepting=frozenset({"assistant"}),
)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(template: Template, turn: Column) -> Column:
    role, text = turn["role"], template.escaped(turn["text"])
    named = F.concat(F.lit(template.other.open), template.escaped(role), F.lit(template.said))
    opening, closing, loss = named, F.lit(template.other.close), F.lit(template.other.loss)
    for name, t in template.roles.items():
        own = role == name
        opening, closing, loss = F.when(own, t.open).otherwise(opening), F.when(own, t.close).otherwise(closing), F.when(own, t.loss).otherwise(loss)
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(part(opening, F.lit(False)), part(text, loss), part(closing, F.lit(False)))


def _judged(template: Template, turns: Column) -> Column:
    """struct(state, place, error): the machine's run; error is the first place without a move, or null."""
    moves = F.create_map(*(F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\0{role}", to)))
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("error"))

    def step(seen: Column, turn: Column) -> Column:
        state = F.coalesce(F.try_element_at(moves, F.concat(seen["state"], F.lit("\0"), turn["role"])), F.lit(ERROR))
        return F.struct(
            state.alias("state"),
            (seen["place"] + 1).alias("place"),
            F.coalesce(seen["error"], F.when(state == ERROR, seen["place"])).alias("error"),
        )

    return F.aggregate(turns, start, step)


def formatted_chats(
    turns: DataFrame, *, template: Template = INST, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, n_turns, segments array<struct<text, loss>>, formatted, valid, error_turn) of each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    own = turns.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("turn"))
    whole = own.groupBy("id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    run = whole.select("id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", lambda t: _segments(template, t))).alias("segments"), _judged(template, F.col("turns")).alias("run"))
    error = F.coalesce(F.col("run.error"), F.when(~F.col("run.state").isin(*template.accepting), F.col("run.place")))
    return run.select(
        F.col("id").alias(id_col),
        "n_turns",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        error.isNull().alias("valid"),
        error.alias("error_turn"),
    )


def read_back(formatted: Column, template: Template = INST) -> Column:
    """array<struct<role, text>> of a formatted conversation."""

    def turn(whole: Column) -> Column:
        inner = lambda t: F.substring(whole, F.lit(len(t.open) + 1), F.length(whole) - len(t.open) - len(t.close))
        named = F.split(inner(template.other), re.escape(template.said), 2)
        role, text = F.get(named, F.lit(0)), F.get(named, F.lit(1))
        for name, t in template.roles.items():
            own = whole.startswith(t.open)
            role, text = F.when(own, name).otherwise(role), F.when(own, inner(t)).otherwise(text)
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(template.turn_pattern()), F.lit(0)), turn)


def loss_text(segments: Column) -> Column:
    """The texts under the loss, as they were, one after the other."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
