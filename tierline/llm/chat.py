"""Chat formatting: a finite-state machine over roles and a declared template.

A conversation's turns, in order, drive a state machine whose transitions the
template declares; the first turn without a transition is reported.  Every turn
becomes three segments (opening marker, text, closing marker) and the template
says which roles' texts carry the loss.  The formatted conversation is the
concatenation of its segments.

Texts may contain the template's control strings.  They are quoted the way mail
quotes "From": a backslash goes in after the first character, one more where
backslashes stand there already.  So no control string is left inside a text, and
taking one backslash away restores it exactly.

Contract for unusual input: a null text counts as empty and a null role as the
role ''; unknown roles get the template's generic marker; turns order by turn
number (null first), equal numbers by role and text, and repeated rows are
repeated turns; conversations that break the turn order are formatted like the
others and flagged; an empty table gives an empty result; columns other than the
four are ignored.  A null conv_id is a conversation of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How a role is marked, and whether its text carries the loss."""

    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers per role, the generic marker and the turn order."""

    turns: dict[str, Turn]
    #: opening = before the role's name, between name and text, closing
    generic: tuple[str, str, str]
    #: state -> role -> next state; a state machine over roles
    transitions: dict[str, dict[str, str]]
    start: str = "start"
    #: states a conversation may end in
    final: frozenset[str] = field(default_factory=frozenset)

    def control_strings(self) -> list[str]:
        marks = {m for t in self.turns.values() for m in (t.opening, t.closing)} | set(self.generic)
        return sorted(marks, key=lambda m: (-len(m), m))


DEFAULT = Template(
    turns={
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    generic=("[ROLE]", "[TEXT]", "[/TEXT]"),
    transitions={
        "start": {"system": "asked_next", "user": "answered_next"},
        "asked_next": {"user": "answered_next"},
        "answered_next": {"assistant": "answered"},
        "answered": {"user": "answered_next"},
    },
    final=frozenset({"answered"}),
)


def quoting(template: Template) -> tuple[re.Pattern, re.Pattern]:
    """(pattern to quote, pattern to unquote): a control string with any
    number of backslashes after its first character."""
    some = "|".join(f"(?<={re.escape(m[0])})(?=\\\\*{re.escape(m[1:])})" for m in template.control_strings())
    back = "|".join(f"(?<={re.escape(m[0])})\\\\(?=\\\\*{re.escape(m[1:])})" for m in template.control_strings())
    return re.compile(some), re.compile(back)


class Formatter:
    """Formats turns and reads formatted conversations back."""

    def __init__(self, template: Template = DEFAULT):
        self.template = template
        self.quote_at, self.unquote_at = quoting(template)
        self.marks = re.compile("|".join(map(re.escape, template.control_strings())))
        self.role_of = {t.opening: r for r, t in template.turns.items()}

    def quote(self, text: str) -> str:
        return self.quote_at.sub(lambda _: "\\", text)

    def unquote(self, text: str) -> str:
        return self.unquote_at.sub("", text)

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        """(text, loss) pieces whose concatenation is the formatted conversation."""
        out = []
        for role, text in turns:
            turn = self.template.turns.get(role)
            if turn:
                out += [(turn.opening, False), (self.quote(text), turn.loss), (turn.closing, False)]
            else:
                name, middle, closing = self.template.generic
                out += [(name, False), (self.quote(role), False), (middle, False), (self.quote(text), False), (closing, False)]
        return out

    def check(self, roles: list[str]) -> tuple[int | None, bool]:
        """(index of the first turn out of order, whether the last state is final)."""
        state = self.template.start
        for i, role in enumerate(roles):
            following = self.template.transitions.get(state, {}).get(role)
            if following is None:
                return i, False
            state = following
        return None, state in self.template.final

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns of a formatted conversation."""
        turns, at, role = [], 0, None
        for mark in self.marks.finditer(formatted):
            inner = formatted[at : mark.start()]
            if mark.group() in self.role_of:
                role = self.role_of[mark.group()]
            elif mark.group() == self.template.generic[1]:
                role = self.unquote(inner)
            elif mark.group() != self.template.generic[0]:
                turns.append((role, self.unquote(inner)))
            at = mark.end()
        return turns


def format_conversations(
    conversations: DataFrame,
    template: Template = DEFAULT,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: id, formatted, segments (text, loss), n_turns,
    bad_turn (index of the first turn out of order, null if none), complete
    (the last state is final)."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    # a formatted conversation is one value, so its turns meet in one row by nature
    gathered = conversations.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    gathered = gathered.select("id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(template)
        for batch in batches:
            formatted, texts, losses, counts, bad, complete = [], [], [], [], [], []
            for roles, said in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist()):
                parts = formatter.segments(list(zip(roles, said)))
                formatted.append("".join(t for t, _ in parts))
                texts.append([t for t, _ in parts])
                losses.append([x for _, x in parts])
                counts.append(len(roles))
                first_bad, final = formatter.check(roles)
                bad.append(first_bad)
                complete.append(final)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(formatted, pa.string()), pa.array(texts, pa.list_(pa.string())), pa.array(losses, pa.list_(pa.bool_())),
                 pa.array(counts, pa.int64()), pa.array(bad, pa.int32()), pa.array(complete, pa.bool_())],
                ["id", "formatted", "segments", "loss", "n_turns", "bad_turn", "complete"],
            )

    kind = gathered.schema["id"].dataType.simpleString()
    return gathered.mapInArrow(
        run, f"id {kind}, formatted string, segments array<string>, loss array<boolean>, n_turns long, bad_turn int, complete boolean"
    ).withColumnRenamed("id", id_col)


def read_back(formatted: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id") -> DataFrame:
    """What the formatted conversations say: id, n_turns, turns_text (role,
    newline, text, newline per turn), loss_text (the texts under the loss flags,
    unquoted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = Formatter(template)
        for batch in batches:
            counts, turns_text, loss_text = [], [], []
            for said, parts, loss in zip(*(batch.column(c).to_pylist() for c in ("formatted", "segments", "loss"))):
                turns = formatter.read(said)
                counts.append(len(turns))
                turns_text.append("".join(f"{role}\n{text}\n" for role, text in turns))
                loss_text.append("".join(formatter.unquote(t) for t, on in zip(parts, loss) if on))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(counts, pa.int64()), pa.array(turns_text, pa.string()), pa.array(loss_text, pa.string()), batch.column("bad_turn"), batch.column("formatted_chars")],
                ["id", "n_turns", "turns_text", "loss_text", "bad_turn", "formatted_chars"],
            )

    rows = formatted.select(F.col(id_col).alias("id"), "formatted", "segments", "loss", "bad_turn", F.length("formatted").cast("long").alias("formatted_chars"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, n_turns long, turns_text string, loss_text string, bad_turn int, formatted_chars long"
    ).withColumnRenamed("id", id_col)
