"""Chat formatting: a finite-state machine over roles and a declarative template.

The template says, per role, which strings open and close a turn and whether its
text is under the loss, and which role may follow which state. Conversations are
formatted in one sorted pass: rows are dealt by conversation, sorted by turn, and
streamed, so memory holds one turn at a time however long a conversation is.

Control strings inside a text or role are broken by the escape character after
their first character (the escape itself is doubled), so no text can imitate a
mark, and ``parse_turn`` gives back the exact text.

Defined results: null text and null role are empty strings; a role without an
entry gets the ``other`` marks, which carry its name; turns that the machine does
not expect are formatted like any other and flagged; rows with the same turn are
ordered by role, then text, nulls first; null conversation ids form one
conversation; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks per role, and the machine: state -> role -> next state."""

    roles: dict[str, Marks]
    other: tuple[str, str, str]  # before the role's name, between name and text, after the text
    moves: dict[str, dict[str, str]]
    start: str = "start"
    final: frozenset[str] = frozenset()
    escape: str = "\\"
    control: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [m for r in self.roles.values() for m in (r.open, r.close)] + list(self.other)
        control = tuple(sorted({m for m in marks if m}, key=lambda m: (-len(m), m)))
        object.__setattr__(self, "control", control)
        opens = [r.open for r in self.roles.values()] + [self.other[0]]
        for i, a in enumerate(opens):
            if not a or any(b.startswith(a) for j, b in enumerate(opens) if j != i):
                raise ValueError("the opening marks must tell the roles apart")
        if any(not m or len(m) < 2 or self.escape in m for m in marks):
            raise ValueError("marks need two characters or more and no escape character")
        for c in control:  # else the end of a text and a mark could read as another mark
            for n in range(1, len(c)):
                if any(b.startswith(c[n:]) or c[n:].startswith(b) for b in control):
                    raise ValueError(f"the end of {c!r} begins another mark")

    def escaped(self, text: str) -> str:
        def broken(found: re.Match) -> str:
            s = found[0]
            return self.escape * 2 if s == self.escape else s[0] + self.escape + s[1:]

        return self._special().sub(broken, text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def _special(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, (self.escape, *self.control))))

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, under the loss) of one turn; their concatenation is the turn."""
        if marks := self.roles.get(role):
            return [(marks.open, False), (self.escaped(text), marks.loss), (marks.close, False)]
        before, between, after = self.other
        head = before + self.escaped(role) + between
        return [(head, False), (self.escaped(text), False), (after, False)]

    def parse_turn(self, turn: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        for role, marks in self.roles.items():
            if turn.startswith(marks.open):
                return role, self.unescaped(turn[len(marks.open) : len(turn) - len(marks.close)])
        before, between, after = self.other
        role, _, text = turn[len(before) : len(turn) - len(after)].partition(between)
        return self.unescaped(role), self.unescaped(text)


#: System, user and assistant turns; the loss lies on what the assistant says.
DEFAULT = Template(
    roles={
        "system": Marks("<<SYS>>", "<</SYS>>"),
        "user": Marks("[INST]", "[/INST]"),
        "assistant": Marks("<s>", "</s>", loss=True),
    },
    other=("[ROLE]", "[/ROLE]", "[/TURN]"),
    moves={
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    final=frozenset({"answered"}),
)

TURNS = (
    "conv_id long, turn_no long, expected boolean, complete boolean, "
    "segments array<struct<text: string, loss: boolean>>"
)


def _arrow(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def format_conversations(
    conversations: DataFrame,
    template: Template = DEFAULT,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """A row per turn, in order within its conversation and partition.

    ``expected``: the machine allows this role here. ``complete``: on the last
    turn, whether all turns were expected and the machine may stop; else null.
    """
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    out = _arrow(TURNS, conversations.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row held back until it is known whether its conversation goes on
        state, sound, turn_no, begun, now = None, True, 0, False, None
        for batch in batches:
            done = []
            for conv, role, text in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True
            ):
                if not begun or conv != now:
                    if last:
                        last["complete"] = sound and state in template.final
                    now, begun, state, sound, turn_no = conv, True, template.start, True, 0
                if last:
                    done.append(last)
                after = template.moves.get(state, {}).get(role)
                sound = sound and after is not None
                last = {
                    "conv_id": conv,
                    "turn_no": turn_no,
                    "expected": after is not None,
                    "complete": None,
                    "segments": [
                        {"text": t, "loss": f} for t, f in template.segments(role, text)
                    ],
                }
                state, turn_no = after if after is not None else state, turn_no + 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=out)
        if last:
            last["complete"] = sound and state in template.final
            yield pa.RecordBatch.from_pylist([last], schema=out)

    return dealt.mapInArrow(run, TURNS)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, well_formed boolean"
)


def digest_conversations(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """A row per conversation, read back from formatted turns in their given order."""
    out = _arrow(DIGESTS, formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["turn_no"] == 0:
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turn = "".join(s["text"] for s in row["segments"])
                role, text = template.parse_turn(turn)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                for s in row["segments"]:
                    if s["loss"]:
                        said = template.unescaped(s["text"])
                        now[3] += len(said)
                        now[4].update(said.encode())
                now[5] += len(turn)
                if row["complete"] is not None:
                    done.append((*now, row["complete"]))
            if done:
                values = [[h.hexdigest() if hasattr(h, "hexdigest") else h for h in c] for c in zip(*done)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(values, out)], schema=out
                )

    return formatted.mapInArrow(run, DIGESTS)
