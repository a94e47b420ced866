"""Chat formatting from an event log (operator 10).

A log has events (conv_id, message, seq, kind, role, text). Events of a message
are folded in the order of ``seq``:

* ``start`` opens the message with its role and no text;
* ``delta`` adds streamed text at its end;
* ``edit`` puts a new text in place of what there is;
* ``regenerate`` empties the message and drops all messages of higher number
  that came before it; they may start again.

Final messages are rendered in the order of their numbers, one row each, so
neither a long conversation nor its rendering is ever held whole: logs are
partitioned by conversation, sorted, and streamed with the state of one
message. A turn is ``<|turn|>role<|text|>text<|end|>`` and a line end. Inside
roles and texts backslashes are doubled, and a backslash splits every control
string of this and of other common templates; both are undone on reading.

Defined results: null texts and roles are empty; a null conversation id is one
conversation; events of equal ``seq`` are folded by kind, then text; events of
a message that has no ``start`` left are dropped; an event of unknown kind
fails the task; rows of :func:`events_of` with the same turn are turns of their
own, ordered by role and text; an empty table gives an empty table; other
columns are ignored, whatever their names; texts may have any length, and a
single message is held in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
KINDS = ("start", "regenerate", "edit", "delta")
MASKED_ROLE = "assistant"
#: Deltas of a message in a log made by :func:`events_of`, and events before the first of them.
DELTAS, MOST_BEFORE = 3, 5
#: Rendered characters of one output batch.
BATCH_CHARS = 4 << 20

#: Where a control string begins: of this template, and <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>> of others.
_CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(\\?)")
_RENDERED = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def events_of(conversations: DataFrame) -> DataFrame:
    """A log, as a chat service would have written it, whose fold is the given (conv_id, turn, role, text) rows again.

    Every text comes in up to DELTAS streamed deltas. By a hash of its text a
    message may also have begun with other words and been edited before the
    rest came, or have been streamed, answered, and regenerated, whereby the
    answer goes.
    """
    row = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select("conv_id", "turn", "role", "text").select("conv_id", row.alias("message"), "role", "text")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    none = F.lit(None).cast("string")

    def event(k, kind: str, role=none, text=none, ahead: int = 0):
        return F.struct(F.lit(k).alias("k") if isinstance(k, int) else k.alias("k"), (F.col("message") + ahead).alias("message"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    step = F.greatest(F.ceil(F.length("text") / DELTAS), F.lit(1)).cast("int")
    part = lambda i: F.substring(F.col("text"), i * step + 1, step)
    used = F.ceil(F.length("text") / step).cast("int")  # deltas that the text needs

    def deltas(first: int):
        """The text's parts from the given one on."""
        numbers = F.when(used > first, F.sequence(F.lit(first), F.greatest(used - 1, F.lit(first))))
        return F.coalesce(F.transform(numbers, lambda i: event(i + MOST_BEFORE, "delta", text=part(i))), F.array().cast(kind_of_log))

    kind_of_log = "array<struct<k:int,message:bigint,kind:string,role:string,text:string>>"
    start, wrong = event(0, "start", F.col("role")), F.concat(F.lit("draft: "), F.reverse("text"))
    edited = F.concat(F.array(start, event(1, "delta", text=wrong), event(2, "edit", text=part(F.lit(0)))), deltas(1))
    answered = F.array(start, event(1, "delta", text=wrong), event(2, "start", F.lit("user"), ahead=1), event(3, "delta", text=wrong, ahead=1), event(4, "regenerate"))
    streamed = F.concat(F.array(start), deltas(0))
    way = F.pmod(F.xxhash64("text", "message"), F.lit(4))
    log = F.when(way == 0, edited).when(way == 1, F.concat(answered, deltas(0))).otherwise(streamed)
    each = rows.select("conv_id", "message", F.explode(log).alias("e"))
    return each.select("conv_id", "e.message", ((MOST_BEFORE + DELTAS) * F.col("message") + F.col("e.k")).alias("seq"), F.col("e.kind"), F.col("e.role"), F.col("e.text"))


@dataclass
class _Message:
    """The fold's state: the message at hand, and how far regenerations of lower ones reach."""

    conv: object = None
    number: int | None = None
    reach: int | None = None
    own_reach: int | None = None
    role: str | None = None
    text: list[str] = field(default_factory=list)

    def add(self, seq: int, kind: str, role: str | None, text: str | None) -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of event: {kind!r}")
        if self.reach is not None and seq < self.reach:
            return
        if kind == "start":
            self.role, self.text = role or "", []
        elif kind == "delta":
            self.text.append(text or "")
        elif kind == "edit":
            self.text = [text or ""]
        else:
            self.text = []
            self.own_reach = seq if self.own_reach is None else max(self.own_reach, seq)


def _folder(schema: T.StructType, conv_type: pa.DataType | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = position = offset = 0
        m, first = _Message(), True

        def ended() -> None:
            nonlocal held, position, offset
            if m.role is None:
                return
            head = TURN + escape(m.role) + TEXT
            body = escape("".join(m.text))
            piece = head + body + END
            masked = m.role == MASKED_ROLE
            out.append((m.conv, position, m.role, piece, offset, offset + len(head) if masked else None, len(body) if masked else None))
            held, position, offset = held + len(piece), position + 1, offset + len(piece)

        def batch() -> pa.RecordBatch:
            nonlocal held
            cols = list(zip(*out, strict=True)) if out else [[] for _ in schema]
            kinds = [conv_type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=schema.names)
            out.clear()
            held = 0
            return made

        for b in batches:
            conv_type = b.schema.field(0).type
            for conv, number, seq, kind, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if first or conv != m.conv:
                    ended()
                    m, first, position, offset = _Message(conv, number), False, 0, 0
                elif number != m.number:
                    ended()
                    reach = max((r for r in (m.reach, m.own_reach) if r is not None), default=None)
                    m = _Message(conv, number, reach)
                m.add(seq, kind, role, text)
                if held > BATCH_CHARS:
                    yield batch()
        ended()
        if out:
            yield batch()

    return run


def fold(events: DataFrame, dealt: bool = False) -> DataFrame:
    """(conv_id, position, role, formatted, at, mask_start, mask_chars) of every final message, ordered within its conversation.

    ``at`` and the mask are in characters of the whole conversation's rendering;
    the mask is null where nothing is to be learned. ``dealt``: the log is
    already partitioned by conversation.
    """
    kinds = F.array(*[F.lit(k) for k in KINDS])
    log = events.select("conv_id", "message", "seq", "kind", "role", "text")
    log = log if dealt else log.repartition("conv_id")
    log = log.sortWithinPartitions("conv_id", "message", "seq", F.array_position(kinds, F.col("kind")), "text")
    conv = T.StructField("conv_id", events.schema["conv_id"].dataType)
    schema = T.StructType([conv, *T.StructType.fromDDL("position long, role string, formatted string, at long, mask_start long, mask_chars long")])
    return log.mapInArrow(_folder(schema, None), schema)


def _reader(schema: T.StructType):
    """Digests by conversation, from the formatted text and the mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type = None
        state = None

        def row() -> pa.RecordBatch:
            conv, turns, n, loss, loss_chars, chars = state
            cols = [conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]
            return pa.RecordBatch.from_arrays([pa.array([x], conv_type if i == 0 else None) for i, x in enumerate(cols)], names=schema.names)

        done: list[pa.RecordBatch] = []
        for b in batches:
            conv_type = b.schema.field(0).type
            for conv, piece, at, start, length in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if state is None or conv != state[0]:
                    if state is not None:
                        done.append(row())
                    state = [conv, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                turn = _RENDERED.fullmatch(piece)
                if not turn or at != state[5]:
                    raise ValueError(f"conversation {conv!r} is not rendered by the template")
                role, text = unescape(turn[1]), unescape(turn[2])
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += 1
                if start is not None:
                    learned = unescape(piece[start - at : start - at + length])
                    state[3].update(learned.encode())
                    state[4] += len(learned)
                state[5] += len(piece)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if state is not None:
            yield row()

    return run


def read_back(folded: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars); ``folded`` as :func:`fold` leaves it, rows in order."""
    schema = T.StructType([folded.schema["conv_id"], *T.StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")])
    return folded.select("conv_id", "formatted", "at", "mask_start", "mask_chars").mapInArrow(_reader(schema), schema)
