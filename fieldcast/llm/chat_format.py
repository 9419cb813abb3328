"""Chat formatting: a finite-state machine over roles, a declarative template, per-segment loss flags.

``format_turns`` emits each turn's text segments; ``read_back`` parses formatted text into turns again. Rows of a
conversation are streamed in order, so memory doesn't grow with its length; a hot conversation is one sorted run.

Defined cases: null text is empty; null role is the empty role; unknown roles use the generic mark and make the
conversation invalid; rows with null conv_id form one conversation; tied turns are ordered by role, then text;
repeated rows are all kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import lean


@dataclass(frozen=True)
class Template:
    """Marks before and after a turn's text by role, which roles carry loss, and which role may follow which."""

    marks: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
    loss: frozenset = frozenset({"assistant"})
    follows: dict = field(default_factory=lambda: {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    last: frozenset = frozenset({"assistant"})

    @property
    def controls(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)

    def escape(self, text: str) -> str:
        """Double backslashes, then put one inside each control string."""
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        for c in self.controls:
            if c in text:
                text = text.replace(c, c[0] + "\\" + c[1:])
        return text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role in self.marks:
            a, b = self.marks[role]
            return [(a, False), (self.escape(text), role in self.loss), (b, False)]
        a, m, b = self.other
        return [(a + self.escape(role) + m, False), (self.escape(text), False), (b, False)]


class Reader:
    """Parses formatted text, fed in any cuts, into (role, text) turns."""

    def __init__(self, template: Template):
        self.t, self.rest = template, ""
        self.open = {a: (role, b) for role, (a, b) in template.marks.items()}

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        while self.rest:
            mark = next((m for m in [*self.open, self.t.other[0]] if self.rest.startswith(m)), None)
            if mark is None:
                if any(m.startswith(self.rest) for m in [*self.open, self.t.other[0]]):
                    return
                raise ValueError("no turn starts here")
            role, close = self.open.get(mark, (None, self.t.other[2]))
            at = self.rest.find(close, len(mark))
            if at < 0:
                return
            body = self.rest[len(mark) : at]
            self.rest = self.rest[at + len(close) :]
            if role is None:
                name, _, body = body.partition(self.t.other[1])
                yield self.t.unescape(name), self.t.unescape(body)
            else:
                yield role, self.t.unescape(body)


_SEGMENTS = "conv_id {key}, turn {turn}, position long, segments array<struct<text:string,loss:boolean>>, in_order boolean"


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Per turn: its place in the conversation, its (text, loss) segments, and whether its role may stand there.

    The result stays partitioned by conv_id and sorted within partitions.
    """
    template = template or Template()
    d = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    types = dict(d.dtypes)
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, position = object(), None, 0
        for b in batches:
            convs, roles, texts = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text"))
            at, segs, ok = [], [], []
            for c, r, x in zip(convs, roles, texts):
                if c != conv:
                    conv, state, position = c, None, 0
                ok.append(r in template.follows.get(state, ()))
                segs.append([{"text": s, "loss": loss} for s, loss in template.segments(r, x)])
                at.append(position)
                state, position = r, position + 1
            kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int64()), pa.array(segs, kind), pa.array(ok, pa.bool_())], names=["conv_id", "turn", "position", "segments", "in_order"])

    return lean(d, run, _SEGMENTS.format(key=types["conv_id"], turn=types["turn"]))


def conversation_digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation of ``format_turns``' result: turns read back from the text, what its loss flags cover, FSM validity."""
    template = template or Template()
    kind = formatted.schema["conv_id"].dataType
    key = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, s = object(), None
        schema = pa.schema([("conv_id", key), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("first_bad_turn", pa.int64())])

        def done() -> list:
            if s["reader"].rest:
                raise ValueError("a conversation ends inside a turn")
            return [conv, s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"], s["bad"] is None and s["role"] in template.last, s["bad"]]

        for b in batches:
            rows = []
            for x in b.to_pylist():
                if x["conv_id"] != conv or s is None:
                    if s is not None:
                        rows.append(done())
                    conv = x["conv_id"]
                    s = {"reader": Reader(template), "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0, "bad": None, "role": None}
                if not x["in_order"] and s["bad"] is None:
                    s["bad"] = x["position"]
                for seg in x["segments"]:
                    s["chars"] += len(seg["text"])
                    if seg["loss"]:  # the mask is of segments, whatever their role
                        text = template.unescape(seg["text"])
                        s["loss"].update(text.encode())
                        s["loss_n"] += len(text)
                    for role, text in s["reader"].feed(seg["text"]):
                        s["n"] += 1
                        s["role"] = role
                        s["turns"].update(f"{role}\n{text}\n".encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(done(), schema)], schema=schema)

    return lean(formatted, run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_bad_turn long")
