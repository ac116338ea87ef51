"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Template:
    """How turns look. A turn is: open, the role's title, close, the escaped text, end.

    A role without a title is written in brackets. In texts and bracketed roles the escape character precedes each
    control string and itself, so that reading back is exact.
    """

    titles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    open: str = "### "
    close: str = ": "
    end: str = "</turn>"
    gap: str = "\n"
    escape: str = "\\"
    loss: frozenset[str] = frozenset({"assistant"})
    #: Which roles may follow which; "" is the start of a conversation.
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})}
    )

    def controls(self, more: str = "") -> re.Pattern:
        return re.compile("|".join(re.escape(x) for x in (self.escape, self.open.strip(), self.end, *more)))

    def escaped(self, text: str, more: str = "") -> str:
        return self.controls(more).sub(lambda m: self.escape + m[0], text)

    def unescaped(self, text: str, more: str = "") -> str:
        return re.sub(re.escape(self.escape) + f"({self.controls(more).pattern})", lambda m: m[1], text)

    def head(self, role: str) -> str:
        return self.open + (self.titles[role] if role in self.titles else f"[{self.escaped(role, ']')}]") + self.close


class Machine:
    """Walks over a conversation's roles: whether each turn may stand where it stands."""

    def __init__(self, template: Template):
        self.t, self.state, self.valid, self.n = template, "", True, 0

    def step(self, role: str) -> bool:
        ok = role in self.t.follows.get(self.state, ())
        self.valid &= ok
        self.state, self.n = role, self.n + 1
        return ok


def segments(template: Template, role: str, text: str) -> list[tuple[str, bool]]:
    """A turn as text segments with their loss flags: only the text of a trained role bears loss."""
    return [(template.head(role), False), (template.escaped(text), role in template.loss), (template.end + template.gap, False)]


class Reader:
    """Reads turns back from formatted segments alone, one turn in memory at a time."""

    def __init__(self, template: Template):
        self.t, self.buffer, self.mask = template, [], []
        self.turns = hashlib.sha256()
        self.lossy = hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        e = re.escape
        controls = template.controls().pattern
        self.stop = re.compile(f"{e(template.escape)}(?:{controls})|({e(template.end)})", re.S)
        self.bracket = re.compile(rf"((?:{e(template.escape)}(?:{template.controls(']').pattern})|[^\]])*?)\]{e(template.close)}", re.S)
        self.roles = {v: k for k, v in template.titles.items()}

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        self.buffer.append(text)
        self.mask.append((len(text), loss))
        if text.endswith(self.t.end + self.t.gap):
            self._turn()

    def _turn(self) -> None:
        t, whole = self.t, "".join(self.buffer)
        if not whole.startswith(t.open):
            raise ValueError("a turn doesn't begin with its mark")
        at = len(t.open)
        if whole[at] == "[":
            m = self.bracket.match(whole, at + 1)
            role, at = t.unescaped(m[1], "]"), m.end()
        else:
            k = whole.index(t.close, at)
            role, at = self.roles[whole[at:k]], k + len(t.close)
        end = next((m.start() for m in self.stop.finditer(whole, at) if m[1]), None)
        if end is None or end + len(t.end + t.gap) != len(whole):
            return  # the mark stood escaped within a text: the turn goes on
        self.turns.update(f"{role}\n{t.unescaped(whole[at:end])}\n".encode("utf-8", "surrogatepass"))
        self.n_turns += 1
        start = 0
        for n, loss in self.mask:
            if loss:
                own = t.unescaped(whole[start : start + n])
                self.loss_chars += len(own)
                self.lossy.update(own.encode("utf-8", "surrogatepass"))
            start += n
        self.buffer, self.mask = [], []


SEGMENTS = "conv_id bigint, segment bigint, text string, loss boolean, in_order boolean"


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """Format conversations: a row per text segment (conv_id, segment, text, loss, in_order), in order within partitions.

    Turns are ordered by turn (nulls first), then role and text, so ties have one order. A null role counts as "",
    a null text as empty; rows with a null conv_id form one conversation. in_order says whether the machine accepts
    the turn where it stands; turns out of order are formatted all the same. Other columns are ignored. One shuffle by
    conv_id and a sort that can spill; a task streams its rows, so a conversation of any length needs the memory of
    one turn.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, machine, at, fresh = None, None, 0, True
        for b in batches:
            out: list[tuple] = []
            for c, role, text in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if fresh or c != conv:
                    conv, machine, at, fresh = c, Machine(template), 0, False
                ok = machine.step(role or "")
                for s, loss in segments(template, role or "", text or ""):
                    out.append((c, at, s, loss, ok))
                    at += 1
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=["conv_id", "segment", "text", "loss", "in_order"])

    own = rows.selectExpr("cast(conv_id AS bigint) AS conv_id", "turn", "role", "text")
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def chat_digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Read conversations back from format_chats' segments: a row of counts and digests per conversation.

    Reads partitions in the order in which format_chats wrote them, without a further shuffle.
    """
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid_order"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader, valid = None, None, True
        done: list[tuple] = []

        def row() -> tuple:
            return conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.lossy.hexdigest(), reader.chars, valid

        def batch() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
            return out

        for b in batches:
            for c, s, text, loss, ok in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if s == 0:
                    if reader is not None:
                        done.append(row())
                    conv, reader, valid = c, Reader(template), True
                reader.feed(text, loss)
                valid &= ok
            if done:
                yield batch()
        if reader is not None:
            done.append(row())
            yield batch()

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid_order boolean")
