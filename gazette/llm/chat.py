"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's turns, in order, pass through the machine, which counts steps that
the table of transitions does not allow, and come out as segments of text, each with a
loss flag. Markers carry no loss; the texts of the roles named in the template do.
Control strings inside texts and roles are escaped by a backslash after their first
character, backslashes are doubled; unescape() takes this back exactly.

Rows are sorted within partitions by conversation and streamed: no conversation is held
in memory, however many turns it has. All turns of one conversation pass through
one task in order, since a digest of the whole is sequential; escaping, the larger
part of the work, is done before rows are brought together.

Defined cases. Null text or role: empty. Null conv_id: one conversation of its own.
Null turn: after all others. Ties on turn: by role, then text. Repeated rows: turns of their own.
Roles that the template does not name: formatted with their name, a violation for the machine.
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.staging import small_batches


@dataclass(frozen=True)
class Template:
    """begin opens a conversation; turns: role -> (opening marker, closing marker, loss on the text).

    A role that is not in turns is written as other[0], role, other[1], text, other[2].
    controls: what must not occur inside texts, each marker's own among it.
    """

    begin: str = "<s>"
    turns: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n\n", False),
            "user": ("[INST] ", " [/INST]", False),
            "assistant": ("<|answer|> ", " </s>", True),
        }
    )
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    controls: tuple[str, ...] = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<|answer|>", "<|role|>", "<|text|>", "<|end|>")
    #: The machine: state -> roles it may be left by, each leading to the state of that name; "" is the start.
    transitions: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    accepting: tuple[str, ...] = ("assistant",)

    def pattern(self) -> str:
        return "(?=(?:" + "|".join(re.escape(c) for c in self.controls) + "))(.)"


class Machine:
    """The state of one conversation; a role that is not allowed counts as a violation and still moves on."""

    def __init__(self, template: Template):
        self.table, self.state, self.violations = template.transitions, "", 0

    def step(self, role: str) -> bool:
        good = role in self.table.get(self.state, ())
        self.violations += not good
        self.state = role if role in self.table else self.state
        return good


def escaped(text: Column, template: Template) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, template.pattern(), r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


SEGMENTS = "conv_id long, n long, role string, allowed boolean, segments array<struct<text string, loss boolean>>"


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, n = object(), None, 0
        for b in batches:
            out: list[tuple] = []
            for conv, role, own, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "own", "text"))):
                if conv != now:
                    now, machine, n = conv, Machine(template), 0
                segments = [(template.begin, False)] if not n else []
                good = machine.step(role)
                if role in template.turns:
                    first, last, loss = template.turns[role]
                    segments += [(first, False), (text, loss), (last, False)]
                else:
                    a, z, last = template.other
                    segments += [(a + own + z, False), (text, False), (last, False)]
                out.append((conv, n, role, good, segments))
                n += 1
            if out:
                conv, k, role, good, segs = zip(*out)
                struct = pa.struct([("text", pa.string()), ("loss", pa.bool_())])
                segs = pa.array([[{"text": t, "loss": x} for t, x in s] for s in segs], pa.list_(struct))
                yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(k, pa.int64()), pa.array(role, pa.string()), pa.array(good, pa.bool_()), segs], ["conv_id", "n", "role", "allowed", "segments"])

    return run


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a turn: conv_id, n (from 0), role, allowed (by the machine), segments in order; sorted within partitions."""
    template = template or Template()
    small_batches(turns.sparkSession)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    ready = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), escaped(role, template).alias("own"), escaped(text, template).alias("text"))
    # Ties are in the order of the plain texts, which the sort makes of the escaped ones only where turns and roles are equal.
    plain = F.regexp_replace("text", r"(?s)\\(.)", "$1")
    ordered = ready.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", plain).drop("turn")
    return ordered.mapInArrow(_format(template), SEGMENTS)


class Reader:
    """Takes the segments of one conversation and reads its turns back from the formatted text alone."""

    def __init__(self, template: Template):
        self.template = template
        self.by_open = {t[0]: (role, t[1]) for role, t in template.turns.items()}
        self.turns, self.loss, self.n, self.chars, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.state, self.violations = Machine(template), 0

    def turn(self, segments: list[dict]) -> None:
        text = "".join(s["text"] for s in segments)
        self.chars += len(text)
        for s in segments:
            if s["loss"]:
                plain = unescape(s["text"])
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
        at = len(self.template.begin) if not self.n and text.startswith(self.template.begin) else 0
        first = next((o for o in self.by_open if text.startswith(o, at)), None)
        if first is not None:
            role, last = self.by_open[first]
            at += len(first)
        else:
            a, z, last = self.template.other
            end = text.index(z, at)
            role, at = unescape(text[at + len(a) : end]), end + len(z)
        if not text.endswith(last):
            raise ValueError(f"turn {self.n} is not closed")
        plain = unescape(text[at : len(text) - len(last)])
        self.turns.update(f"{role}\n{plain}\n".encode())
        self.state.step(role)
        self.n += 1

    def row(self, conv: int | None) -> tuple:
        valid = not self.state.violations and self.state.state in self.template.accepting
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid


def _read(template: Template):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, done = None, None, []
        for b in batches:
            for conv, segments in zip(b.column("conv_id").to_pylist(), b.column("segments").to_pylist()):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    now, reader = conv, Reader(template)
                reader.turn(segments)
            if len(done) >= 1000:
                yield batch(done)
                done = []
        if reader is not None:
            done.append(reader.row(now))
        if done:
            yield batch(done)

    return run


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, from the segments alone: counts and digests of turns and of the text under loss, and whether its turn order is valid.

    formatted must come from format_conversations() unshuffled, as each conversation is streamed in order.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    return formatted.mapInArrow(_read(template or Template()), schema)
