"""Chat formatting with a template that is only ever called, never looked into.

A conversation's turns are rendered as successive prefixes. Where each output starts with the one before it, the new part
is the new turn's span; a mark put in place of the turn's text shows where in the span the text stands. Where an output
does not start with the one before, the template rewrites history; spans then are those that the final rendering shows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
MARK = ""


def escape(text: str) -> str:
    r"""No control string survives: `\` becomes `\\` and `<|` becomes `<\|`."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def chatml(turns: list[Turn]) -> str:
    r"""Each turn as start mark, role, newline, text, end mark, newline; newlines in a role become `\n`."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


@dataclass
class Span:
    """Of one turn in the final output: the whole turn and its text, as code point offsets."""

    start: int
    end: int
    text_start: int
    text_end: int


@dataclass
class Rendered:
    output: str
    spans: list[Span]
    rewrites: bool


def render(turns: list[Turn], template: Template = chatml) -> Rendered:
    before, spans, rewrites = template([]), [], False
    lead = before
    mark = MARK
    while any(mark in x for turn in turns for x in turn):  # one that no turn holds
        mark += MARK
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        marked = template([*turns[:k], (role, mark)])
        if not now.startswith(before):
            rewrites = True
        shared = len(before) if now.startswith(before) else next((i for i, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))
        at = marked.find(mark, shared)
        tail = len(marked) - at - len(mark)
        spans.append(Span(shared, len(now), at, len(now) - tail) if at >= 0 else Span(shared, len(now), len(now), len(now)))
        before = now
    if rewrites:  # each turn's text by a mark in the full conversation
        spans = []
        for k, (role, _) in enumerate(turns):
            marked = template([*turns[:k], (role, mark), *turns[k + 1 :]])
            at = marked.find(mark)
            end = len(before) - (len(marked) - at - len(mark))
            spans.append(Span(at, end, at, end) if at >= 0 else Span(len(before), len(before), len(before), len(before)))
    return Rendered(before if turns else lead, spans, rewrites)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_back(output: str) -> list[Turn]:
    """The turns from the output of chatml()."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(output)]


FORMATTED = "conv_id {kind}, output string, roles array<string>, text_starts array<int>, text_ends array<int>, rewrites boolean"


def format_conversations(turns: DataFrame, template: Template = chatml) -> DataFrame:
    """One row for each conversation: conv_id, the whole `output`, and for each turn its role and where its text stands
    (code points), and whether the template `rewrites` what it has rendered before.

    Turns stand by turn, then role, then text; null turns first, null roles and texts count as empty, repeated rows are
    turns of their own, rows with a null conv_id form one conversation. Other columns take no part. Turns are dealt and
    sorted by conversation and stream through; a task holds one conversation at a time."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = lambda key: pa.schema([("conv_id", key), ("output", pa.string()), ("roles", pa.list_(pa.string())), ("text_starts", pa.list_(pa.int32())), ("text_ends", pa.list_(pa.int32())), ("rewrites", pa.bool_())])

        def done(conv, got: list[Turn]) -> tuple:
            r = render(got, template)
            return conv, r.output, [role for role, _ in got], [s.text_start for s in r.spans], [s.text_end for s in r.spans], r.rewrites

        def out(found: list[tuple]) -> pa.RecordBatch:
            fields = schema(key)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), fields, strict=True)], schema=fields)

        conv, got, found, key = None, [], [], None
        for b in batches:
            key = b.schema.field(0).type
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if got and c != conv:
                    found.append(done(conv, got))
                    got = []
                    if len(found) >= 500:
                        yield out(found)
                        found = []
                conv = c
                got.append((role, text))
        if got:
            found.append(done(conv, got))
        if found:
            yield out(found)

    return rows.mapInArrow(run, FORMATTED.format(kind=kind))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output: turns by
    its marks, the loss mask (assistants' texts) by the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, output, roles, starts, ends, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                turns = read_back(output)
                loss = "".join(unescape(output[s:e]) for role, s, e in zip(roles, starts, ends, strict=True) if role == "assistant")
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(output)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
