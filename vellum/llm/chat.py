"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its text alone under the
loss mask. Turns after the last assistant turn, or all turns of a conversation without one, end in a row without a target, so
that the output holds every turn. A turn is written

    <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>

and control strings inside roles and texts, these and those of ``CONTROL``, get a backslash after their first character,
one more where backslashes stand there already; so escaping is undone exactly.

Rows are sorted within partitions by conversation and turn and streamed, so that no conversation is ever gathered; of
a conversation only the turns so far are held, which every example repeats. So the output grows with the square of a conversation's
turns, as the method has it, and with the number of conversations; no context is cut at any length.

Defined results: a null text is empty, a null role an empty role; rows of one turn number are taken in order of role and text,
null turns first; rows with a null conv_id are one conversation; repeated rows are repeated turns; very long texts are whole turns like any other;
extra columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import in_runs

#: Control strings of common chat templates, besides those that begin with "<|".
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BEGIN, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

_REST = "|".join([r"\|", *(re.escape(c[1:]) for c in CONTROL)])
_PLAIN = re.compile(rf"([<\[])(\\*)({_REST})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_REST})")
_TURN = re.compile(re.escape(BEGIN) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.S)

EXAMPLES = "conv_id long, example int, target int, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text starts and ends in it."""
    head, body = f"{BEGIN}{escape(role)}{SEP}", escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(text)]


def _conversation_rows(batches):
    """(conv_id, role, text) in order, with None for the end of each conversation."""
    last = begun = None
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if begun and conv != last:
                yield None
            last, begun = conv, True
            yield conv, role or "", text or ""
    if begun:
        yield None


def expand(rows):
    """Example rows of a stream as ``_conversation_rows`` gives."""
    conv, turns, size, number, pending = None, [], 0, 0, False
    for row in rows:
        if row is None:
            if pending:
                yield conv, number + 1, None, "".join(turns), None, None
            turns, size, number, pending = [], 0, 0, False
            continue
        conv, role, text = row
        piece, a, b = render(role, text)
        turns.append(piece)
        pending = role != "assistant"
        if not pending:
            number += 1
            yield conv, number, len(turns) - 1, "".join(turns), size + a, size + b
        size += len(piece)


def _record_batches(rows, schema: pa.Schema, most: int = 1 << 22):
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, str))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def format_examples(conversations: DataFrame) -> DataFrame:
    """Examples of ``conversations`` (conv_id, turn, role, text), see ``EXAMPLES``; in order within partitions.

    ``text`` holds all turns up to the target. ``target`` is the place of the trainable turn in its conversation, from 0, null in a row without;
    ``loss_start`` and ``loss_end`` are code points of ``text``.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("target", pa.int32()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches):
        yield from _record_batches(expand(_conversation_rows(batches)), schema)

    rows = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    return in_runs(rows, ["conv_id"], "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, EXAMPLES)


def digest(rows):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of examples (conv_id, example, text, loss_start, loss_end) in order."""

    def close():
        n, h = 0, hashlib.sha256()
        for role, body in parse(last):  # the last example holds all turns
            h.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            n += 1
        return conv, n, h.hexdigest(), loss_n, loss_h.hexdigest(), chars

    begun = False
    for row_conv, example, text, lo, hi in rows:
        if begun and example == 1:
            yield close()
            begun = False
        if not begun:
            begun, conv, loss_n, loss_h, chars = True, row_conv, 0, hashlib.sha256(), 0
        last = text
        chars += len(text)
        if lo is not None:
            trained = unescape(text[lo:hi])
            loss_n += len(trained)
            loss_h.update(trained.encode("utf-8", "surrogatepass"))
    if begun:
        yield close()


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation from its examples alone. ``examples`` must be in order within partitions, as ``format_examples`` gives them."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "example", "text", "loss_start", "loss_end")), strict=True))
        yield from _record_batches(digest(rows), schema)

    return examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
