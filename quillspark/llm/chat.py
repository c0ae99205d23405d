r"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, then the reply, and only the reply's
text is trainable. A conversation that does not end with an assistant turn gives a last example without a target, so that
every turn can be read back from the output.

The template: ``<<SYS>> text <</SYS>>`` for system, ``<s>[INST] text [/INST]`` for user, `` text </s>`` for assistant
turns and ``<|role|> text <|turn|>`` for any other role (percent-encoded). A control string inside a text gets a backslash
after its first character, as does a backslash, so no text can hold a control string, and undoing it is exact.

Turns are ordered by turn (null last), then role and text. A task streams its conversations one after another and holds
the formatted text of one. Defined results: null texts and roles are empty; rows with a null conv_id are one conversation;
repeated rows are turns of their own, and equal ones are interchangeable; texts of any length are formatted whole; an empty
table gives an empty result; other columns are not read. By its nature the output grows with the square of a conversation's
turns, as each example holds all turns before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = re.compile(r"\\|</?s>|<</?SYS>>|<\||\[/?INST\]")
ESCAPED = re.compile(r"([\\<\[])\\")
#: Role -> what stands before and after its text.
TEMPLATE = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
OTHER_END = " <|turn|>"
EXAMPLES = "conv_id long, example int, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def marks(role: str) -> tuple[str, str]:
    return TEMPLATE.get(role) or (f"<|{quote(role, safe='')}|> ", OTHER_END)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    at = 0
    while at < len(formatted):
        for role, (opens, closes) in TEMPLATE.items():
            if formatted.startswith(opens, at):
                break
        else:
            end = formatted.index("|> ", at)
            role, opens, closes = unquote(formatted[at + 2 : end]), formatted[at : end + 3], OTHER_END
        end = formatted.index(closes, at + len(opens))
        yield role, unescape(formatted[at + len(opens) : end])
        at = end + len(closes)


def expand(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> EXAMPLES; the text from loss_start to loss_end (code points) is trainable."""

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, text, number, pending, size = False, None, "", 0, False, 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], [f.split()[0] for f in EXAMPLES.split(", ")])

        for rows in batches:
            for c, role, said in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
                if started and c != conv:
                    if pending:
                        out.append((conv, number, text, 0, 0))
                        size += len(text)
                    text, number, pending = "", 0, False
                started, conv = True, c
                opens, closes = marks(role)
                inner = escape(said)
                text += opens
                a = len(text)
                text += inner + closes
                if role == "assistant":
                    out.append((conv, number, text, a, a + len(inner)))
                    size += len(text)
                    number += 1
                pending = role != "assistant"
                if size > 4 << 20:
                    yield batch()
                    out, size = [], 0
        if started and pending:
            out.append((conv, number, text, 0, 0))
        if out:
            yield batch()

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(formatted, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of what the examples hold. examples: as :func:`expand` gives them, a conversation's in a row."""
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        out: list[tuple] = []

        def close() -> None:
            conv, latest, loss, chars, total, examples = state
            turns = list(parse(latest))
            told = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
            out.append((conv, len(turns), told, chars, loss.hexdigest(), total, examples))

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], [f.split()[0] for f in names.split(", ")])

        for rows in batches:
            for conv, text, a, b in zip(rows.column(0).to_pylist(), rows.column(2), rows.column(3).to_pylist(), rows.column(4).to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, "", hashlib.sha256(), 0, 0, 0]
                text = text.as_py()
                trained = unescape(text[a:b])
                state[1] = text
                state[2].update(trained.encode())
                state[3] += len(trained)
                state[4] += len(text)
                state[5] += 1
            if len(out) > 5000:
                yield batch()
                out = []
        if state is not None:
            close()
        if out:
            yield batch()

    return examples.mapInArrow(digest, names)
