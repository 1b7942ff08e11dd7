"""Chat formatting with a compiled template, and reading formatted conversations back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from corvid.llm.template import Template

#: Marks of the production template. Inside texts and roles they get a backslash, as backslashes do.
OPEN, CLOSE = "### ", "</turn>"
CHAT_TEMPLATE = (
    "{% for m in messages %}### {{ m.role | header }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | control }}{% endgeneration %}"
    "{% else %}{{ m.text | control }}{% endif %}</turn>\n{% endfor %}"
)
_ESCAPED = re.compile(r"\\(\\|###|</turn>|\n)")
_HEADER = re.compile(r"(?:[^\\\n]|\\.)*", re.S)
_END = re.compile(r"\\(?:\\|###|</turn>)|</turn>\n")


def escape(text: str | None) -> str:
    """The text with a backslash before each control string and backslash; unescape() is its inverse."""
    return re.sub(r"\\|###|</turn>", lambda m: "\\" + m[0], text or "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def compiled(source: str = CHAT_TEMPLATE) -> Template:
    return Template(source, {"control": escape, "header": lambda x: escape(x).replace("\n", "\\\n")})


class Reader:
    """Reads formatted text back turn by turn; holds one turn at a time."""

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn that ends in what has been fed so far."""
        self.rest += text
        while True:
            end = next((m for m in _END.finditer(self.rest) if m[0] == CLOSE + "\n"), None)
            if end is None:
                return
            turn, self.rest = self.rest[: end.start()], self.rest[end.end() :]
            if not turn.startswith(OPEN):
                raise ValueError(f"a turn doesn't begin with {OPEN!r}")
            role = _HEADER.match(turn, len(OPEN))[0]
            yield unescape(role), unescape(turn[len(OPEN) + len(role) + 1 :])


def formatted_digest(template: Template, messages) -> tuple[int, str, int, str, int]:
    """Render messages and read the output back: turns, their digest, loss characters, their digest, output characters."""
    reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
    n_turns = loss_chars = chars = 0
    out: list[str] = []
    marked = ""

    def settle() -> None:
        nonlocal marked, loss_chars
        if marked:
            plain = unescape(marked)
            loss.update(plain.encode())
            loss_chars += len(plain)
            marked = ""

    def read() -> None:
        nonlocal n_turns
        for role, text in reader.feed("".join(out)):
            turns.update(f"{role}\n{text}\n".encode())
            n_turns += 1
        out.clear()

    for piece, generated in template.render(messages=messages):
        out.append(piece)
        chars += len(piece)
        if generated:
            marked += piece
        else:
            settle()
            if piece.endswith(CLOSE + "\n") or CLOSE + "\n" in piece:
                read()
    settle()
    read()
    if reader.rest:
        raise ValueError("the output doesn't end with a turn")
    return n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def format_chats(chats: DataFrame, template: str = CHAT_TEMPLATE, with_text: bool = False) -> DataFrame:
    """Per conversation, what its formatted text holds when read back; with_text adds that text and its loss spans.

    `chats` has conv_id, turn, role and text; other columns are ignored. Rows go in the order of turn, then role
    and text, nulls first; repeated rows are turns of their own. Null texts and roles are empty, and line breaks in roles
    are escaped. Rows with a null conv_id are one conversation. An empty table gives an empty result.

    One shuffle by conversation; a partition is sorted (Spark spills) and streamed turn by turn, so that memory
    doesn't grow with a conversation's length. A digest over a conversation is serial by its nature: a
    conversation of many rows is one stream, never a collected group. with_text holds a conversation's whole text.
    """
    kind = chats.schema["conv_id"].dataType.simpleString()

    def run(batches):
        compiled_template = compiled(template)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        done: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, role, text in group)
            if with_text:
                messages = list(messages)
                text, spans = "", []
                for piece, generated in compiled_template.render(messages=messages):
                    if generated and piece:
                        spans.append({"start": len(text), "end": len(text) + len(piece)})
                    text += piece
                done.append((key, *formatted_digest(compiled_template, messages), text, spans))
            else:
                done.append((key, *formatted_digest(compiled_template, messages)))
            if len(done) >= 2000:
                yield packed(done)
                done = []
        if done:
            yield packed(done)

    fields = [("conv_id", None), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    if with_text:
        fields += [("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
        schema += ", formatted string, loss_spans array<struct<start: long, end: long>>"
    key_type = to_arrow_type(chats.schema["conv_id"].dataType)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t or key_type) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])

    ordered = chats.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)
