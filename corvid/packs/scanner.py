"""A tolerant reader of brace languages: comments blanked, calls with their arguments, blocks, annotations.

No grammar is available for these languages, so what is read is what can be read without one: positions stay those of the
file, strings are kept, and anything that isn't understood is left out rather than guessed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from corvid.functions.paths import DIALECTS, ROOTED, balanced_template

PAIRS = {"(": ")", "[": "]", "{": "}"}
_STRING = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`[^`]*`', re.S)
_CODE = re.compile(r'("(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])*\')|(//[^\n]*|/\*.*?\*/)', re.S)
_HASH = re.compile(r'("(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\')|((?://|#(?!\[))[^\n]*|/\*.*?\*/)', re.S)


def without_comments(text: str, hashes: bool = False) -> str:
    """The text with comments as blanks, so that positions stay."""
    return (_HASH if hashes else _CODE).sub(lambda m: m[1] if m[1] is not None else re.sub(r"[^\n]", " ", m[2]), text)


def line_at(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def closing(text: str, at: int) -> int:
    """Where the bracket at `at` closes; the text's end if it doesn't."""
    stack, i = [], at
    while i < len(text):
        c = text[i]
        if c in "\"'`":
            m = _STRING.match(text, i)
            i = m.end() if m else i + 1
            continue
        if c in PAIRS:
            stack.append(PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
            if not stack:
                return i
        i += 1
    return len(text)


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts between separators that stand in no bracket or string."""
    out, start, i = [], 0, 0
    while i < len(text):
        c = text[i]
        if c in "\"'`":
            m = _STRING.match(text, i)
            i = m.end() if m else i + 1
            continue
        if c in PAIRS:
            i = closing(text, i) + 1
            continue
        if c == separator:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    last = text[start:].strip()
    return out + [last] if last or out else []


def string(text: str | None) -> str | None:
    """The value of a string literal; None for anything else, template strings with holes included."""
    text = (text or "").strip()
    m = _STRING.fullmatch(text)
    if not m or (text[0] == "`" and "${" in text):
        return None
    return re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1] if x[1] in "\"'\\/" else "\\" + x[1]), text[1:-1])


@dataclass
class Call:
    receiver: str
    name: str
    args: list[str]
    at: int
    open: int
    end: int


_CALL = re.compile(r"(?:([A-Za-z_$][\w$]*(?:\(\))?(?:(?:\.|->|::)[A-Za-z_$][\w$]*(?:\(\))?)*)\s*(?:\.|->|::)\s*)?([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\s*\(")


def calls(text: str, start: int = 0, end: int | None = None) -> Iterator[Call]:
    """Calls in order of their names, with receiver (a chain of names, or "" after another call) and arguments."""
    end = len(text) if end is None else end
    at = start
    while m := _CALL.search(text, at, end):
        opened = m.end() - 1
        close = closing(text, opened)
        yield Call(m[1] or "", m[2], split_top(text[opened + 1 : close]), m.start(), opened, close)
        at = m.end()


def chained(text: str, at: int) -> tuple[Call, int] | None:
    """The call that is chained right after position `at`: .name(args)."""
    m = re.compile(r"\s*\.\s*([A-Za-z_]\w*)\s*(?:::<[^>]*>)?\(").match(text, at)
    if not m:
        return None
    close = closing(text, m.end() - 1)
    return Call("", m[1], split_top(text[m.end() : close]), at, m.end() - 1, close), close + 1


def template(raw: str, dialect: str) -> str:
    """A route path in a dialect as a path template: the same rules as the Column function."""
    if dialect == "slim":
        return balanced_template(raw)
    out = raw.strip() if dialect in ROOTED or dialect == "aspnet" else raw
    if dialect in ROOTED and not out.startswith("/"):
        out = "/" + out
    for pattern, replacement in DIALECTS[dialect]:
        out = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", replacement), out)
    return out or ("/" if dialect in ROOTED else "")


#: Statuses by the names that languages give them.
STATUSES = {
    "OK": 200, "Created": 201, "Accepted": 202, "NoContent": 204, "MovedPermanently": 301, "Found": 302, "NotModified": 304, "BadRequest": 400, "Unauthorized": 401, "PaymentRequired": 402,
    "Forbidden": 403, "NotFound": 404, "MethodNotAllowed": 405, "Conflict": 409, "Gone": 410, "UnprocessableEntity": 422, "TooManyRequests": 429, "InternalServerError": 500, "NotImplemented": 501,
    "BadGateway": 502, "ServiceUnavailable": 503,
}


def status(text: str | None) -> int | None:
    """A status from a number or a name such as http.StatusCreated, HttpStatus.NOT_FOUND, StatusCode::OK."""
    text = (text or "").strip()
    if re.fullmatch(r"\d{3}", text):
        return int(text)
    name = re.sub(r"^(?:HTTP_|Status)", "", re.split(r"\.|::", text)[-1])
    flat = re.sub(r"[^a-z]", "", name.lower())
    return next((v for k, v in STATUSES.items() if k.lower() == flat), None)


def object_schema(text: str, depth: int = 0, known: Callable[[str], dict | None] | None = None) -> dict | None:
    """The schema of a literal in JSON-like syntax (JavaScript objects, Go gin.H); `known` tells that of anything else in
    it, and None is said where it isn't known."""
    text = text.strip()
    if depth > 12:
        return None
    if string(text) is not None or text.startswith("`"):
        return {"type": "string"}
    if re.fullmatch(r"-?\d+", text):
        return {"type": "integer"}
    if re.fullmatch(r"-?\d*\.\d+", text):
        return {"type": "number"}
    if text in ("true", "false"):
        return {"type": "boolean"}
    if text in ("null", "nil", "None"):
        return {"type": "null"}
    if text.startswith("[") and closing(text, 0) == len(text) - 1:
        items = split_top(text[1:-1])
        return {"type": "array", "items": (object_schema(items[0], depth + 1, known) or {}) if items else {}}
    head = re.match(r"(?:gin\.H|echo\.Map|fiber\.Map|map\[string\](?:any|interface\{\}|string))?\s*(?=\{)", text)
    if head and closing(text, head.end()) == len(text) - 1:
        properties, partial = {}, False
        for entry in split_top(text[head.end() + 1 : -1]):
            if not entry:
                continue
            parts = split_top(entry, ":")
            key = string(parts[0]) or (parts[0] if re.fullmatch(r"[A-Za-z_$][\w$]*", parts[0]) else None)
            if key is None or entry.startswith("..."):
                partial = True
                continue
            properties[key] = object_schema(":".join(parts[1:]) if len(parts) > 1 else key, depth + 1, known) or {}
        out = {"type": "object", "properties": properties, "required": list(properties)}
        return {**out, "x-discovery-incomplete": ["spread"]} if partial else out
    return known(text) if known else None
