"""A small sandboxed template language: parsed to a tree, constants folded, compiled to Python closures.

Statements: ``{% for x in xs %}``, ``{% if %}``/``{% elif %}``/``{% else %}``, ``{% generation %}`` (its output
is marked) and their ends; ``{{ expression }}`` writes a value. Expressions: strings, integers, true/false/none,
names, ``x.key`` (keys of mappings only: no Python attribute can be reached), ``| filter``, ``==``, ``!=``,
``~`` (concatenation), ``and``, ``or``, ``not``, parentheses. Names are those the caller passes; ``loop.first`` and
``loop.index`` hold inside a loop.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass


class TemplateError(ValueError):
    """The template is not well formed, or names something unknown."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: object
    key: str


@dataclass(frozen=True)
class Apply:
    filter: str
    to: object


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Mark:
    body: tuple


_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKENS = re.compile(r"""\s*(?:("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|().]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "~": lambda a, b: f"{a}{b}",
    "not": lambda a: not a,
}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastindex, m.group(m.lastindex)))
            at = m.end()
        self.tokens.append((0, ""))

    def next(self, *wanted: str) -> str | None:
        if self.tokens[0][0] in (3, 4) and self.tokens[0][1] in wanted:
            return self.tokens.pop(0)[1]
        return None

    def whole(self):
        out = self.either()
        if self.tokens[0][0]:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.next("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self):
        out = self.negated()
        while self.next("and"):
            out = Op("and", (out, self.negated()))
        return out

    def negated(self):
        return Op("not", (self.negated(),)) if self.next("not") else self.compared()

    def compared(self):
        out = self.joined()
        while op := self.next("==", "!="):
            out = Op(op, (out, self.joined()))
        return out

    def joined(self):
        out = self.filtered()
        while self.next("~"):
            out = Op("~", (out, self.filtered()))
        return out

    def filtered(self):
        out = self.atom()
        while op := self.next(".", "|"):
            kind, name = self.tokens.pop(0)
            if kind != 3:
                raise TemplateError(f"a name must follow {op!r}")
            out = Key(out, name) if op == "." else Apply(name, out)
        return out

    def atom(self):
        if self.next("("):
            out = self.either()
            if not self.next(")"):
                raise TemplateError("a parenthesis isn't closed")
            return out
        kind, text = self.tokens.pop(0)
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == 2:
            return Const(int(text))
        if kind == 3:
            known = {"true": True, "false": False, "none": None}
            return Const(known[text]) if text in known else Name(text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts = [p for p in _PARTS.split(source) if p]

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        out = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{{"):
                out.append(_Expression(part[2:-2]).whole())
            elif not part.startswith("{%"):
                out.append(Const(part))
            else:
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(out), f"{word} {rest}".strip()
                if word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                    out.append(For(m[1], _Expression(m[2]).whole(), block(("endfor",))[0]))
                elif word == "if":
                    out.append(branch(rest))
                elif word == "generation" and not rest:
                    out.append(Mark(block(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unknown statement {part!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def branch(test: str) -> If:
        then, end = block(("elif", "else", "endif"))
        word, _, rest = end.partition(" ")
        other = (branch(rest),) if word == "elif" else block(("endif",))[0] if word == "else" else ()
        return If(_Expression(test).whole(), then, other)

    return block(())[0]


def fold(node, filters: Mapping[str, Callable]):
    """The tree with constant expressions computed, dead branches gone and adjacent text joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in (fold(x, filters) for x in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Const) and out and isinstance(out[-1], Const):
                    out[-1] = Const(_text(out[-1].value) + _text(y.value))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op in _OPS and all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.op](*(a.value for a in args)))
        return Op(node.op, args)
    if isinstance(node, Apply):
        if node.filter not in filters:
            raise TemplateError(f"unknown filter {node.filter!r}")
        to = fold(node.to, filters)
        return Const(filters[node.filter](to.value)) if isinstance(to, Const) else Apply(node.filter, to)
    if isinstance(node, Key):
        return Key(fold(node.of, filters), node.key)
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Mark):
        return Mark(fold(node.body, filters))
    if isinstance(node, If):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return If(test, fold(node.then, filters), fold(node.other, filters))
    return node


def _text(value) -> str:
    return "" if value is None else str(value)


def _value(node, filters) -> Callable[[dict], object]:
    if isinstance(node, Const):
        fixed = node.value
        return lambda env: fixed
    if isinstance(node, Name):
        name = node.name

        def named(env):
            if name not in env:
                raise TemplateError(f"unknown name {name!r}")
            return env[name]

        return named
    if isinstance(node, Key):
        of, key = _value(node.of, filters), node.key

        def keyed(env):
            found = of(env)
            return found.get(key) if isinstance(found, Mapping) else None

        return keyed
    if isinstance(node, Apply):
        change, to = filters[node.filter], _value(node.to, filters)
        return lambda env: change(to(env))
    first, *rest = (_value(a, filters) for a in node.args)
    if node.op == "and":
        return lambda env: first(env) and rest[0](env)
    if node.op == "or":
        return lambda env: first(env) or rest[0](env)
    op = _OPS[node.op]
    return lambda env: op(first(env), *(r(env) for r in rest))


def _writer(body: tuple, filters) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = []
    for node in body:
        if isinstance(node, For):
            steps.append(_loop(node, filters))
        elif isinstance(node, If):
            steps.append(_branch(node, filters))
        elif isinstance(node, Mark):
            inner = _writer(node.body, filters)
            steps.append(lambda env, marked, inner=inner: inner(env, True))
        else:
            steps.append(_piece(_value(node, filters)))

    def write(env, marked):
        for step in steps:
            yield from step(env, marked)

    return write


def _piece(value):
    def write(env, marked):
        yield _text(value(env)), marked

    return write


def _branch(node: If, filters):
    test, then, other = _value(node.test, filters), _writer(node.then, filters), _writer(node.other, filters)
    return lambda env, marked: (then if test(env) else other)(env, marked)


def _loop(node: For, filters):
    over, body, name = _value(node.over, filters), _writer(node.body, filters), node.name

    def write(env, marked):
        for n, x in enumerate(over(env) or ()):
            yield from body({**env, name: x, "loop": {"first": n == 0, "index": n + 1}}, marked)

    return write


class Template:
    """A compiled template. render() is lazy: it takes iterables and holds one item of a loop at a time."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        filters = dict(filters or {})
        self.tree = fold(parse(source), filters)
        self._write = _writer(self.tree, filters)

    def render(self, **names: Iterable) -> Iterator[tuple[str, bool]]:
        """The output in pieces, each with whether it stands between generation markers."""
        return self._write(names, False)
