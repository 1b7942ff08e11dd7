"""What expressions in JavaScript handlers yield, where a project's ORM models tell: Prisma, Mongoose and Sequelize.

An expression is a call of a model, a name that one was assigned to, a part of either, or a literal that holds such. What
isn't one of these is not known: methods, chains and receivers that the readers don't have are left out, not guessed.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from corvid.packs.scanner import closing, object_schema, split_top
from corvid.sources import models

_NAME = r"[A-Za-z_$][\w$]*"
#: Links of a query's chain that don't change the shape of its result, or that the reader knows.
NEUTRAL = {"select", "populate", "sort", "limit", "skip", "where", "equals", "gt", "gte", "lt", "lte", "in", "nin", "ne", "or", "and", "lean", "exec", "session", "read", "hint", "collation", "maxTimeMS", "comment", "batchSize"}


def _expression(code: str, at: int) -> str:
    """The expression that begins at `at`: up to a semicolon or comma, or a line's end that no chain continues."""
    end = at
    while end < len(code) and code[end] not in ";,)]}":
        if code[end] in "([{":
            end = closing(code, end) + 1
        elif code[end] == "\n" and code[at:end].strip() and not re.match(r"\s*(?:\.|\?\?|\|\|)", code[end:]):
            break
        else:
            end += 1
    return code[at:end].strip()


def present(schema: dict) -> dict:
    """A schema without null."""
    kind = schema.get("type")
    if isinstance(kind, list):
        left = [k for k in kind if k != "null"]
        return {**schema, "type": left[0] if len(left) == 1 else left}
    some = [s for s in schema.get("anyOf", ()) if s != {"type": "null"}]
    return some[0] if len(some) == 1 else schema


def returned(code: str) -> list[str]:
    """The expressions that a function's text returns, those of functions inside it left out."""
    single = re.match(rf"\s*(?:(?:const|let|var)\s+\w+[^=]*=\s*)?(?:async\s+)?{_NAME}\s*=>\s*", code)
    head = -1 if single or "(" not in code else closing(code, code.index("("))
    arrow = single or re.compile(r"\s*(?::[^={]+)?=>\s*").match(code, head + 1)
    if arrow and code[arrow.end() : arrow.end() + 1] != "{":
        e = _expression(code, arrow.end())
        return [e[1:-1].strip() if e.startswith("(") and closing(e, 0) == len(e) - 1 else e]
    brace = arrow.end() if arrow else code.find("{", head + 1)
    body = code[brace + 1 : closing(code, brace)] if brace >= 0 else ""
    for m in list(re.finditer(r"(?:=>|\bfunction\b[^{()]*\([^()]*\))\s*(?=\{)", body)):
        inner = closing(body, m.end())
        body = body[: m.end()] + re.sub(r"[^\n]", " ", body[m.end() : inner + 1]) + body[inner + 1 :]
    return [e for m in re.finditer(r"\breturn\b[ \t]*(?=[^\s;])", body) if (e := _expression(body, m.end()))]


class Results:
    """The models of a project's files, and what expressions over them yield."""

    def __init__(self, files: Mapping[str, str], scripts: Mapping[str, str]):
        self.prisma, self.mongoose, self.sequelize = {}, {}, {}
        for path, text in files.items():
            if path.endswith(".prisma"):
                self.prisma |= models.prisma(text)
        everything = "\n".join(scripts.values())
        kinds = "|".join(["PrismaClient", *re.findall(r"\bclass\s+(\w+)\s+extends\s+PrismaClient\b", everything)])
        #: names that a Prisma client is bound to, by construction or by type
        self.clients = {a or b for a, b in re.findall(rf"({_NAME})\s*(?::[^=\n;,()]+)?=\s*(?:[\w.]+\s*(?:\?\?|\|\|)\s*)?new\s+(?:{kinds})\b|({_NAME})\s*[?!]?:\s*(?:{kinds})\b", everything)} if self.prisma else set()
        for text in scripts.values():
            declared = models.mongoose(text)
            for alias, name in re.findall(rf"(?:const|let|var)\s+({_NAME})\s*=\s*(?:\w+\.)?model(?:<[^>]*>)?\(\s*['\"](\w+)['\"]", text):
                if name in declared:
                    declared.setdefault(alias, declared[name])
            self.mongoose |= declared
            defined = models.sequelize(text)
            for alias, name in re.findall(rf"(?:const|let|var)\s+({_NAME})\s*=\s*\w+\.define\(\s*['\"](\w+)['\"]", text):
                if name in defined:
                    defined.setdefault(alias, defined[name])
            self.sequelize |= defined

    def schema(self, code: str, expression: str, depth: int = 0) -> dict | None:
        """The schema of an expression within a function's text; None where it isn't known."""
        e = re.sub(r"^await\s+", "", expression.strip())
        if not (self.prisma or self.mongoose or self.sequelize) or depth > 8:
            return None
        if e.startswith("(") and closing(e, 0) == len(e) - 1:
            return self.schema(code, e[1:-1], depth + 1)
        if re.fullmatch(_NAME, e):
            return self._bound(code, e, depth)
        if re.fullmatch(rf"{_NAME}(?:\.{_NAME})+", e):
            head, *parts = e.split(".")
            out = self._bound(code, head, depth)
            for part in parts:
                out = present(out) if out else None
                if out is None:
                    return None
                out = {"type": "integer"} if part == "length" and out.get("type") == "array" else out.get("properties", {}).get(part)
            return out
        if e[:1] in "{[" and depth:
            return object_schema(e, known=lambda t: self.schema(code, t, depth + 1))
        return self._call(e)

    def _call(self, e: str) -> dict | None:
        m = re.match(rf"(?:this\.)?({_NAME}(?:\.{_NAME})*)\s*\(", e)
        if not m:
            return None
        names, end = m[1].split("."), closing(e, m.end() - 1)
        if len(names) == 3 and names[0] in self.clients and not e[end + 1 :].strip():
            return models.prisma_result(self.prisma, e)
        if len(names) != 2 or m[0].startswith("this."):
            return None
        links, at = [], end + 1
        while link := re.compile(rf"\s*\.\s*({_NAME})\s*\(").match(e, at):
            links.append(link[1])
            at = closing(e, link.end() - 1) + 1
        if e[at:].strip():
            return None
        if names[0] in self.mongoose and NEUTRAL.issuperset(links):
            return models.mongoose_result(self.mongoose, e)
        return models.sequelize_result(self.sequelize, e) if names[0] in self.sequelize and not links else None

    def _bound(self, code: str, name: str, depth: int) -> dict | None:
        """What a name holds that is declared once in the text and never assigned again; without null after a guard."""
        n = re.escape(name)
        if re.search(rf"(?<![\w$.]){n}\s*(?:[-+*/|&?]{{0,2}})=(?![=>])", re.sub(rf"\b(?:const|let|var)\s+{n}\b[^=;\n]*=", "", code)):
            return None
        plain = list(re.finditer(rf"\b(?:const|let|var)\s+{n}\s*(?::[^=;\n]+)?=(?![=>])\s*", code))
        if len(plain) == 1:
            out = self.schema(code, _expression(code, plain[0].end()), depth + 1)
        elif plain:
            return None
        else:
            out = self._taken(code, name, depth)
        guard = rf"\bif\s*\(\s*(?:!\s*{n}|{n}\s*={{2,3}}\s*(?:null|undefined))\s*\)\s*(?:\{{[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*?)?\s*\b(?:return|throw)\b"
        return present(out) if out and re.search(guard, code) else out

    def _taken(self, code: str, name: str, depth: int) -> dict | None:
        """What a name holds that an array of promises or an object was taken apart into."""
        for m in re.finditer(r"\b(?:const|let|var)\s*\[([^\[\]]*)\]\s*=\s*(?:await\s+)?Promise\.all\(\s*(?=\[)", code):
            names = [x.strip() for x in m[1].split(",")]
            given = split_top(code[m.end() + 1 : closing(code, m.end())])
            if name in names and names.index(name) < len(given):
                return self.schema(code, given[names.index(name)], depth + 1)
        for m in re.finditer(r"\b(?:const|let|var)\s*\{([^{}]*)\}\s*=\s*", code):
            for entry in m[1].split(","):
                key, _, alias = (x.strip() for x in entry.partition(":"))
                if (alias or key) == name:
                    whole = self.schema(code, _expression(code, m.end()), depth + 1)
                    return present(whole).get("properties", {}).get(key) if whole else None
        return None
