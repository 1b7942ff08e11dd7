"""Schemas of declared types in TypeScript, Rust and PHP, from their text: no checker and no inference.

A reader resolves a type's expression to a schema. Named types become components, each read once; what isn't known (a
type parameter, a computed type) is an empty schema, which the gate counts as a gap."""

from __future__ import annotations

import re
from collections.abc import Mapping

from corvid.packs.scanner import closing, split_top, string
from corvid.sources.models import nullable

REF = "#/components/schemas/"
DEPTH = 12


def split_angles(text: str, separator: str = ",") -> list[str]:
    """Parts between separators outside brackets, angle brackets included."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([{") - (c in ")]}" or (c == ">" and text[i - 1 : i] not in ("=", "-")))
        if c == separator and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()] if text[start:].strip() else out


class Types:
    """What the readers share: the sources, and the components found so far."""

    def __init__(self, texts: Mapping[str, str], components: dict):
        self.texts, self.components = texts, components

    def named(self, name: str, make) -> dict:
        """A reference to the component of a type, which make() reads if nothing has that name yet."""
        if name not in self.components:
            self.components[name] = {}
            self.components[name] = make()
        return {"$ref": REF + name}


class TypeScript(Types):
    """Interfaces, type aliases, enums and the fields of classes."""

    SCALARS = {
        "string": {"type": "string"}, "number": {"type": "number"}, "boolean": {"type": "boolean"}, "null": {"type": "null"}, "bigint": {"type": "integer"},
        "Date": {"type": "string", "format": "date-time"}, "true": {"type": "boolean", "const": True}, "false": {"type": "boolean", "const": False},
    }

    def schema(self, kind: str, depth: int = 0) -> dict:
        kind = kind.strip().rstrip(";").strip()
        if depth > DEPTH or not kind:
            return {}
        if kind.startswith("(") and closing(kind, 0) == len(kind) - 1:
            return self.schema(kind[1:-1], depth + 1)
        parts = [p for p in split_angles(kind, "|") if p not in ("undefined", "")]
        if len(parts) > 1:
            return self._union(parts, depth)
        if len(both := split_angles(kind, "&")) > 1:
            return {"allOf": [self.schema(p, depth + 1) for p in both]}
        kind = parts[0] if parts else kind
        if kind in self.SCALARS:
            return dict(self.SCALARS[kind])
        if (literal := string(kind)) is not None:
            return {"type": "string", "const": literal}
        if re.fullmatch(r"-?\d+(?:\.\d+)?", kind):
            return {"type": "number", "const": float(kind) if "." in kind else int(kind)}
        if kind.endswith("[]"):
            return {"type": "array", "items": self.schema(kind[:-2], depth + 1)}
        if kind.startswith("{"):
            return self.object(kind[1:-1], depth)
        if kind.startswith("["):
            items = [self.schema(p, depth + 1) for p in split_angles(kind[1:-1])]
            return {"type": "array", "prefixItems": items, "minItems": len(items), "maxItems": len(items)}
        m = re.fullmatch(r"([\w.$]+)\s*(?:<(.*)>)?", kind, re.S)
        return self._applied(m[1].rpartition(".")[2], split_angles(m[2] or ""), depth) if m else {}

    def _union(self, parts: list[str], depth: int) -> dict:
        rest = [p for p in parts if p != "null"]
        texts = [string(p) for p in rest]
        if all(t is not None for t in texts):
            out: dict = {"type": "string", "enum": texts}
        else:
            each = [self.schema(p, depth + 1) for p in rest]
            out = each[0] if len(each) == 1 else {"anyOf": each}
        return nullable(out) if len(rest) < len(parts) else out

    def _applied(self, name: str, args: list[str], depth: int) -> dict:
        if name in ("Promise", "Awaited", "Readonly", "Required", "NonNullable", "Observable", "Jsonify") and args:
            return self.schema(args[0], depth + 1)
        if name in ("Array", "ReadonlyArray", "Set") and args:
            return {"type": "array", "items": self.schema(args[0], depth + 1)}
        if name in ("Record", "Map") and len(args) == 2:
            return {"type": "object", "additionalProperties": self.schema(args[1], depth + 1)}
        if name in ("Partial", "Pick", "Omit") and args:
            whole = self.whole(self.schema(args[0], depth + 1))
            names = {string(x.strip()) for x in split_angles(args[1], "|")} if len(args) > 1 else set()
            kept = {k: v for k, v in whole.get("properties", {}).items() if name == "Partial" or (k in names) == (name == "Pick")}
            needed = [k for k in whole.get("required", []) if k in kept and name != "Partial"]
            return {"type": "object", "properties": kept, **({"required": needed} if needed else {})}
        for text in self.texts.values():
            if m := re.search(rf"\b(interface|class|enum)\s+{re.escape(name)}\b\s*(?:<[^{{]*>)?\s*(?:extends\s+([\w.$, ]+?)\s*)?(?:implements\s+[^{{]+)?\{{", text):
                body = text[m.end() : closing(text, m.end() - 1)]
                return self.named(name, lambda m=m, body=body: self._declared(m[1], m[2], body, depth))
            if m := re.search(rf"\btype\s+{re.escape(name)}\s*=\s*", text):
                return self.named(name, lambda m=m, text=text: self.schema(self._alias(text, m.end()), depth + 1))
        return {}

    @staticmethod
    def _alias(text: str, at: int) -> str:
        end = at
        while end < len(text):
            if text[end] in "{([":
                end = closing(text, end)
            elif text[end] == ";" or (text[end] == "\n" and not re.match(r"\s*[|&]", text[end:]) and text[at:end].strip() and not re.search(r"[|&]\s*$", text[at:end])):
                break
            end += 1
        return text[at:end]

    def _declared(self, what: str, parents: str | None, body: str, depth: int) -> dict:
        if what == "enum":
            members = [e.partition("=") for e in split_top(body) if e.strip()]
            values = [string(v.strip()) if v.strip() else i for i, (_, _, v) in enumerate(members)]
            return {"type": "string", "enum": values} if all(isinstance(v, str) for v in values) else {"enum": [int(m[2]) if re.fullmatch(r"\s*\d+\s*", m[2]) else v for m, v in zip(members, values)]}
        own = self.object(body, depth)
        for parent in filter(None, map(str.strip, (parents or "").split(","))):
            base = self.whole(self.schema(parent, depth + 1))
            needed = list(dict.fromkeys([*base.get("required", []), *own.get("required", [])]))
            own = {"type": "object", "properties": {**base.get("properties", {}), **own["properties"]}, **({"required": needed} if needed else {})}
        return own

    def whole(self, schema: dict) -> dict:
        return self.components.get(schema["$ref"][len(REF) :], {}) if "$ref" in schema else schema

    def object(self, body: str, depth: int) -> dict:
        properties, required, extra = {}, [], None
        for entry in self._entries(body):
            if m := re.match(r"\[\s*\w+\s*:\s*\w+\s*\]\s*:\s*(.+)", entry, re.S):
                extra = self.schema(m[1], depth + 1)
            elif m := re.match(r"(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|readonly|declare|override)\s+)*(['\"]?)([\w$-]+)\1\s*([?!]?)\s*:\s*([^=]+|.*=>.*)", entry, re.S):
                properties[m[2]] = self.schema(m[4], depth + 1)
                if m[3] != "?" and not re.search(r"(?:^|\|)\s*undefined\s*(?:\||$)", m[4]) and "=" not in entry[m.end(4) :]:
                    required.append(m[2])
        return {"type": "object", "properties": properties, **({"required": required} if required else {}), **({"additionalProperties": extra} if extra is not None else {})}

    @staticmethod
    def _entries(body: str) -> list[str]:
        """Members of an object type, which end at semicolons, commas or lines."""
        out, start, at = [], 0, 0
        while at < len(body):
            if body[at] in "{([":
                at = closing(body, at)
            elif body[at] == "<" and (m := re.compile(r"<[^<>;]*(?:<[^<>;]*>[^<>;]*)*>").match(body, at)):
                at = m.end() - 1
            elif body[at] in ";,\n" and not (body[at] == "\n" and (re.match(r"\s*[|&?]", body[at:]) or body[start:at].strip().startswith("@") and ":" not in body[start:at])):
                out.append(body[start:at].strip())
                start = at + 1
            at += 1
        return [e for e in [*out, body[start:].strip()] if e]


class Rust(Types):
    """Structs and enums, as serde writes them."""

    SCALARS = {
        **{k: {"type": "integer"} for k in ("i8", "i16", "u8", "u16", "u32", "i128", "u128")}, "i32": {"type": "integer", "format": "int32"}, **{k: {"type": "integer", "format": "int64"} for k in ("i64", "u64", "isize", "usize")},
        "f32": {"type": "number"}, "f64": {"type": "number"}, "bool": {"type": "boolean"}, "char": {"type": "string"}, "String": {"type": "string"}, "str": {"type": "string"}, "Uuid": {"type": "string", "format": "uuid"},
        "DateTime": {"type": "string", "format": "date-time"}, "NaiveDateTime": {"type": "string", "format": "date-time"}, "NaiveDate": {"type": "string", "format": "date"}, "Value": {},
    }
    #: serde's rules of names.
    CASES = {
        "camelCase": lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), "PascalCase": lambda w: "".join(x.capitalize() for x in w), "snake_case": "_".join, "kebab-case": "-".join,
        "SCREAMING_SNAKE_CASE": lambda w: "_".join(w).upper(), "SCREAMING-KEBAB-CASE": lambda w: "-".join(w).upper(), "lowercase": "".join, "UPPERCASE": lambda w: "".join(w).upper(),
    }

    def schema(self, kind: str, depth: int = 0) -> dict:
        kind = re.sub(r"^&\s*(?:'\w+\s+)?(?:mut\s+)?", "", kind.strip())
        if depth > DEPTH or not kind:
            return {}
        if kind.startswith("["):
            return {"type": "array", "items": self.schema(kind[1:-1].partition(";")[0], depth + 1)}
        m = re.fullmatch(r"(?:\w+::)*(\w+)\s*(?:<(.*)>)?", kind, re.S)
        if not m:
            return {}
        name, args = m[1], [a for a in split_angles(m[2] or "") if not a.startswith("'")]
        if name in ("Vec", "VecDeque", "HashSet", "BTreeSet") and args:
            return {"type": "array", "items": self.schema(args[0], depth + 1)}
        if name in ("HashMap", "BTreeMap") and len(args) == 2:
            return {"type": "object", "additionalProperties": self.schema(args[1], depth + 1)}
        if name == "Option" and args:
            return nullable(self.schema(args[0], depth + 1))
        if name in ("Box", "Arc", "Rc", "Cow", "Json", "Query", "Path", "Form", "Result") and args:
            return self.schema(args[0], depth + 1)
        if name in self.SCALARS:
            return dict(self.SCALARS[name])
        for text in self.texts.values():
            d = re.search(rf"((?:#\[[^\]]*\]\s*)*)(?:pub(?:\([^)]*\))?\s+)?(struct|enum)\s+{re.escape(name)}\b\s*(?:<[^{{(;]*>)?\s*([{{(])", text)
            if d:
                body = text[d.end() : closing(text, d.end() - 1)]
                return self.named(name, lambda d=d, body=body: self._declared(d[1], d[2], d[3], body, depth))
        return {}

    def _name(self, written: str, attributes: str, rule: str | None) -> str:
        if m := re.search(r'\brename\s*=\s*"([^"]+)"', attributes):
            return m[1]
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", written)]
        return self.CASES[rule](words) if rule in self.CASES and words else written

    def _declared(self, attributes: str, what: str, opened: str, body: str, depth: int) -> dict:
        rule = m[1] if (m := re.search(r'rename_all\s*=\s*"([^"]+)"', attributes)) else None
        if what == "struct" and opened == "(":
            fields = split_angles(body)
            return self.schema(re.sub(r"^pub\s+", "", fields[0]), depth + 1) if len(fields) == 1 else {}
        members = [re.match(r"((?:\s*#\[[^\]]*\])*)\s*(?:pub(?:\([^)]*\))?\s+)?(.*)", e, re.S).groups() for e in split_angles(re.sub(r"//[^\n]*", "", body))]
        if what == "enum":
            units = [self._name(n, a, rule) for a, n in members if re.fullmatch(r"\w+", n.strip())]
            return {"type": "string", "enum": units} if len(units) == len(members) else {}
        properties, required = {}, []
        for own, field in members:
            written, _, kind = field.partition(":")
            if not kind or re.search(r"\bserde\([^)]*\bskip\b", own):
                continue
            schema = self.schema(kind, depth + 1)
            if re.search(r"\bserde\([^)]*\bflatten\b", own):
                inner = self.components.get(schema.get("$ref", "")[len(REF) :], {})
                properties |= inner.get("properties", {})
                required += inner.get("required", [])
                continue
            name = self._name(written.strip().removeprefix("r#"), own, rule)
            properties[name] = schema
            if not kind.strip().startswith(("Option<", "std::option")) and not re.search(r"\bserde\([^)]*\bdefault\b", own):
                required.append(name)
        return {"type": "object", "properties": properties, **({"required": required} if required else {})}


class Php(Types):
    """Classes by their typed properties and promoted constructor parameters, and backed enums."""

    SCALARS = {
        "string": {"type": "string"}, "int": {"type": "integer"}, "float": {"type": "number"}, "bool": {"type": "boolean"}, "array": {"type": "array"}, "null": {"type": "null"}, "mixed": {},
        "DateTime": {"type": "string", "format": "date-time"}, "DateTimeImmutable": {"type": "string", "format": "date-time"}, "DateTimeInterface": {"type": "string", "format": "date-time"},
    }

    def schema(self, kind: str, depth: int = 0, doc: str = "") -> dict:
        kind = kind.strip().lstrip("\\")
        if depth > DEPTH or not kind:
            return {}
        if kind.startswith("?"):
            return nullable(self.schema(kind[1:], depth + 1, doc))
        parts = split_angles(kind, "|")
        if len(parts) > 1:
            rest = [self.schema(p, depth + 1) for p in parts if p != "null"]
            out = rest[0] if len(rest) == 1 else {"anyOf": rest}
            return nullable(out) if "null" in parts else out
        if kind.endswith("[]"):
            return {"type": "array", "items": self.schema(kind[:-2], depth + 1)}
        if m := re.fullmatch(r"(?:array|list|iterable|Collection)<(.+)>", kind):
            args = split_angles(m[1])
            return {"type": "object", "additionalProperties": self.schema(args[1], depth + 1)} if len(args) == 2 and args[0] == "string" else {"type": "array", "items": self.schema(args[-1], depth + 1)}
        if kind == "array" and (m := re.search(r"@(?:var|param)\s+([^\s*]+)", doc)):
            return self.schema(m[1], depth + 1)
        name = kind.rpartition("\\")[2]
        if name in self.SCALARS:
            return dict(self.SCALARS[name])
        for text in self.texts.values():
            if m := re.search(rf"\benum\s+{re.escape(name)}\s*(?::\s*(\w+))?[^{{]*\{{", text):
                cases = re.findall(r"\bcase\s+\w+\s*=\s*([^;]+);", text[m.end() : closing(text, m.end() - 1)])
                values = [string(c) if string(c) is not None else int(c) for c in cases]
                return self.named(name, lambda m=m, values=values: {"type": "integer" if m[1] == "int" else "string", "enum": values})
            if m := re.search(rf"\bclass\s+{re.escape(name)}\b[^{{]*\{{", text):
                body = text[m.end() : closing(text, m.end() - 1)]
                return self.named(name, lambda body=body: self._declared(body, depth))
        return {}

    def _declared(self, body: str, depth: int) -> dict:
        fields = []
        for m in re.finditer(r"(/\*\*(?:[^*]|\*(?!/))*\*/\s*)?(?:#\[[^\]]*\]\s*)*public\s+(?:readonly\s+)?([?\\\w|]+)\s+\$(\w+)\s*(=)?", body):
            fields.append((m[3], m[2], m[1] or "", bool(m[4])))
        properties = {n: self.schema(k, depth + 1, doc) for n, k, doc, _ in fields}
        required = [n for n, k, _, default in fields if not default and not k.startswith("?") and "null" not in k.split("|")]
        return {"type": "object", "properties": properties, **({"required": required} if required else {})}
