"""Schemas from declared validators: Zod, Joi, Yup, TypeBox, ArkType, fluent schemas, express-validator, FluentValidation,
Marshmallow. Each is a chain of calls; a link that isn't known leaves the schema as it is."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Mapping

from corvid.packs.pyfacts import constant, dotted, keyword
from corvid.packs.scanner import closing, object_schema, split_top, string

Link = tuple[str, list[str]]

#: What the heads of chains stand for, by library.
KINDS: dict[str, dict] = {
    "string": {"type": "string"}, "str": {"type": "string"}, "number": {"type": "number"}, "integer": {"type": "integer"}, "int": {"type": "integer"}, "bigint": {"type": "integer", "format": "int64"}, "boolean": {"type": "boolean"}, "bool": {"type": "boolean"},
    "date": {"type": "string", "format": "date-time"}, "null": {"type": "null"}, "any": {}, "unknown": {}, "mixed": {}, "email": {"type": "string", "format": "email"}, "url": {"type": "string", "format": "uri"}, "uuid": {"type": "string", "format": "uuid"}, "binary": {"type": "string", "format": "binary"},
}
FORMATS = {"email": "email", "url": "uri", "uri": "uri", "uuid": "uuid", "guid": "uuid", "datetime": "date-time", "isoDate": "date-time", "ip": "ip", "isEmail": "email", "isURL": "uri", "isUUID": "uuid", "isISO8601": "date-time"}


def chain(text: str) -> list[Link]:
    """The links of a call chain: z.string().min(1) -> [("z", []), ("string", []), ("min", ["1"])]."""
    out: list[Link] = []
    at = 0
    while m := re.compile(r"\s*\.?\s*([A-Za-z_$][\w$]*)").match(text, at):
        at, args = m.end(), []
        if at < len(text) and text[at] == "(":
            end = closing(text, at)
            args = split_top(text[at + 1 : end])
            at = end + 1
        out.append((m[1], args))
        if not re.compile(r"\s*\.").match(text, at):
            break
    return out


def _number(text: str) -> int | float | None:
    try:
        return int(text) if re.fullmatch(r"-?\d+", text.strip()) else float(text)
    except ValueError:
        return None


def _bounded(schema: dict, name: str, value) -> dict:
    kind = schema.get("type")
    base = kind[0] if isinstance(kind, list) else kind
    low, high = {"string": ("minLength", "maxLength"), "array": ("minItems", "maxItems")}.get(base, ("minimum", "maximum"))
    keys = {"min": (low,), "gte": (low,), "max": (high,), "lte": (high,), "length": (low, high), "size": (low, high), "gt": ("exclusiveMinimum",), "lt": ("exclusiveMaximum",), "greater": ("exclusiveMinimum",), "less": ("exclusiveMaximum",), "multipleOf": ("multipleOf",), "step": ("multipleOf",)}
    return {**schema, **{k: value for k in keys[name]}} if value is not None else schema


def nullable(schema: dict) -> dict:
    kind = schema.get("type")
    return {**schema, "type": [kind, "null"]} if isinstance(kind, str) else {"anyOf": [schema, {"type": "null"}]}


class Reader:
    """One library's dialect of chains. `named` resolves names of other schemas in the same source to their text."""

    def __init__(self, library: str, named: Mapping[str, str] | None = None):
        self.library, self.named = library, named or {}

    def read(self, text: str, depth: int = 0) -> tuple[dict, bool]:
        """(schema, required) of an expression."""
        text = text.strip()
        if depth > 12:
            return {}, True
        if re.fullmatch(r"[A-Za-z_$][\w$]*", text) and text in self.named:
            return self.read(self.named[text], depth + 1)
        if text.startswith("{"):
            return self.object(text, depth), True
        links = chain(text)
        if links and links[0][1] == [] and not re.match(r"[\w$]+\s*\(", text):
            if links[0][0] in self.named:
                base, _ = self.read(self.named[links[0][0]], depth + 1)
                return self.fold(base, links[1:], True, depth)
            links = links[1:]
        if not links:
            return {}, True
        (head, args), rest = links[0], links[1:]
        required = self.library not in ("joi", "yup")
        return self.fold(self.head(head, args, depth), rest, required, depth)

    def object(self, text: str, depth: int) -> dict:
        properties, required = {}, []
        for entry in split_top(text.strip()[1:-1]):
            key, _, value = entry.partition(":")
            name = string(key.strip()) or key.strip()
            if not value or entry.startswith("..."):
                continue
            properties[name], needed = self.read(value, depth + 1)
            if needed:
                required.append(name)
        return {"type": "object", "properties": properties, **({"required": required} if required else {})}

    def head(self, name: str, args: list[str], depth: int) -> dict:
        low = name[:1].lower() + name[1:]
        if low in ("object", "strictObject", "looseObject", "keys", "interface"):
            return self.object(args[0], depth) if args and args[0].startswith("{") else {"type": "object"}
        if low in ("array", "set"):
            return {"type": "array", "items": self.read(args[0], depth + 1)[0] if args else {}, **({"uniqueItems": True} if low == "set" else {})}
        if low == "tuple" and args:
            items = [self.read(a, depth + 1)[0] for a in split_top(args[0][1:-1])]
            return {"type": "array", "prefixItems": items, "minItems": len(items), "maxItems": len(items)}
        if low in ("record", "map") and args:
            return {"type": "object", "additionalProperties": self.read(args[-1], depth + 1)[0]}
        if low in ("enum", "valid", "nativeEnum", "oneOf") and args:
            values = [v for a in args for v in (split_top(a[1:-1]) if a.startswith("[") else [a])]
            values = [string(v) if string(v) is not None else _number(v) for v in values]
            return {"type": "string", "enum": values} if all(isinstance(v, str) for v in values) else {"enum": values}
        if low == "literal" and args:
            value = string(args[0])
            return {**(object_schema(args[0]) or {}), "const": value if value is not None else _number(args[0]) if _number(args[0]) is not None else args[0] == "true"}
        if low in ("union", "discriminatedUnion", "alternatives") and args:
            return {"anyOf": [self.read(a, depth + 1)[0] for a in split_top(args[-1][1:-1])]}
        if low in ("intersection", "intersect") and args:
            parts = split_top(args[0][1:-1]) if args[0].startswith("[") else args
            return {"allOf": [self.read(a, depth + 1)[0] for a in parts]}
        if low in ("optional", "readonly", "lazy") and args:  # TypeBox wraps rather than chains
            return self.read(re.sub(r"^\(\)\s*=>\s*", "", args[0]), depth + 1)[0]
        out = dict(KINDS.get(low, {}))
        if self.library == "typebox" and args and args[-1].startswith("{"):
            out |= {k.strip(): _number(v) if _number(v) is not None else string(v) for k, _, v in (e.partition(":") for e in split_top(args[-1][1:-1])) if v}
        return out

    def fold(self, schema: dict, links: list[Link], required: bool, depth: int) -> tuple[dict, bool]:
        for name, args in links:
            first = args[0] if args else ""
            if name in ("optional", "notRequired", "exactOptional", "isOptional"):
                required = False
            elif name in ("required", "defined", "exists", "notEmpty"):
                required = True
            elif name in ("nullable", "nullish") or (name in ("allow", "alternatives") and first == "null"):
                schema, required = nullable(schema), required and name != "nullish"
            elif name in ("default", "prefault"):
                value = string(first) if string(first) is not None else _number(first) if first else None
                schema, required = ({**schema, "default": value} if value is not None else schema), False
            elif name in ("min", "max", "length", "size", "gt", "gte", "lt", "lte", "greater", "less", "multipleOf", "step"):
                schema = _bounded(schema, name, _number(first) if first else None)
            elif name in ("int", "integer", "toInt") and schema.get("type") in ("number", None):
                schema = {**schema, "type": "integer"}
            elif name in ("positive", "negative", "nonnegative", "nonpositive"):
                schema = {**schema, {"positive": "exclusiveMinimum", "negative": "exclusiveMaximum", "nonnegative": "minimum", "nonpositive": "maximum"}[name]: 0}
            elif name in FORMATS:
                schema = {**(schema or {"type": "string"}), "format": FORMATS[name]}
            elif name in ("regex", "pattern", "matches") and first.startswith("/"):
                schema = {**schema, "pattern": first[1 : first.rfind("/")]}
            elif name in ("valid", "oneOf", "equal", "enum") and args:
                schema = {**schema, "enum": self.head("enum", args, depth)["enum"]}
            elif name in ("describe", "description", "label") and string(first) is not None:
                schema = {**schema, "description": string(first)}
            elif name == "array":
                schema = {"type": "array", "items": schema}
            elif name in ("items", "of") and args:
                schema = {**schema, "items": self.read(first, depth + 1)[0]}
            elif name in ("or",) and args:
                schema = {"anyOf": [schema, self.read(first, depth + 1)[0]]}
            elif name in ("and", "merge") and args:
                other = self.read(first, depth + 1)[0]
                schema = {"type": "object", "properties": {**schema.get("properties", {}), **other.get("properties", {})}, "required": list(dict.fromkeys([*schema.get("required", []), *other.get("required", [])]))}
            elif name in ("extend", "keys", "shape", "append") and first.startswith("{"):
                other = self.object(first, depth)
                schema = {**schema, "type": "object", "properties": {**schema.get("properties", {}), **other["properties"]}, "required": list(dict.fromkeys([*schema.get("required", []), *other.get("required", [])]))}
            elif name == "partial":
                schema = {k: v for k, v in schema.items() if k != "required"}
            elif name in ("pick", "omit") and first.startswith("{"):
                names = {e.partition(":")[0].strip() for e in split_top(first[1:-1])}
                keep = {k: v for k, v in schema.get("properties", {}).items() if (k in names) == (name == "pick")}
                schema = {**schema, "properties": keep, "required": [r for r in schema.get("required", []) if r in keep]}
            elif name in ("strict",):
                schema = {**schema, "additionalProperties": False}
            elif name in ("isInt", "isFloat", "isBoolean", "isString", "isArray"):
                schema = {**schema, **{"isInt": {"type": "integer"}, "isFloat": {"type": "number"}, "isBoolean": {"type": "boolean"}, "isString": {"type": "string"}, "isArray": {"type": "array", "items": {}}}[name]}
                for low, key in (("min", "minimum"), ("max", "maximum")):
                    if m := re.search(rf"\b{low}\s*:\s*(-?\d+)", first):
                        schema[key] = int(m[1])
            elif name == "isLength":
                schema = {**(schema or {"type": "string"}), **{k: int(m[1]) for low, k in (("min", "minLength"), ("max", "maxLength")) if (m := re.search(rf"\b{low}\s*:\s*(\d+)", first))}}
        if self.library == "typebox" and links == [] and schema is not None:
            return schema, required
        return schema, required


def zod(text: str, named: Mapping[str, str] | None = None) -> dict:
    return Reader("zod", named).read(text)[0]


def joi(text: str, named: Mapping[str, str] | None = None) -> dict:
    return Reader("joi", named).read(text)[0]


def yup(text: str, named: Mapping[str, str] | None = None) -> dict:
    return Reader("yup", named).read(text)[0]


def typebox(text: str, named: Mapping[str, str] | None = None) -> dict:
    """Type.Object({...}); a property within Type.Optional isn't required."""

    class Box(Reader):
        def read(self, text: str, depth: int = 0) -> tuple[dict, bool]:
            schema, required = super().read(text, depth)
            return schema, required and not re.match(r"\s*(?:Type|t|T)\s*\.\s*Optional\s*\(", text)

    return Box("typebox", named).read(text)[0]


def arktype(definition: str) -> dict:
    """A definition string: "string.email | null", "number >= 0", "1 < string <= 5", "'a' | 'b'", "string[]"."""
    parts = [p.strip() for p in split_top(definition.strip(), "|")]
    if len(parts) > 1:
        if all(string(p) is not None for p in parts):
            return {"type": "string", "enum": [string(p) for p in parts]}
        rest = [arktype(p) for p in parts if p != "null"]
        out = rest[0] if len(rest) == 1 else {"anyOf": rest}
        return nullable(out) if "null" in parts else out
    text = parts[0] if parts else ""
    if text.endswith("[]"):
        return {"type": "array", "items": arktype(text[:-2].strip("()"))}
    m = re.fullmatch(r"(?:(-?[\d.]+)\s*(<=?)\s*)?([a-z.]+)\s*(?:(<=?|>=?|==)\s*(-?[\d.]+))?(?:\s*%\s*(\d+))?", text)
    if not m:
        return {"type": "string", "const": string(text)} if string(text) is not None else {}
    head, _, sub = m[3].partition(".")
    out = dict(KINDS.get(head, {}))
    if sub == "integer":
        out["type"] = "integer"
    elif sub in FORMATS:
        out["format"] = FORMATS[sub]
    bounds = ([({"<": "gt", "<=": "min"}[m[2]], m[1])] if m[1] else []) + ([({"<": "lt", "<=": "max", ">": "gt", ">=": "min", "==": "length"}[m[4]], m[5])] if m[4] else [])
    for name, value in bounds:
        out = _bounded(out, name, _number(value))
    return {**out, "multipleOf": int(m[6])} if m[6] else out


def arktype_call(text: str) -> dict:
    """type({name: "string", "age?": "number > 0", inner: {...}}) or type("string[]"): a key that ends in ? may be absent."""
    m = re.match(r"\s*type\s*\(", text)
    args = split_top(text[m.end() : closing(text, m.end() - 1)]) if m else []
    return _arktype_value(args[0]) if args else {}


def _arktype_value(text: str) -> dict:
    if string(text) is not None:
        return arktype(string(text))
    if text.startswith("type"):
        return arktype_call(text)
    if not text.startswith("{"):
        return {}
    properties, required = {}, []
    for entry in split_top(text[1:-1]):
        key, _, value = entry.partition(":")
        name = string(key) or key.strip()
        if name.startswith("...") or not value:
            continue
        properties[name.removesuffix("?")] = _arktype_value(value.strip())
        if not name.endswith("?"):
            required.append(name)
    return {"type": "object", "properties": properties, **({"required": required} if required else {})}


def fluent(text: str) -> dict:
    """S.object().prop('a', S.string().required()).prop(...): required is said inside or right after a property."""
    links = [x for x in chain(text) if x[0] != "S"]
    if not links or links[0][0] != "object":
        return Reader("zod").read(text)[0]
    properties, required, last = {}, [], None
    for name, args in links[1:]:
        if name == "prop" and args and string(args[0]) is not None:
            last = string(args[0])
            inner = args[1] if len(args) > 1 else ""
            properties[last] = fluent(inner) if inner else {}
            if re.search(r"\.required\(\s*\)\s*$", inner):
                required.append(last)
        elif name == "required" and last and last not in required:
            required.append(last)
    return {"type": "object", "properties": properties, **({"required": required} if required else {})}


def express_validator(links_text: str) -> tuple[str, str, dict, bool] | None:
    """(place, name, schema, required) of body('a').isEmail().optional()."""
    links = chain(links_text)
    if not links or links[0][0] not in ("body", "query", "param", "header", "cookie", "check") or not links[0][1]:
        return None
    name = string(links[0][1][0])
    if name is None:
        return None
    schema, required = Reader("express-validator").fold({}, links[1:], True, 0)
    return {"param": "path", "check": "body"}.get(links[0][0], links[0][0]), name, schema or {"type": "string"}, required


def fluent_validation(text: str, schema: dict) -> dict:
    """RuleFor(x => x.Name).NotEmpty().MaximumLength(5) folded into a class's schema."""
    out = {**schema, "properties": {k: dict(v) for k, v in schema.get("properties", {}).items()}, "required": list(schema.get("required", []))}
    for m in re.finditer(r"RuleFor\(\s*\w+\s*=>\s*\w+\.(\w+)\s*\)", text):
        name = m[1][:1].lower() + m[1][1:]
        own = out["properties"].setdefault(name, {})
        for rule, args in chain(text[m.end() :]):
            value = _number(args[0]) if args else None
            if rule in ("NotEmpty", "NotNull") and name not in out["required"]:
                out["required"].append(name)
            key = {"MaximumLength": "maxLength", "MinimumLength": "minLength", "GreaterThan": "exclusiveMinimum", "GreaterThanOrEqualTo": "minimum", "LessThan": "exclusiveMaximum", "LessThanOrEqualTo": "maximum"}.get(rule)
            if key and value is not None:
                own[key] = value
            elif rule == "Length" and len(args) == 2:
                own |= {"minLength": _number(args[0]), "maxLength": _number(args[1])}
            elif rule == "InclusiveBetween" and len(args) == 2:
                own |= {"minimum": _number(args[0]), "maximum": _number(args[1])}
            elif rule == "EmailAddress":
                own["format"] = "email"
            elif rule == "Matches" and args and string(args[0].lstrip("@")):
                own["pattern"] = string(args[0].lstrip("@"))
    return out


#: Scalar fields of Marshmallow and flask-restx.
MARSHMALLOW = {"String": {"type": "string"}, "Str": {"type": "string"}, "Integer": {"type": "integer"}, "Int": {"type": "integer"}, "Float": {"type": "number"}, "Decimal": {"type": "number"}, "Boolean": {"type": "boolean"}, "Bool": {"type": "boolean"}, "Email": {"type": "string", "format": "email"}, "Url": {"type": "string", "format": "uri"}, "UUID": {"type": "string", "format": "uuid"}, "DateTime": {"type": "string", "format": "date-time"}, "Date": {"type": "string", "format": "date"}, "Raw": {}, "Dict": {"type": "object", "additionalProperties": {}}}


def marshmallow(source: str, named: Callable[[str], dict] | None = None) -> dict:
    """The schema of a Marshmallow class's source: load_only and dump_only as writeOnly and readOnly."""
    cls = next(n for n in ast.parse(source).body if isinstance(n, ast.ClassDef))
    named = named or (lambda name: {"$ref": f"#/components/schemas/{name.removesuffix('Schema')}"})

    def field(call: ast.expr) -> dict:
        if not isinstance(call, ast.Call):
            return {}
        kind = dotted(call.func).rpartition(".")[2]
        if kind in ("Nested",) and call.args:
            name = dotted(call.args[0]) or str(constant(call.args[0]))
            return {"type": "array", "items": named(name)} if constant(keyword(call, "many")) is True else named(name)
        if kind in ("List",) and call.args:
            return {"type": "array", "items": field(call.args[0])}
        out = dict(MARSHMALLOW.get(kind, {}))
        if constant(keyword(call, "allow_none")) is True:
            out = nullable(out)
        return out | ({"readOnly": True} if constant(keyword(call, "dump_only")) is True else {}) | ({"writeOnly": True} if constant(keyword(call, "load_only")) is True else {})

    properties, required = {}, []
    for n in cls.body:
        if isinstance(n, ast.Assign) and isinstance(n.targets[0], ast.Name) and isinstance(n.value, ast.Call):
            wire = constant(keyword(n.value, "data_key"))
            name = wire if isinstance(wire, str) else n.targets[0].id
            properties[name] = field(n.value)
            if constant(keyword(n.value, "required")) is True:
                required.append(name)
    return {"type": "object", "properties": properties, **({"required": required} if required else {})}
