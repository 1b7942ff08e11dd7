"""What ORM calls return: models declared for Prisma, Mongoose and Sequelize, and projections, relations and cardinality.

The algebra is small: a call picks columns, nests relations, and yields many, one or none, a count, or a result of a write.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from corvid.packs.scanner import closing, split_top, string

#: Scalars of each declaration language.
PRISMA = {"String": {"type": "string"}, "Int": {"type": "integer"}, "BigInt": {"type": "integer", "format": "int64"}, "Float": {"type": "number"}, "Decimal": {"type": "number"}, "Boolean": {"type": "boolean"}, "DateTime": {"type": "string", "format": "date-time"}, "Json": {}, "Bytes": {"type": "string", "contentEncoding": "base64"}}
MONGOOSE = {"String": {"type": "string"}, "Number": {"type": "number"}, "Boolean": {"type": "boolean"}, "Date": {"type": "string", "format": "date-time"}, "ObjectId": {"type": "string"}, "Mixed": {}, "Buffer": {"type": "string", "contentEncoding": "base64"}}
SEQUELIZE = {"STRING": {"type": "string"}, "TEXT": {"type": "string"}, "INTEGER": {"type": "integer"}, "BIGINT": {"type": "integer", "format": "int64"}, "FLOAT": {"type": "number"}, "DOUBLE": {"type": "number"}, "DECIMAL": {"type": "number"}, "BOOLEAN": {"type": "boolean"}, "DATE": {"type": "string", "format": "date-time"}, "DATEONLY": {"type": "string", "format": "date"}, "UUID": {"type": "string", "format": "uuid"}, "JSON": {}}
#: What calls yield.
MANY = {"findMany", "find", "findAll", "aggregate"}
ONE_OR_NONE = {"findUnique", "findFirst", "findOne", "findById", "findByPk", "findOneAndUpdate", "findByIdAndUpdate", "findOneAndDelete", "findByIdAndDelete"}
COUNTS = {"count", "countDocuments", "estimatedDocumentCount"}
PRISMA_ROW = {"findUniqueOrThrow", "findFirstOrThrow", "create", "update", "upsert", "delete"}
MODEL_ROW = {"create", "build"}
WRITES = {"updateMany": "count", "deleteMany": "count", "createMany": "count"}


@dataclass
class Model:
    """A model's columns and relations: scalars by name, relations as (model, many, optional)."""

    name: str
    scalars: dict[str, dict] = field(default_factory=dict)
    relations: dict[str, tuple[str, bool, bool]] = field(default_factory=dict)
    hidden: set[str] = field(default_factory=set)


def nullable(schema: dict) -> dict:
    kind = schema.get("type")
    return {**schema, "type": [kind, "null"]} if isinstance(kind, str) else {"anyOf": [schema, {"type": "null"}]}


def of_object(properties: Mapping[str, dict]) -> dict:
    return {"type": "object", "properties": dict(properties), "required": list(properties)}


def prisma(text: str) -> dict[str, Model]:
    """Models of a schema.prisma; an optional field is nullable and still there."""
    enums = {m[1]: re.findall(r"^\s*(\w+)", m[2], re.M) for m in re.finditer(r"^enum\s+(\w+)\s*\{([^}]*)\}", text, re.M)}
    blocks = {m[1]: m[2] for m in re.finditer(r"^(?:model|type)\s+(\w+)\s*\{([^}]*)\}", text, re.M)}
    out = {}
    for name, body in blocks.items():
        model = out[name] = Model(name)
        for line in body.split("\n"):
            m = re.match(r"\s*(\w+)\s+(\w+)(\[\])?(\?)?", re.sub(r"//.*", "", line))
            if not m or line.strip().startswith("@@"):
                continue
            if m[2] in blocks:
                model.relations[m[1]] = (m[2], bool(m[3]), bool(m[4]))
                continue
            schema = dict(PRISMA.get(m[2], {"type": "string", "enum": enums[m[2]]} if m[2] in enums else {}))
            schema = {"type": "array", "items": schema} if m[3] else schema
            model.scalars[m[1]] = nullable(schema) if m[4] else schema
    return out


def _options(text: str) -> dict[str, str]:
    out = {}
    for entry in split_top(text.strip()[1:-1]) if text.strip().startswith("{") else ():
        key, _, value = entry.partition(":")
        out[string(key.strip()) or key.strip()] = value.strip()
    return out


def projected(models: Mapping[str, Model], name: str, options: str = "", depth: int = 0) -> dict:
    """A Prisma row: select picks, include adds relations to all scalars, omit leaves out; nested alike."""
    model, given = models[name], _options(options)
    if depth > 6:
        return {}

    def relation(key: str, inner: str) -> dict:
        target, many, optional = model.relations[key]
        row = projected(models, target, inner if inner.startswith("{") else "", depth + 1)
        return {"type": "array", "items": row} if many else nullable(row) if optional else row

    if "select" in given:
        out = {}
        for key, value in _options(given["select"]).items():
            if value == "false":
                continue
            if key == "_count":
                picked = _options(_options(value).get("select", "{}")) or model.relations
                out[key] = of_object({r: {"type": "integer"} for r in picked})
            elif key in model.scalars:
                out[key] = model.scalars[key]
            elif key in model.relations:
                out[key] = relation(key, value)
        return of_object(out)
    omitted = {k for k, v in _options(given.get("omit", "{}")).items() if v == "true"}
    out = {k: v for k, v in model.scalars.items() if k not in omitted}
    for key, value in _options(given.get("include", "{}")).items():
        if key == "_count":
            out[key] = of_object({r: {"type": "integer"} for r in model.relations})
        elif key in model.relations and value != "false":
            out[key] = relation(key, value)
    return of_object(out)


def prisma_result(models: Mapping[str, Model], call: str) -> dict | None:
    """The result of prisma.model.method(options); None where it isn't such a call or the model isn't known."""
    m = re.match(r"(?:await\s+)?(?:this\.)?\w+\.(\w+)\.(\w+)\(", call)
    if not m:
        return None
    name = next((n for n in models if n[:1].lower() + n[1:] == m[1]), None)
    if name is None:
        return None
    args = split_top(call[m.end() : closing(call, m.end() - 1)])
    if m[2] in COUNTS:
        return {"type": "integer"}
    if m[2] in WRITES:
        return of_object({"count": {"type": "integer"}})
    if m[2] != "findMany" and m[2] not in ONE_OR_NONE | PRISMA_ROW:
        return None
    row = projected(models, name, args[0] if args else "")
    return {"type": "array", "items": row} if m[2] in MANY else nullable(row) if m[2] in ONE_OR_NONE else row


def mongoose(text: str) -> dict[str, Model]:
    """Models of new Schema({...}) that model('Name', schema) names: _id, version and timestamps included."""
    schemas: dict[str, tuple[str, str]] = {}
    for m in re.finditer(r"(?:const|let|var)\s+(\w+)\s*=\s*new\s+(?:mongoose\.)?Schema(?:<[^>]*>)?\(", text):
        args = split_top(text[m.end() : closing(text, m.end() - 1)])
        schemas[m[1]] = (args[0], args[1] if len(args) > 1 else "")
    out = {}
    for m in re.finditer(r"\bmodel(?:<[^>]*>)?\(\s*['\"](\w+)['\"]\s*,\s*(\w+)", text):
        if m[2] not in schemas:
            continue
        model = out[m[1]] = Model(m[1], {"_id": {"type": "string"}})
        body, options = schemas[m[2]]
        for key, value in _options(body).items():
            many = value.startswith("[")
            inner = value[1:-1].strip() if many else value
            given = _options(inner) if inner.startswith("{") and re.search(r"\btype\s*:", inner) else {"type": inner}
            kind = given["type"]
            if kind.startswith("["):
                many, kind = True, kind[1:-1]
                given = {**given, **(_options(kind) if kind.startswith("{") else {})}
                kind = given.get("type", kind) if kind.startswith("{") else kind
            if "ref" in given and string(given["ref"]):
                model.relations[key] = (string(given["ref"]), many, given.get("required") != "true")
            schema = dict(MONGOOSE.get(kind.rpartition(".")[2], {}))
            if given.get("enum", "").startswith("["):
                schema["enum"] = [string(x) for x in split_top(given["enum"][1:-1])]
            model.scalars[key] = {"type": "array", "items": schema} if many else schema
            if given.get("select") == "false":
                model.hidden.add(key)
        if "timestamps: true" in options:
            model.scalars |= {k: {"type": "string", "format": "date-time"} for k in ("createdAt", "updatedAt")}
        if "versionKey: false" not in options:
            model.scalars["__v"] = {"type": "integer"}
    return out


def mongoose_row(models: Mapping[str, Model], name: str, select: str | None = None, populate: Mapping[str, str | None] | None = None) -> dict:
    """A document: projection by a string ("a b", "-c", "+hidden") and populated paths with their own projections."""
    model = models[name]
    words = (select or "").split()
    chosen = [w for w in words if not w.startswith(("-", "+"))]
    shown = {w[1:] for w in words if w.startswith("+")}
    dropped = {w[1:] for w in words if w.startswith("-")} | (model.hidden - shown)
    keys = [k for k in model.scalars if (k in chosen or k == "_id" if chosen else True) and (k not in dropped or k in chosen)]
    out = {k: model.scalars[k] for k in keys}
    for path, inner in (populate or {}).items():
        if path in model.relations and path in out:
            target, many, optional = model.relations[path]
            row = mongoose_row(models, target, inner) if target in models else {}
            out[path] = {"type": "array", "items": row} if many else nullable(row) if optional else row
    return of_object(out)


def mongoose_result(models: Mapping[str, Model], call: str) -> dict | None:
    """The result of Model.find(...).select(...).populate(...): sort, limit, skip and where don't change its shape."""
    m = re.match(r"(?:await\s+)?(\w+)\.(\w+)\(", call)
    if not m or m[1] not in models:
        return None
    at, select, populate = closing(call, m.end() - 1) + 1, None, {}
    if m[2] == "aggregate":
        return None
    while c := re.compile(r"\s*\.\s*(\w+)\(").match(call, at):
        end = closing(call, c.end() - 1)
        args = split_top(call[c.end() : end])
        if c[1] == "select" and args:
            given = string(args[0])
            select = given if given is not None else " ".join(("" if v in ("1", "true") else "-") + k for k, v in _options(args[0]).items())
        elif c[1] == "populate" and args:
            options = _options(args[0]) if args[0].startswith("{") else {}
            path = string(options["path"]) if options else string(args[0])
            inner = string(options.get("select")) if options else string(args[1]) if len(args) > 1 else None
            if path:
                populate |= {p: inner for p in path.split()}
        at = end + 1
    if m[2] in COUNTS:
        return {"type": "integer"}
    if m[2] == "exists":
        return nullable(of_object({"_id": {"type": "string"}}))
    if m[2] == "distinct":
        return {"type": "array", "items": {}}
    if m[2] in ("updateOne", "updateMany", "deleteOne", "deleteMany"):
        name = "deletedCount" if m[2].startswith("delete") else "modifiedCount"
        return of_object({"acknowledged": {"type": "boolean"}, name: {"type": "integer"}})
    if m[2] not in MANY | ONE_OR_NONE | MODEL_ROW:
        return None
    row = mongoose_row(models, m[1], select, populate)
    return {"type": "array", "items": row} if m[2] in MANY else nullable(row) if m[2] in ONE_OR_NONE else row


def sequelize(text: str) -> dict[str, Model]:
    """Models of sequelize.define('name', {...}) and Model.init({...})."""
    out = {}
    for m in re.finditer(r"\.define\(\s*['\"](\w+)['\"]\s*,|\b(\w+)\.init\(", text):
        start = m.end() if m[1] else m.end()
        brace = text.find("{", start)
        name = m[1] or m[2]
        model = out[name] = Model(name, {"id": {"type": "integer"}})
        for key, value in _options(text[brace : closing(text, brace) + 1]).items():
            given = _options(value) if value.startswith("{") else {"type": value}
            kind = re.search(r"DataTypes\.(\w+)|Sequelize\.(\w+)", given.get("type", ""))
            schema = dict(SEQUELIZE.get((kind[1] or kind[2]) if kind else "", {}))
            model.scalars[key] = schema if given.get("allowNull") == "false" or given.get("primaryKey") == "true" else nullable(schema) if schema else schema
    return out


def sequelize_result(models: Mapping[str, Model], call: str) -> dict | None:
    """The result of Model.findAll({attributes}): a list, pairs as [column, alias], or {exclude}."""
    m = re.match(r"(?:await\s+)?(\w+)\.(\w+)\(", call)
    if not m or m[1] not in models:
        return None
    if m[2] == "count":
        return {"type": "integer"}
    if m[2] not in {"findAll", "findAndCountAll"} | ONE_OR_NONE | MODEL_ROW:
        return None
    args = split_top(call[m.end() : closing(call, m.end() - 1)])
    chosen = _options(args[-1]).get("attributes", "") if args and args[-1].startswith("{") else ""
    own = models[m[1]].scalars
    if chosen.startswith("["):
        out = {}
        for part in split_top(chosen[1:-1]):
            pair = split_top(part[1:-1]) if part.startswith("[") else [part, part]
            column, alias = string(pair[0]), string(pair[-1])
            if alias:
                out[alias] = own.get(column or "", {})
    else:
        excluded = set(re.findall(r"['\"](\w+)['\"]", _options(chosen).get("exclude", ""))) if chosen else set()
        out = {k: v for k, v in own.items() if k not in excluded}
    row = of_object(out)
    if m[2] == "findAndCountAll":
        return of_object({"count": {"type": "integer"}, "rows": {"type": "array", "items": row}})
    return {"type": "array", "items": row} if m[2] in MANY else nullable(row) if m[2] in ONE_OR_NONE else row
