"""Go: gin, echo, fiber, chi, gorilla/mux and net/http, by routers that flow through variables, closures and helpers."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from corvid.packs import Found
from corvid.packs.routes import VERBS, best, candidate, firsts, joined, names_in, parameter, response
from corvid.packs.scanner import calls, closing, line_at, object_schema, split_top, status, string, template, without_comments

#: Weights of the score that Go packs choose by: responses, parameters, body.
WEIGHTS = (3, 2, 4)
SCALARS = {"string": {"type": "string"}, "bool": {"type": "boolean"}, "float32": {"type": "number", "format": "float"}, "float64": {"type": "number", "format": "double"}, "any": {}, "interface{}": {}, "error": {"type": "string"}, "time.Time": {"type": "string", "format": "date-time"}, "uuid.UUID": {"type": "string", "format": "uuid"}, "[]byte": {"type": "string", "contentEncoding": "base64"}}
SCALARS |= {n: {"type": "integer", "format": "int64" if "64" in n else "int32"} for n in ("int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64")}


@dataclass
class Dialect:
    """How a framework writes routers: constructors, verbs, and what groups, mounts and closures are called."""

    paths: str
    constructors: str
    verbs: dict[str, tuple[str, ...]]
    groups: tuple[str, ...] = ("Group",)
    closures: tuple[str, ...] = ()
    mounts: tuple[str, ...] = ()
    prefix: str = ""
    methods_chain: bool = False
    hint: str = ""


def _verbs(style) -> dict[str, tuple[str, ...]]:
    return {style(v): (v,) for v in VERBS}


DIALECTS = {
    "gin": Dialect("gin", r"gin\.(?:Default|New)\(", {**_verbs(str.upper), "Any": VERBS}),
    "echo": Dialect("echo", r"echo\.New\(", {**_verbs(str.upper), "Any": VERBS}),
    "fiber": Dialect("fiber", r"fiber\.New\(", {**_verbs(str.capitalize), "All": VERBS}, groups=("Group", "Route")),
    "chi": Dialect("chi", r"chi\.NewRouter\(|chi\.NewMux\(", {**_verbs(str.capitalize)}, groups=("With",), closures=("Route", "Group"), mounts=("Mount",)),
    "gorillamux": Dialect("gorillamux", r"mux\.NewRouter\(", {"HandleFunc": (), "Handle": ()}, groups=(), prefix="PathPrefix", methods_chain=True),
    "nethttp": Dialect("nethttp", r"http\.NewServeMux\(", {"HandleFunc": (), "Handle": ()}, groups=()),
}


@dataclass
class Function:
    file: str
    name: str
    parameters: list[str]
    start: int
    end: int


@dataclass
class Sources:
    texts: dict[str, str]
    functions: dict[str, Function] = field(default_factory=dict)
    structs: dict[str, str] = field(default_factory=dict)
    components: dict[str, object] = field(default_factory=dict)


def read(files: Mapping[str, str]) -> Sources:
    out = Sources({p: without_comments(t) for p, t in files.items() if p.endswith(".go")})
    for path, text in out.texts.items():
        for m in re.finditer(r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(", text, re.M):
            close = closing(text, m.end() - 1)
            body = text.find("{", close)
            if body >= 0:
                names = [p.split()[0] for p in split_top(text[m.end() : close]) if p]
                out.functions.setdefault(m[1], Function(path, m[1], names, body + 1, closing(text, body)))
        for m in re.finditer(r"^type\s+([A-Za-z_]\w*)\s+struct\s*\{", text, re.M):
            out.structs.setdefault(m[1], text[m.end() : closing(text, m.end() - 1)])
    return out


def schema_of(sources: Sources, kind: str, depth: int = 0) -> dict:
    kind = kind.strip()
    if depth > 6:
        return {}
    if kind in SCALARS:
        return dict(SCALARS[kind])
    if kind.startswith("*"):
        inner = schema_of(sources, kind[1:], depth + 1)
        return {**inner, "type": [inner["type"], "null"]} if isinstance(inner.get("type"), str) else {"anyOf": [inner, {"type": "null"}]} if inner else {}
    if m := re.match(r"\[(\d*)\]", kind):
        size = {"minItems": int(m[1]), "maxItems": int(m[1])} if m[1] else {}
        return {"type": "array", "items": schema_of(sources, kind[m.end() :], depth + 1), **size}
    if m := re.match(r"map\[[^\]]+\]", kind):
        return {"type": "object", "additionalProperties": schema_of(sources, kind[m.end() :], depth + 1)}
    name = kind.rpartition(".")[2]
    if name not in sources.structs:
        return {}
    if name not in sources.components:
        sources.components[name] = {}
        properties, required = {}, []
        for line in sources.structs[name].split("\n"):
            m = re.match(r"\s*([A-Z]\w*)\s+([^`\s][^`]*?)\s*(?:`([^`]*)`)?\s*$", line)
            embedded = re.match(r"\s*\*?([A-Za-z_.]*\w)\s*$", line)
            if embedded and not m:
                schema_of(sources, embedded[1], depth + 1)
                inner = sources.components.get(embedded[1].rpartition(".")[2], {})
                properties |= inner.get("properties", {})
                required += inner.get("required", [])
            if not m:
                continue
            tag = re.search(r'(?:json|form):"([^",]*)(,[^"]*)?"', m[3] or "")
            if tag and tag[1] == "-":
                continue
            wire = tag[1] if tag and tag[1] else m[1]
            properties[wire] = schema_of(sources, m[2], depth + 1)
            if not (tag and tag[2] and "omitempty" in tag[2]) and not m[2].startswith("*"):
                required.append(wire)
        sources.components[name] = {"type": "object", "properties": properties, **({"required": required} if required else {})}
    return {"$ref": f"#/components/schemas/{name}"}


def _value_schema(sources: Sources, text: str, body: str) -> dict | None:
    """The schema of an expression: a literal, a struct literal, or a variable whose type is written in the body."""
    literal = object_schema(text)
    if literal is not None:
        return literal
    if m := re.match(r"&?((?:\[\])?[A-Za-z_][\w.]*)\s*\{", text):
        return schema_of(sources, m[1]) or None
    name = text.strip().lstrip("&")
    if re.fullmatch(r"[A-Za-z_]\w*", name):
        if m := re.search(rf"\bvar\s+{name}\s+([^\s=]+)|\b{name}\s*:?=\s*&?((?:\[\])?[A-Za-z_][\w.]*)\s*\{{", body):
            return schema_of(sources, m[1] or m[2]) or None
    return None


def describe(sources: Sources, body: str, route: dict) -> None:
    """Parameters, body and responses that a handler's code shows."""
    for c in calls(body):
        first = string(c.args[0]) if c.args else None
        where = {"Query": "query", "DefaultQuery": "query", "QueryParam": "query", "GetQuery": "query", "FormValue": "query", "GetHeader": "header", "Cookie": "cookie"}.get(c.name)
        if c.name == "Get" and re.search(r"Header(?:\(\))?$", c.receiver):
            where = "header"
        elif c.name == "Get" and re.search(r"Query\(\)$", c.receiver):
            where = "query"
        if where and first:
            route["parameters"].append(parameter(first, where, {"type": "string"}, False))
        elif c.name in ("ShouldBindJSON", "BindJSON", "ShouldBind", "Bind", "BodyParser", "Decode") and c.args and c.args[-1].startswith("&"):
            schema = _value_schema(sources, c.args[-1], body) or {}
            route["request_body"] = {"required": True, "content": [{"media_type": "application/json", "schema": schema}]}
        elif c.name in ("JSON", "IndentedJSON", "AbortWithStatusJSON", "String", "HTML", "XML") and len(c.args) == 2 and (code := status(c.args[0])):
            media = {"String": "text/plain", "HTML": "text/html"}.get(c.name, "application/json")
            route["responses"].append(response(code, _value_schema(sources, c.args[1], body) or {}, media))
        elif c.name == "JSON" and len(c.args) == 1:
            code = re.search(r"Status\(([^()]+)\)\s*\.?$", body[: c.open].rstrip("(").removesuffix("JSON"))
            route["responses"].append(response((status(code[1]) if code else None) or 200, _value_schema(sources, c.args[0], body) or {}))
        elif c.name in ("NoContent", "Status", "AbortWithStatus", "WriteHeader", "SendStatus") and len(c.args) == 1 and (code := status(c.args[0])):
            if c.name != "Status" or not re.match(r"\s*\.", body[c.end + 1 :]):  # Status(n).JSON(...) is read at its end
                route["responses"].append(response(code))
        elif c.name == "Error" and c.receiver == "http" and len(c.args) == 3:
            route["responses"].append(response(status(c.args[2]) or 500, {"type": "string"}, "text/plain"))
        elif c.name == "Encode" and c.args:
            route["responses"].append(response(200, _value_schema(sources, c.args[0], body) or {}))
        elif c.name == "Write" and c.args and c.args[0].startswith("[]byte("):
            route["responses"].append(response(200, {"type": "string"}, "text/plain"))
        elif c.name == "ServeFile":
            route["responses"].append(response(200, {"type": "string", "format": "binary"}, "application/octet-stream"))
    kept: dict = {}
    for p in route["parameters"]:
        kept.setdefault((p["in"], p["name"]), p)
    route["parameters"] = list(kept.values())
    seen: dict = {}
    for r in route["responses"]:
        seen.setdefault(r["status_code"], r)
    route["responses"] = list(seen.values())


class Walker:
    """Follows routers through one framework's code."""

    def __init__(self, framework: str, sources: Sources, found: Found):
        self.framework, self.dialect, self.sources, self.found = framework, DIALECTS[framework], sources, found
        self.routes: list[dict] = []
        self.visited: set = set()

    def body(self, file: str, start: int, end: int, env: dict[str, str]) -> None:
        text, d = self.sources.texts[file], self.dialect
        env = dict(env)
        skip = start
        for c in calls(text, start, end):
            if c.at < skip:
                continue
            line_start = text.rfind("\n", 0, c.at) + 1
            target = re.match(r"\s*(?:var\s+)?([A-Za-z_]\w*)\s*:?=\s*", text[line_start : c.at + len(c.receiver)])
            receiver = c.receiver
            if re.match(d.constructors, f"{c.receiver}.{c.name}("):
                if target:
                    env[target[1]] = ""
            elif receiver in env and c.name in d.groups and (c.name == "With" or (c.args and string(c.args[0]) is not None)):
                prefix = env[receiver] if c.name == "With" else joined(env[receiver], template(string(c.args[0]), d.paths))
                if target:
                    env[target[1]] = prefix
                elif (link := re.match(r"\s*\.\s*([A-Za-z]\w*)\s*\(", text[c.end + 1 :])) and link[1] in d.verbs:
                    opened = c.end + 1 + link.end() - 1
                    self.route(file, c.at, prefix, link[1], split_top(text[opened + 1 : closing(text, opened)]), opened)
                if c.args and c.args[-1].startswith("func("):
                    skip = self.closure(file, c, prefix, env)
            elif receiver in env and c.name in d.closures and c.args and c.args[-1].startswith("func("):
                raw = string(c.args[0]) if len(c.args) > 1 else ""
                if raw is None:
                    self.found.remark("dynamic-path", "a group's path isn't constant", file, line_at(text, c.at))
                    continue
                skip = self.closure(file, c, joined(env[receiver], template(raw, d.paths)) if raw else env[receiver], env)
            elif receiver in env and c.name in d.mounts and len(c.args) == 2 and string(c.args[0]) is not None:
                name = re.match(r"(?:[A-Za-z_]\w*\.)*([A-Za-z_]\w*)\(", c.args[1])
                if name and name[1] in self.sources.functions:
                    self.function(name[1], {}, joined(env[receiver], template(string(c.args[0]), d.paths)))
            elif receiver in env and d.prefix and c.name == d.prefix and c.args and string(c.args[0]) is not None:
                if target and re.match(r"\s*\.\s*Subrouter\(", text[c.end + 1 :]):
                    env[target[1]] = joined(env[receiver], template(string(c.args[0]), d.paths))
            elif c.name in d.verbs and (receiver in env or (self.framework == "nethttp" and receiver == "http")):
                self.route(file, c.at, env.get(receiver, ""), c.name, c.args, c.open)
                if c.args and c.args[-1].startswith("func("):
                    skip = c.end
            elif c.name in self.sources.functions and any(a in env for a in c.args):
                callee = self.sources.functions[c.name]
                self.function(c.name, {p: env[a] for p, a in zip(callee.parameters, c.args) if a in env})

    def closure(self, file: str, c, prefix: str, env: dict) -> int:
        text = self.sources.texts[file]
        at = text.rfind("func(", c.open, c.end) if text[c.open : c.end].count("func(") == 1 else text.find("func(", c.open, c.end)
        close = closing(text, at + 4)
        name = (split_top(text[at + 5 : close]) or [""])[0].split(" ")[0]
        body = text.find("{", close)
        end = closing(text, body)
        self.body(file, body + 1, end, {**env, name: prefix})
        return end

    def function(self, name: str, env: dict[str, str], base: str | None = None) -> None:
        f = self.sources.functions[name]
        key = (name, tuple(sorted(env.items())), base)
        if key in self.visited:
            return
        self.visited.add(key)
        if base is None:
            self.body(f.file, f.start, f.end, env)
            return
        before = len(self.routes)
        self.body(f.file, f.start, f.end, env)
        for r in self.routes[before:]:  # a router made inside is mounted under the base
            r["path"] = r["full_path"] = joined(base, r["full_path"])

    def route(self, file: str, at: int, prefix: str, verb: str, args: list[str], opened: int) -> None:
        text, d = self.sources.texts[file], self.dialect
        raw = string(args[0]) if args else None
        if raw is None:
            self.found.remark("dynamic-path", f"the path of a {verb} route isn't constant", file, line_at(text, at))
            return
        methods: tuple[str, ...] = d.verbs[verb]
        if self.framework == "nethttp":
            m = re.match(r"\s*([A-Z]+)\s+(?=\S)", raw)
            methods = (m[1].lower(),) if m else VERBS
            raw = re.sub(r"\{\$\}$", "", raw)
        elif d.methods_chain:
            m = re.match(r"\s*\.\s*Methods\(([^)]*)\)", text[closing(text, opened) + 1 :])
            named = [s.strip(' "').replace("http.Method", "").lower() for s in m[1].split(",")] if m else []
            methods = tuple(named) or VERBS
        handler = args[-1]
        if "WrapHandler" in handler:
            return
        if handler.startswith("func("):
            code = handler
        else:
            name = re.match(r"(?:[A-Za-z_]\w*\.)*([A-Za-z_]\w*)", handler)
            f = self.sources.functions.get(name[1]) if name else None
            code = self.sources.texts[f.file][f.start : f.end] if f else None
        for method in methods:
            full = joined(prefix, template(raw, d.paths))
            route = candidate(method, full, file, line_at(text, at))
            route["parameters"] = [parameter(n, "path", {"type": "string"}, True) for n in names_in(full)]
            if code is not None:
                describe(self.sources, code, route)
            if not route["responses"]:
                route["gaps"].append("response-unknown")
            self.routes.append(route)


def pack(framework: str):
    def extract(files: Mapping[str, str]) -> Found:
        found = Found()
        sources = read(files)
        walker = Walker(framework, sources, found)
        mounted = {m[1] for t in sources.texts.values() for m in re.finditer(r"\.Mount\([^,]+,\s*(?:\w+\.)*(\w+)\(", t)}
        for name, f in sources.functions.items():
            text = sources.texts[f.file][f.start : f.end]
            if name not in mounted and (re.search(DIALECTS[framework].constructors, text) or (framework == "nethttp" and "http.Handle" in text)):
                walker.function(name, {})
        found.routes = firsts(walker.routes)[0] if framework == "chi" else best(walker.routes, WEIGHTS)
        found.components = sources.components
        return found

    return extract


PACKS = {name: pack(name) for name in DIALECTS}
