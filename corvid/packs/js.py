"""JavaScript and TypeScript: express, koa, hono, elysia, fastify, nest and nextjs, without a type checker.

What a type checker would prove (inferred request and response types) is left as a gap.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from corvid.packs import Found, validators
from corvid.packs.declared import Declared, entries
from corvid.packs.results import Results, returned
from corvid.packs.routes import VERBS, best, candidate, firsts, joined, names_in, parameter, response
from corvid.packs.scanner import calls, closing, line_at, object_schema, split_top, status, string, template, without_comments
from corvid.packs.types import TypeScript

SUFFIXES = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
NEXT_ROUTE = re.compile(r"(?:^|/)app/.*route\.(?:ts|tsx|js|jsx|mjs|cjs)$|^route\.(?:ts|js)$")
NEXT_PAGE = re.compile(r"(?:^|/)pages/api/.*\.(?:ts|tsx|js|jsx|cjs)$")


@dataclass
class Style:
    """How a framework makes routers and names their parts."""

    paths: str
    app: str
    router: str
    mount: tuple[str, ...]
    all_verbs: tuple[str, ...]
    all_name: str = "all"
    apps_only: bool = True
    best: bool = False


STYLES = {
    "express": Style("express", r"\bexpress\s*\(\s*\)", r"(?:\bexpress\s*\.\s*)?\bRouter\s*\(", ("use",), ("get",), best=True),
    "koa": Style("hono", r"\bnew\s+Koa\b", r"\bnew\s+(?:Koa)?Router\b", ("use",), VERBS, apps_only=False),
    "hono": Style("hono", r"\bnew\s+(?:OpenAPI)?Hono\b", r"\bnew\s+(?:OpenAPI)?Hono\b", ("route",), VERBS, apps_only=False),
    "elysia": Style("hono", r"\bnew\s+Elysia\b", r"\bnew\s+Elysia\b", ("use", "group"), VERBS, apps_only=False),
    "fastify": Style("hono", r"\b[Ff]astify\s*\(|require\(\s*['\"]fastify['\"]\s*\)\s*\(", r"\b[Ff]astify\s*\(", ("register",), VERBS, best=True),
}


class Modules:
    """A project's scripts with comments blanked, and how their names refer to each other."""

    def __init__(self, files: Mapping[str, str]):
        self.texts = {p: without_comments(t) for p, t in files.items() if p.endswith(SUFFIXES) and not p.endswith(".d.ts")}

    def imported(self, path: str, name: str) -> tuple[str, str] | None:
        """(file, exported name) of a name that a file imports by a relative path."""
        text = self.texts[path]
        n = re.escape(name)
        m = re.search(rf"import\s+(?:type\s+)?(?:({n})\b|\*\s+as\s+({n})\b|(?:\w+\s*,\s*)?\{{[^}}]*?\b(?:(\w+)\s+as\s+)?({n})\b[^}}]*\}})[^;\n]*?from\s*['\"]([^'\"]+)['\"]", text)
        if m:
            target, exported = m[5], "default" if m[1] or m[2] else m[3] or name
        else:
            m = re.search(rf"(?:const|let|var)\s+(?:{n}|\{{[^}}]*\b{n}\b[^}}]*\}})\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)", text)
            if not m:
                return None
            target, exported = m[1], name if "{" in m[0] else "default"
        if not target.startswith("."):
            return None
        base = posixpath.normpath(posixpath.join(posixpath.dirname(path), re.sub(r"\.(?:js|mjs|cjs)$", "", target)))
        found = next((c for s in ("", *SUFFIXES, *(f"/index{x}" for x in SUFFIXES)) if (c := base + s) in self.texts), None)
        return (found, exported) if found else None

    def exported(self, path: str, name: str) -> str:
        """The local name behind an exported one."""
        text = self.texts[path]
        if name == "default":
            m = re.search(r"export\s+default\s+(?:async\s+)?(?:function\s+)?(\w+)|module\.exports\s*=\s*(\w+)", text)
            return (m[1] or m[2]) if m else name
        m = re.search(rf"\b(\w+)\s+as\s+{re.escape(name)}\b", text)
        return m[1] if m else name

    def place(self, path: str, name: str) -> tuple[str, str]:
        found = self.imported(path, name)
        return (found[0], self.exported(*found)) if found else (path, name)

    def function(self, path: str, expression: str) -> str | None:
        """The text of a handler: the expression itself if it is a function, else the one that it names."""
        e = expression.strip()
        if "=>" in e or re.match(r"(?:async\s+)?function\b", e):
            return e
        m = re.match(r"(?:([A-Za-z_$]\w*)\.)?([A-Za-z_$]\w*)", e)
        if not m:
            return None
        file, name = self.place(path, m[1] or m[2])
        if m[1]:
            name = m[2]
        text = self.texts[file]
        d = re.search(rf"(?:function\s+{re.escape(name)}\s*\(|(?:const|let|var|exports\.|exports\s*\.)\s*{re.escape(name)}\s*(?::[^=]+)?=\s*|^\s*(?:async\s+|static\s+|public\s+)*{re.escape(name)}\s*\((?=[^;]*\{{))", text, re.M)
        if not d:
            return None
        brace = text.find("{", text.find("=>", d.start()) if "=>" in text[d.start() : d.start() + 400] and "function" not in d[0] else closing(text, text.find("(", d.start())))
        return text[d.start() : closing(text, brace) + 1] if brace >= 0 else text[d.start() : d.start() + 400]


#: Names of middleware that asks for credentials, in lower case and letters alone.
AUTH = re.compile(r"(^auth$|^authenticate|authorization|^jwt|bearer|^protect|guard|requireauth|isauth|ensureauth|authmiddleware|withauth)", re.I)
_LIBRARY = {"z": validators.zod, "Joi": validators.joi, "joi": validators.joi, "yup": validators.yup, "Yup": validators.yup, "Type": validators.typebox, "t": validators.typebox, "S": validators.fluent}
_PARSES = r"(?:parse|safeParse|parseAsync|safeParseAsync|validate|validateAsync|validateSync|attempt|cast)"


def asks_credentials(middleware: str) -> bool:
    """Whether a middleware's text is one that asks for a token: passport's jwt strategies, or by its name."""
    if re.search(r"\.authenticate\(\s*['\"][^'\"]*(?:jwt|bearer)", middleware, re.I):
        return True
    name = re.match(r"[\w$.]+", middleware.strip())
    return bool(name and "=>" not in middleware and AUTH.search(re.sub(r"[^A-Za-z]", "", name[0]).lower()))


def _statement(text: str, at: int) -> str:
    """The chain of calls that begins at `at`."""
    end = at
    while m := re.compile(r"\s*\.?\s*[A-Za-z_$][\w$]*").match(text, end):
        end = m.end()
        if end < len(text) and text[end] == "(":
            end = closing(text, end) + 1
        if not re.compile(r"\s*\.").match(text, end):
            break
    return text[at:end]


class Validators:
    """Schemas that validators declare, by name in each file, read on demand."""

    def __init__(self, modules: Modules):
        self.modules, self.known = modules, {}

    def named(self, path: str) -> dict[str, str]:
        if path not in self.known:
            text = self.modules.texts[path]
            found = re.finditer(rf"(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?=(?:{'|'.join(_LIBRARY)})\s*\.)", text)
            self.known[path] = {m[1]: _statement(text, m.end()) for m in found}
            if re.search(r"['\"]arktype['\"]", text):
                self.known[path] |= {m[1]: _statement(text, m.end()) for m in re.finditer(r"(?:const|let|var)\s+(\w+)\s*=\s*(?=type\s*\()", text)}
        return self.known[path]

    def schema(self, path: str, expression: str) -> dict | None:
        """The schema of an expression: a chain of a known library, or a name that stands for one here or where it's from."""
        e = expression.strip()
        if re.match(r"type\s*\(", e):
            return validators.arktype_call(e)
        head = re.match(r"([A-Za-z_$][\w$]*)(\s*\.)?", e)
        if not head:
            return None
        if head[2] and head[1] in _LIBRARY:
            return _LIBRARY[head[1]](e) if head[1] in ("S",) else _LIBRARY[head[1]](e, self.named(path))
        file, name = self.modules.place(path, head[1])
        text = self.named(file).get(name)
        return self.schema(file, text) if text else None

    def apply(self, path: str, code: str, route: dict) -> None:
        """What a text (a handler, or middleware among a route's arguments) says about body, query and path parameters."""
        places = {"body": "body", "json": "body", "form": "body", "query": "query", "params": "path", "param": "path", "headers": "header", "header": "header"}
        for m in re.finditer(rf"\.\s*{_PARSES}\(\s*(?:await\s+)?(?:req|request|ctx\.request|ctx|c\.req)\.(body|query|params|json\(\))", code):
            start = _chain_start(code, m.start())
            self.said(route, places[m[1].removesuffix("()")], self.schema(path, code[start : m.start()]))
        for m in re.finditer(r"(?<![\w$.])([A-Za-z_$]\w*)\(\s*(?:await\s+)?(?:req|request|ctx\.request|ctx|c\.req)\.(body|query|params|json\(\))\s*\)", code):
            file, name = self.modules.place(path, m[1])  # a type is called with what it checks
            if self.named(file).get(name, "").startswith("type"):
                self.said(route, places[m[2].removesuffix("()")], self.schema(path, m[1]))
        for m in re.finditer(r"\b(?:validate\w*|celebrate|validator)\(\s*(\{)?", code):
            args = split_top(code[code.index("(", m.start()) + 1 : closing(code, code.index("(", m.start()))])
            for entry in split_top(args[0].strip()[1:-1]) if m[1] and args else ():
                key, _, value = entry.partition(":")
                place = places.get(re.sub(r"[^a-z]", "", key.lower().replace("segments", "")))
                self.said(route, place, self.schema(path, value) or (validators.joi(value) if value.strip().startswith("{") else None))
            if not m[1] and args:
                self.said(route, "body", self.schema(path, args[0]))
        for m in re.finditer(r"\b\w*[vV]alidator\(\s*['\"](\w+)['\"]\s*,\s*", code):  # a context framework's own: place, schema
            self.said(route, places.get(m[1]), self.schema(path, _statement(code, m.end())))
        fields: dict = {}
        for m in re.finditer(r"(?<![\w.])(body|query|param|header|cookie|check)\(\s*['\"]", code):
            found = validators.express_validator(_statement(code, m.start()))
            if found and found[0] == "body":
                fields[found[1]] = (found[2], found[3])
            elif found:
                self._parameter(route, found[0], found[1], found[2], found[3])
        if fields:
            needed = [n for n, (_, r) in fields.items() if r]
            self.said(route, "body", {"type": "object", "properties": {n: f for n, (f, _) in fields.items()}, **({"required": needed} if needed else {})})

    @staticmethod
    def _parameter(route: dict, place: str, name: str, schema: dict, needed: bool) -> None:
        own = next((p for p in route["parameters"] if (p["in"], p["name"]) == (place, name)), None)
        if own:
            own.update(schema=schema, required=needed or place == "path")
        elif place != "path":
            route["parameters"].append(parameter(name, place, schema, needed))

    def said(self, route: dict, place: str | None, schema: dict | None) -> None:
        if schema is None or place is None:
            return
        if place == "body":
            route["request_body"] = {"required": True, "content": [{"media_type": "application/json", "schema": schema}]}
        for name, each in schema.get("properties", {}).items() if place != "body" else ():
            self._parameter(route, place, name, each, name in schema.get("required", ()))


def _chain_start(code: str, end: int) -> int:
    """Where the chain of names and calls that ends at `end` begins."""
    at = end
    while at > 0:
        before = code[:at].rstrip()
        if before.endswith(")"):
            depth, at = 0, len(before)
            while at > 0:
                at -= 1
                depth += (before[at] == ")") - (before[at] == "(")
                if depth == 0:
                    break
        elif m := re.search(r"[A-Za-z_$][\w$]*$", before):
            at = m.start()
            if not code[:at].rstrip().endswith("."):
                return at
        elif before.endswith("."):
            at = len(before) - 1
        else:
            return at
    return at


def describe(code: str | None, route: dict, results: Results | None = None) -> None:
    """Parameters, body and responses in a handler's text, for request and context styles alike."""
    if code is None:
        route["gaps"].append("response-unknown")
        return
    known_rows = (lambda e: results.schema(code, e)) if results else None
    known = {(p["in"], p["name"]) for p in route["parameters"]}

    def add(name: str, where: str, schema=None):
        if (where, name) not in known and not (where == "path"):
            known.add((where, name))
            route["parameters"].append(parameter(name, where, schema or {"type": "string"}, False))

    for m in re.finditer(r"\b(?:req|request|ctx|c|context)(?:\.request|\.req)?\.(query|headers|cookies)(?:\.([A-Za-z_$][\w$]*)|\[\s*['\"]([^'\"]+)['\"]\s*\]|\(\s*['\"]([^'\"]+)['\"]\s*\))", code):
        add(m[2] or m[3] or m[4], {"query": "query", "headers": "header", "cookies": "cookie"}[m[1]])
    for m in re.finditer(r"\b(?:req|request|c\.req)\.(?:get|header)\(\s*['\"]([^'\"]+)['\"]\s*\)", code):
        add(m[1].lower(), "header")
    for m in re.finditer(r"\{([^{}]*)\}\s*=\s*(?:await\s+)?(?:req|request|ctx|ctx\.request|c\.req)\.(query|body)\b", code):
        names = [re.split(r"[:=]", x)[0].strip() for x in m[1].split(",") if x.strip() and not x.strip().startswith("...")]
        if m[2] == "query":
            for n in names:
                add(n, "query")
        else:
            route["request_body"] = _body({n: {} for n in names})
    fields = dict.fromkeys(m[1] for m in re.finditer(r"\b(?:req|request|ctx\.request)\.body\.([A-Za-z_$][\w$]*)", code))
    if fields:
        route["request_body"] = _body({**{n: {} for n in fields}, **((route["request_body"] or {}).get("content", [{}])[0].get("schema", {}).get("properties", {}))})
    elif route["request_body"] is None and re.search(r"\b(?:req|request|ctx\.request)\.body\b|\bc\.req\.json\(|\brequest\.json\(", code):
        route["request_body"] = _body(None)
    for c in calls(code):
        chain = f"{c.receiver}.{c.name}"
        before = re.search(r"\.(?:status|code|sendStatus)\(\s*([^()]+)\s*\)\s*\.?\s*$", code[max(0, c.at - 60) : c.at + len(c.receiver)])
        stated = re.search(r"(?:status|code)\(\s*([\w.]+)\s*\)$", c.receiver) or before
        code_ = status(stated[1]) if stated else None
        if c.name in ("json", "send") and (re.match(r"(?:res|response|reply|c|ctx|NextResponse|Response)\b", chain) or before):
            given = re.search(r"status\s*:\s*(\d{3})", c.args[1]) if len(c.args) > 1 else None
            code_ = code_ or (int(given[1]) if given else None) or (status(c.args[1]) if len(c.args) > 1 else None) or 200
            schema = object_schema(c.args[0], known=known_rows) if c.args else None
            text = c.name == "send" and (schema or {}).get("type") == "string"
            if c.args or c.name == "json":
                route["responses"].append(response(code_, schema if schema is not None else {}, "text/html" if text else "application/json"))
            else:
                route["responses"].append(response(code_))
        elif c.name in ("text", "html") and c.receiver in ("c", "ctx"):
            route["responses"].append(response((status(c.args[1]) if len(c.args) > 1 else None) or 200, {"type": "string"}, f"text/{'html' if c.name == 'html' else 'plain'}"))
        elif c.name in ("sendStatus",) and c.args and status(c.args[0]):
            route["responses"].append(response(status(c.args[0])))
        elif c.name == "end" and code_:
            route["responses"].append(response(code_))
        elif c.name == "redirect" and re.match(r"(?:res|ctx|c|reply)\b", chain):
            route["responses"].append(response(302))
    for m in re.finditer(r"\bctx\.body\s*=\s*", code):
        rest = code[m.end() :]
        literal = rest[: closing(rest, 0) + 1] if rest[:1] in "{[" else re.split(r"[;\n]", rest)[0]
        stated = re.search(r"ctx\.status\s*=\s*(\d{3})", code)
        route["responses"].append(response(int(stated[1]) if stated else 200, object_schema(literal, known=known_rows) or {}))
    if re.search(r"text/event-stream", code):
        route["x-protocol"] = "sse"
        route["responses"].append(response(200, None, "text/event-stream"))
    seen: dict = {}
    for r in route["responses"]:
        seen.setdefault(r["status_code"], r)
    route["responses"] = list(seen.values())
    if not route["responses"]:
        route["gaps"].append("response-unknown")


def _body(properties: dict | None) -> dict:
    schema = {} if properties is None else {"type": "object", "properties": properties}
    return {"required": True, "content": [{"media_type": "application/json", "schema": schema}]}


def routers(framework: str):
    style = STYLES[framework]

    def extract(files: Mapping[str, str]) -> Found:
        found = Found()
        modules = Modules(files)
        checks, results = Validators(modules), Results(files, modules.texts)
        declared = Declared(modules, checks)
        around: list[tuple[tuple[str, str], str, int, str, str]] = []  # middleware: owner, file, place, scope, text
        made: dict[tuple[str, str], dict] = {}
        mounts: dict[tuple[str, str], list[tuple[tuple[str, str], str]]] = {}
        sites: list[tuple[tuple[str, str], str, str, int, list[str]]] = []
        for path, text in modules.texts.items():
            for m in re.finditer(r"(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:await\s+)?", text):
                rest = text[m.end() : m.end() + 200]
                for kind, pattern in (("app", style.app), ("router", style.router)):
                    if re.match(pattern, rest):
                        prefix = re.search(r"\b(?:prefix|basePath)\s*:\s*['\"]([^'\"]+)", rest.split("\n")[0]) or re.search(r"\.basePath\(\s*['\"]([^'\"]+)", rest.split("\n")[0])
                        made.setdefault((path, m[1]), {"app": kind == "app", "prefix": prefix[1] if prefix else "", "line": line_at(text, m.start())})
            if framework == "fastify":  # plugins: functions whose first parameter is an instance
                for m in re.finditer(r"(?:export\s+default\s+)?(?:async\s+)?function\s*(\w*)\s*\(\s*(\w+)\s*[,:)]|(?:const|let|var)\s+(\w+)[^=\n]*=\s*(?:async\s*)?\(?\s*(\w+)\s*[,:)][^=]*=>", text):
                    instance = m[2] or m[4]
                    if re.search(rf"\b{instance}\s*\.\s*(?:get|post|put|patch|delete|route|register)\s*\(", text[m.end() :]):
                        made.setdefault((path, instance), {"app": False, "prefix": "", "line": line_at(text, m.start()), "plugin": m[1] or m[3] or "default"})
        for path, text in modules.texts.items():  # only now are all routers known
            for c in calls(text):
                owner = (path, c.receiver.split(".")[0].removesuffix("()"))
                if owner not in made and framework == "elysia" and not c.receiver and c.name in VERBS:
                    owner = next((k for k in made if k[0] == path), owner)
                if owner not in made:
                    continue
                chain_path = re.search(r"\.route\(\s*['\"]([^'\"]+)['\"]\s*\)\s*(?:\.\w+\((?:[^()]|\([^()]*\))*\)\s*)*$", text[max(0, c.at - 300) : c.open]) if framework == "express" else None
                if c.name in style.mount and c.args:
                    _mounted(modules, made, mounts, owner, path, c)
                if c.name == "use" and c.args:
                    scope = string(c.args[0])
                    around += [(owner, path, c.at, scope or "", a) for a in (c.args[1:] if scope is not None else c.args)]
                if c.name in (*VERBS, style.all_name, "query", "del") and c.args and not chain_path:
                    sites.append((owner, c.name, path, c.at, c.args))
                elif c.name == "route" and framework == "fastify" and c.args and c.args[0].startswith("{"):
                    given = entries(c.args[0])
                    for verb in re.findall(r"['\"](\w+)['\"]", given.get("method", "")):
                        sites.append((owner, verb.lower(), path, c.at, [given.get("url") or given.get("path") or "", f"{{schema: {given['schema']}}}" if "schema" in given else "{}", given.get("handler", "")]))
                elif c.name == "openapi" and framework == "hono" and len(c.args) > 1:
                    file, said = declared.text(path, c.args[0])
                    parts = entries(said[len("createRoute(") : -1]) if said.startswith("createRoute(") else {}
                    if verb := string(parts.get("method")):
                        sites.append((owner, verb.lower(), path, c.at, [parts.get("path", ""), said if file == path else c.args[0], *c.args[1:]]))
                elif c.name == "route" and framework == "express" and c.args:
                    at = c.end + 1
                    while m := re.compile(r"\s*\.\s*(\w+)\s*\(").match(text, at):
                        end = closing(text, m.end() - 1)
                        if m[1] in (*VERBS, "all"):
                            sites.append((owner, m[1], path, m.start(), [c.args[0], *split_top(text[m.end() : end])]))
                        at = end + 1
        children = {child for targets in mounts.values() for child, _ in targets}
        roots = [k for k, r in made.items() if (r["app"] and (style.apps_only or k not in children)) or (not style.apps_only and k not in children)]
        reached: dict[tuple[str, str], list[str]] = {}
        pending = [(k, made[k]["prefix"], (k,)) for k in roots]
        while pending:
            key, prefix, way = pending.pop(0)
            reached.setdefault(key, []).append(prefix)
            for child, more in mounts.get(key, ()):
                if child in way:
                    found.remark("path-dynamic", f"router {child[1]} mounts itself", child[0])
                else:
                    pending.append((child, joined(prefix, more, made[child]["prefix"]), (*way, child)))
        candidates = []
        for owner, verb, path, at, args in sites:
            raw = string(args[0])
            if raw is None:
                if len(args) > 1 and not re.match(r"^\w+$|=>|^async|^function", args[0]):
                    found.remark("dynamic-path", "a route's path isn't constant", path, line_at(modules.texts[path], at))
                continue
            if len(args) < 2 and framework != "elysia":
                continue  # app.get("setting")
            handler = next((a for a in reversed(args[1:]) if "=>" in a or "function" in a or re.match(r"[A-Za-z_$]", a)), None)
            if framework == "elysia":
                handler = args[1] if len(args) > 1 else None
            for prefix in reached.get(owner, ()):
                for method in style.all_verbs if verb == style.all_name else ("delete",) if verb == "del" else (verb,):
                    full = joined(prefix, template(raw, style.paths))
                    route = candidate(method, full, path, line_at(modules.texts[path], at))
                    route["parameters"] = [parameter(n, "path", {"type": "string"}, True) for n in names_in(full)]
                    code = modules.function(path, handler) if handler else None
                    describe(code, route, results)
                    if framework == "fastify" and code:
                        _returns(code, route, results)
                    declared.apply(framework, path, args, route)
                    before = [a for a in args[1:] if a is not handler]
                    for text in (*before, code or ""):
                        checks.apply(path, text, route)
                    # middleware of the router that stands before the route, whose scope covers it
                    before += [a for o, file, place, scope, a in around if o == owner and (file != path or place < at) and _covers(scope, raw)]
                    if any(map(asks_credentials, before)):
                        route["security"] = [{"bearerAuth": []}]
                        found.security["bearerAuth"] = {"type": "http", "scheme": "bearer"}
                    if code and re.search(r"\bthrow\b|\bnext\(\s*[^)\s]", code):
                        _handled(modules, made, around, owner, path, at, raw, full, route)
                    candidates.append(route)
        used = {s[0] for s in sites}
        for key in made:
            if key not in reached and key in used:
                found.remark("unreachable-router", f"router {key[1]} isn't mounted", key[0], made[key]["line"])
        if style.best:
            found.routes = best(candidates)
        else:
            found.routes = firsts(candidates)[0]
        for text in modules.texts.values():
            if m := re.search(r"\.listen\(\s*(?:\{\s*port\s*:\s*)?(\d{2,5})", text):
                found.servers.append(f"http://localhost:{m[1]}")
        return found

    return extract


def _returns(code: str, route: dict, results: Results) -> None:
    """The body that a handler returns instead of sending it, where it is a literal or known from models."""
    found = [s for e in returned(code) if (s := object_schema(e, known=lambda x: results.schema(code, x))) is not None]
    if found and "200" not in {r["status_code"] for r in route["responses"]}:
        route["responses"].append(response(200, found[-1], "text/plain" if found[-1].get("type") == "string" else "application/json"))
        route["gaps"] = [g for g in route["gaps"] if g != "response-unknown"]


def _covers(scope: str, path: str) -> bool:
    """Whether a middleware's scope is a path or a prefix of it at a slash."""
    scope = scope.rstrip("/")
    return path == scope or path.startswith(scope + "/") or not scope


def _handled(modules: Modules, made: dict, around, owner, path: str, at: int, raw: str, full: str, route: dict) -> None:
    """Responses of the error handlers that a route's errors reach: those of its router after it, and an app's own."""
    known = {r["status_code"] for r in route["responses"]}
    for o, file, place, scope, text in around:
        own = o == owner and (file != path or place > at) and _covers(scope, raw)
        if not own and not (made[o]["app"] and o != owner and _covers(scope, full)):
            continue
        code = modules.function(file, text)
        head = re.search(r"\(([^()]*)\)", code) if code else None
        if not head or len([p for p in head[1].split(",") if p.strip()]) != 4:
            continue
        answer = candidate(route["method"], full, file, 1)
        describe(code, answer)
        route["responses"] += [r for r in answer["responses"] if r["status_code"] not in known]
        known |= {r["status_code"] for r in answer["responses"]}


def _mounted(modules: Modules, made: dict, mounts: dict, owner, path: str, c) -> None:
    prefix, targets = "", c.args
    first = string(c.args[0])
    if first is not None:
        prefix, targets = first, c.args[1:]
    options = next((m[1] for a in c.args if (m := re.search(r"\bprefix\s*:\s*['\"]([^'\"]+)", a))), "")
    for target in targets:
        m = re.match(r"(?:require\(\s*['\"]([^'\"]+)['\"]\s*\)|([A-Za-z_$]\w*))", target)
        if not m:
            continue
        file, name = modules.place(path, m[2]) if m[2] else (path, "")
        key = (file, name)
        if key not in made:  # a plugin's function stands for its instance
            key = next((k for k, r in made.items() if k[0] == file and r.get("plugin") in (name, "default") and not r["app"]), None)
        if key and key != owner:
            mounts.setdefault(owner, []).append((key, prefix or options))


def nest(files: Mapping[str, str]) -> Found:
    """Controllers by decorators."""
    found = Found()
    modules = Modules(files)
    types, results = TypeScript(modules.texts, found.components), Results(files, modules.texts)
    root = next((m[1] for t in modules.texts.values() if (m := re.search(r"\.setGlobalPrefix\(\s*['\"]([^'\"]+)", t))), "")
    candidates = []
    verbs = {**{v.capitalize(): (v,) for v in VERBS}, "All": ("get",)}
    places = {"Param": "path", "Query": "query", "Headers": "header"}
    for path, text in modules.texts.items():
        for m in re.finditer(r"@Controller\(\s*([^)]*)\)[^{]*?\bclass\s+(\w+)[^{]*\{", text):
            base = string(m[1]) or (string(x[1]) if (x := re.search(r"path\s*:\s*(['\"][^'\"]+['\"])", m[1])) else "") or ""
            end = closing(text, m.end() - 1)
            for d in re.finditer(r"@(Get|Post|Put|Patch|Delete|Head|Options|All)\(", text[m.end() : end]):
                at = m.end() + d.start()
                close = closing(text, at + len(d[0]) - 1)
                given = text[at + len(d[0]) : close]
                raw = string(given) if given.strip() else ""
                if raw is None:
                    found.remark("dynamic-path", "a route's path isn't constant", path, line_at(text, at))
                    continue
                head = re.compile(r"(?:\s*@\w+\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\s*(?:(?:public|private|async)\s+)*(\w+)\s*\(").match(text, close + 1)
                if not head:
                    continue
                opened = head.end() - 1
                ended = closing(text, opened)
                body = text.find("{", ended)
                code = text[body : closing(text, body) + 1]
                for verb in verbs[d[1]]:
                    full = joined(root, base, template(raw, "hono"))
                    route = candidate(verb, full, path, line_at(text, at))
                    route["parameters"] = [parameter(n, "path", {"type": "string"}, True) for n in names_in(full)]
                    for p in split_top(text[opened + 1 : ended]):
                        q = re.match(r"@(Param|Query|Headers|Body)\(\s*(?:['\"]([^'\"]+)['\"])?", p)
                        kind = re.search(r"\w\s*\??\s*:\s*(.+)$", p, re.S)
                        if q and q[1] == "Body" and not q[2]:
                            schema = types.schema(kind[1]) if kind else {}
                            route["request_body"] = {"required": True, "content": [{"media_type": "application/json", "schema": schema}]}
                        elif q and q[1] == "Query" and not q[2] and kind:
                            whole = types.whole(types.schema(kind[1]))
                            route["parameters"] += [parameter(n, "query", each, n in whole.get("required", ())) for n, each in whole.get("properties", {}).items()]
                        elif q and q[2] and q[1] != "Param":
                            kind = "number" if re.search(r":\s*number\b", p) else "string"
                            route["parameters"].append(parameter(q[2], places[q[1]], {"type": kind}, "?" not in p))
                    code_ = re.search(r"@HttpCode\(\s*([\w.]+)\s*\)", text[close : opened])
                    ok = (status(code_[1]) if code_ else None) or (201 if verb == "post" else 200)
                    said = re.match(r"\s*:\s*(.+)$", text[ended + 1 : body], re.S)
                    schema = (types.schema(said[1]) if said else None) or next((s for e in returned("() => " + code) if (s := object_schema(e, known=lambda x: results.schema(code, x))) is not None), None)
                    if any(map(asks_credentials, re.findall(r"@UseGuards\(\s*([^()]*(?:\([^()]*\))?)", text[at : opened] + text[m.start() - 300 if m.start() > 300 else 0 : m.start()] + m[0]))):
                        route["security"] = [{"bearerAuth": []}]
                        found.security["bearerAuth"] = {"type": "http", "scheme": "bearer"}
                    route["responses"].append(response(ok, schema if schema is not None else {}))
                    candidates.append(route)
    found.routes = best(candidates)
    return found


def nextjs(files: Mapping[str, str]) -> Found:
    """Routes by files: exported verbs of app routes, and pages under pages/api."""
    found = Found()
    modules = Modules(files)
    results = Results(files, modules.texts)

    def candidates() -> Iterator[dict]:
        for path, text in modules.texts.items():
            if NEXT_ROUTE.search(path):
                raw = re.sub(r"/route\.\w+$", "", re.sub(r"(^|/)app/", "/", path[path.rfind("app/") - 1 if "/app/" in path else 0 :]))
                verbs = re.findall(r"export\s+(?:async\s+)?(?:function\s+|const\s+)(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b", text)
                verbs += [v for m in re.findall(r"export\s*\{([^}]*)\}", text) for v in re.findall(r"\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b", m)]
            elif NEXT_PAGE.search(path):
                raw = re.sub(r"/index$", "", re.sub(r"\.\w+$", "", re.sub(r"(^|/)pages/", "/", path[path.rfind("pages/") - 1 if "/pages/" in path else 0 :])))
                verbs = re.findall(r"method\s*===?\s*['\"](\w+)['\"]|case\s+['\"](GET|POST|PUT|PATCH|DELETE)['\"]", text)
                verbs = [a or b for a, b in verbs] or ["GET"]
            else:
                continue
            full = joined(template("/" + raw.strip("/"), "nextjs"))
            for verb in dict.fromkeys(verbs):
                route = candidate(verb, full, path, 1)
                route["parameters"] = [parameter(n, "path", {"type": "string"}, True) for n in names_in(full)]
                describe(modules.function(path, verb) if NEXT_ROUTE.search(path) else text, route, results)
                yield route

    found.routes = firsts(candidates())[0]
    return found


PACKS = {**{name: routers(name) for name in STYLES}, "nest": nest, "nextjs": nextjs}
