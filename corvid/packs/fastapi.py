"""FastAPI: routes from decorators, mounted by include_router, with parameters, bodies and responses by annotation."""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping

from corvid.packs import Found
from corvid.packs.errors import ErrorHandlers
from corvid.packs.pyfacts import Module, Project, constant, constrained, dotted, keyword, literal_schema, parse, schema_of
from corvid.packs.routes import VERBS, candidate, joined, names_in, parameter, response
from corvid.packs.starlette import responses as starlette_responses

#: Converters of path placeholders, functions that say where a parameter is, security classes, depth of Depends.
CONVERTERS = {"int": {"type": "integer"}, "float": {"type": "number"}, "path": {"type": "string"}, "str": {"type": "string"}, "uuid": {"type": "string", "format": "uuid"}}
PLACES = {"Path": "path", "Query": "query", "Header": "header", "Cookie": "cookie", "Body": "body", "Form": "form", "File": "form"}
SECURITY = {
    "HTTPBearer": {"type": "http", "scheme": "bearer"}, "HTTPBasic": {"type": "http", "scheme": "basic"}, "HTTPDigest": {"type": "http", "scheme": "digest"},
    "OAuth2PasswordBearer": {"type": "oauth2", "flows": {"password": {"tokenUrl": "", "scopes": {}}}},
}
KEYS = {"APIKeyHeader": "header", "APIKeyQuery": "query", "APIKeyCookie": "cookie"}
INJECTED = {"Request", "Response", "BackgroundTasks", "WebSocket", "HTTPConnection", "SecurityScopes"}
DEPENDS_DEPTH, MOUNTS = 4, 10_000
#: Fixed value: the framework's own answer to an HTTPException.
DETAIL = {"type": "object", "properties": {"detail": {"type": "string"}}}


class _App:
    """The routers and mounts of a project."""

    def __init__(self, project: Project, found: Found):
        self.project, self.found = project, found
        self.routers: dict[tuple[str, str], dict] = {}
        self.mounts: dict[tuple[str, str], list[tuple[tuple[str, str], str]]] = {}
        self.security: dict[tuple[str, str], str] = {}
        self.functions = {(m.path, n.name): (m, n) for m in project.modules.values() for n in m.tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}

    def key(self, module: Module, name: str) -> tuple[str, str] | None:
        place = self.project.resolve(module, name)
        return (place[0].path, place[1]) if place else None

    def collect(self) -> None:
        for module in self.project.modules.values():
            for node in ast.walk(module.tree):
                if isinstance(node, (ast.Assign, ast.AnnAssign)) and isinstance(node.value, ast.Call):
                    target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                    kind = dotted(node.value.func).rpartition(".")[2]
                    if not isinstance(target, ast.Name):
                        continue
                    if kind in ("FastAPI", "APIRouter"):
                        prefix = constant(keyword(node.value, "prefix") or keyword(node.value, "root_path"), module) if kind == "APIRouter" else ""
                        tags = constant(keyword(node.value, "tags"), module)
                        self.routers[module.path, target.id] = {"app": kind == "FastAPI", "prefix": prefix if isinstance(prefix, str) else "", "tags": tags if isinstance(tags, list) else [], "line": node.lineno, "depends": keyword(node.value, "dependencies")}
                    elif kind in SECURITY or kind in KEYS:
                        self.security[module.path, target.id] = self.scheme(kind, node.value, module)
        for module in self.project.modules.values():
            for node in ast.walk(module.tree):
                if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("include_router", "mount"):
                    routed = node.args[0] if node.func.attr == "include_router" and node.args else node.args[1] if len(node.args) > 1 else None
                    parent, child = self.key(module, dotted(node.func.value)), self.key(module, dotted(routed)) if routed is not None else None
                    given = keyword(node, "prefix") if node.func.attr == "include_router" else node.args[0] if node.args else None
                    prefix = constant(given, module) if given is not None else ""
                    if parent and child in self.routers:
                        if not isinstance(prefix, str):
                            self.found.remark("dynamic-path", "a router's prefix isn't constant", module.path, node.lineno)
                            continue
                        self.mounts.setdefault(parent, []).append((child, prefix))

    def scheme(self, kind: str, call: ast.Call, module: Module) -> str:
        self.found.security[kind] = {"type": "apiKey", "in": KEYS[kind], "name": constant(keyword(call, "name"), module)} if kind in KEYS else SECURITY[kind]
        return kind

    def reached(self) -> dict[tuple[str, str], list[str]]:
        """Prefixes under which each router is reached from an app; cycles end a way."""
        out: dict = {}
        pending = [(k, "", (k,)) for k, r in self.routers.items() if r["app"]]
        while pending:
            key, prefix, way = pending.pop(0)
            out.setdefault(key, []).append(prefix)
            if sum(map(len, out.values())) > MOUNTS:
                raise ValueError("too many mounts")
            for child, more in self.mounts.get(key, ()):
                if child in way:
                    self.found.remark("path-dynamic", f"router {child[1]} includes itself", child[0])
                else:
                    pending.append((child, joined(prefix, more, self.routers[child]["prefix"]), (*way, child)))
        return out


def _arguments(function) -> list[tuple[ast.arg, ast.AST | None]]:
    a = function.args
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    return [*zip(plain, defaults), *zip(a.kwonlyargs, a.kw_defaults)]


def _bind(app: _App, module: Module, function, template: str, route: dict, converters: dict, depth: int = 0) -> list[tuple[str, dict, bool, bool]]:
    """Declare a function's parameters on the route; returns body parts (name, schema, required, embed)."""
    bodies: list = []
    in_path = names_in(template)
    for arg, default in _arguments(function):
        annotation = arg.annotation
        marks = [default] if isinstance(default, ast.Call) else []
        plain_default = default is not None and not isinstance(default, ast.Call)
        if isinstance(annotation, ast.Subscript) and dotted(annotation.value).endswith("Annotated") and isinstance(annotation.slice, ast.Tuple):
            marks += [m for m in annotation.slice.elts[1:] if isinstance(m, ast.Call)]
            annotation = annotation.slice.elts[0]
        mark = next((m for m in marks if dotted(m.func).rpartition(".")[2] in {*PLACES, "Depends", "Security"}), None)
        kind = dotted(mark.func).rpartition(".")[2] if mark else ""
        if kind in ("Depends", "Security"):
            _depend(app, module, mark.args[0] if mark.args else annotation, template, route, converters, bodies, depth)
            continue
        if dotted(annotation or ast.Constant(0)).rpartition(".")[2] in INJECTED or arg.arg in ("self", "cls"):
            continue
        alias = constant(keyword(mark, "alias"), module) if mark and keyword(mark, "alias") is not None else ...
        name = alias if isinstance(alias, str) else arg.arg
        schema = constrained(schema_of(app.project, module, annotation), mark, module)
        first = (mark.args[0] if mark.args else keyword(mark, "default")) if mark else None
        given = plain_default or (first is not None and not (isinstance(first, ast.Constant) and first.value is ...))
        place = "path" if name in in_path else PLACES.get(kind, "")
        if not place:
            model = schema.get("$ref") and app.project.components.get(schema["$ref"].rpartition("/")[2], {}).get("type") == "object"
            place = "body" if model else "query"
        if place == "path":
            known = schema or converters.get(name)
            if annotation is None:
                route["gaps"].append("path-param-untyped")
            route["parameters"].append(parameter(name, "path", known or {"type": "string"}, True, "high" if schema else "medium"))
        elif place in ("header", "cookie"):
            wire = name.replace("_", "-") if place == "header" and alias is ... else name
            if annotation is None:
                route["gaps"].append("header-unknown")
            route["parameters"].append(parameter(wire, place, schema or {"type": "string"}, not given))
        elif place == "query":
            if not schema:
                route["gaps"].append("query-unknown")
            route["parameters"].append(parameter(name, "query", schema, not given))
        elif place == "form":
            bodies.append((name, {"type": "string", "format": "binary"} if kind == "File" else schema, not given, "form"))
        else:
            bodies.append((name, schema, not given, bool(mark and constant(keyword(mark, "embed"), module) is True)))
    return bodies


def _depend(app: _App, module: Module, target, template, route, converters, bodies, depth) -> None:
    name = dotted(target.func if isinstance(target, ast.Call) else target) if target is not None else ""
    kind = name.rpartition(".")[2]
    key = app.key(module, name) if name else None
    if isinstance(target, ast.Call) and (kind in SECURITY or kind in KEYS):
        route["security"].append({app.scheme(kind, target, module): []})
    elif key in app.security:
        route["security"].append({app.security[key]: []})
    elif key in app.functions and depth < DEPENDS_DEPTH:
        bodies += _bind(app, *app.functions[key], template, route, converters, depth + 1)


def _responses(app: _App, module: Module, function, call: ast.Call, route: dict) -> None:
    status = constant(keyword(call, "status_code"), module) if keyword(call, "status_code") is not None else 200
    if not isinstance(status, int):
        named = re.search(r"HTTP_(\d{3})", dotted(keyword(call, "status_code")))
        status = int(named[1]) if named else 200
    model = keyword(call, "response_model")
    schema = schema_of(app.project, module, model) if model is not None and not (isinstance(model, ast.Constant) and model.value is None) else {}
    returns = [n.value for n in ast.walk(function) if isinstance(n, ast.Return) and n.value is not None]
    streams = [r for r in returns if isinstance(r, ast.Call) and dotted(r.func).rpartition(".")[2] in ("StreamingResponse", "EventSourceResponse")]
    if any(dotted(r.func).endswith("EventSourceResponse") or constant(keyword(r, "media_type"), module) == "text/event-stream" for r in streams):
        route["responses"].append({"status_code": str(status), "description": "", "confidence": "medium", "content": [{"media_type": "text/event-stream", "schema": None, "item_schema": None}]})
        route["x-protocol"] = "sse"
        return
    if not schema and function.returns is not None:
        schema = schema_of(app.project, module, function.returns)
    if not schema:
        schema = next((s for s in (literal_schema(app.project, module, r) for r in returns) if s is not None), {})
    if schema:
        route["responses"].append(response(status, schema))
    elif status == 204:
        route["responses"].append(response(204))
    else:
        route["gaps"].append("response-unknown")
    extra = keyword(call, "responses")
    if isinstance(extra, ast.Dict):
        for k, v in zip(extra.keys, extra.values):
            code = constant(k, module)
            said = v if isinstance(v, ast.Dict) else ast.Dict([], [])
            named = {constant(a): b for a, b in zip(said.keys, said.values)}
            route["responses"].append(response(code, schema_of(app.project, module, named["model"]) if "model" in named else None, description=str(constant(named.get("description"), module)) if "description" in named else ""))
    seen = {r["status_code"] for r in route["responses"]}
    for n in ast.walk(function):
        if isinstance(n, ast.Raise) and isinstance(n.exc, ast.Call) and dotted(n.exc.func).endswith("HTTPException"):
            given = keyword(n.exc, "status_code") or (n.exc.args[0] if n.exc.args else None)
            code = constant(given, module)
            if not isinstance(code, int):
                named = re.search(r"HTTP_(\d{3})", dotted(given)) if given is not None else None
                code = int(named[1]) if named else 0
            if code >= 400 and str(code) not in seen:
                seen.add(str(code))
                route["responses"].append(response(code, dict(DETAIL)))


def _body(parts: list, route: dict) -> None:
    forms = [p for p in parts if p[3] == "form"]
    if forms:
        schema = {"type": "object", "properties": {n: s for n, s, _, _ in forms}, "required": [n for n, _, r, _ in forms if r]}
        route["request_body"] = {"required": True, "content": [{"media_type": "multipart/form-data", "schema": schema}]}
    elif len(parts) == 1 and not parts[0][3]:
        route["request_body"] = {"required": parts[0][2], "content": [{"media_type": "application/json", "schema": parts[0][1]}]}
    elif parts:
        schema = {"type": "object", "properties": {n: s for n, s, _, _ in parts}, "required": [n for n, _, r, _ in parts if r]}
        route["request_body"] = {"required": True, "content": [{"media_type": "application/json", "schema": schema}]}


def extract(files: Mapping[str, str]) -> Found:
    found = Found()
    project = parse(dict(files))
    for path, error in project.broken:
        found.remark("analysis-failed", error, path)
    app = _App(project, found)
    app.collect()
    errors = ErrorHandlers(project)
    reached = app.reached()
    used: set = set()
    for module in project.modules.values():
        for function in ast.walk(module.tree):
            if not isinstance(function, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            for call in function.decorator_list:
                if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr in (*VERBS, "api_route")):
                    continue
                key = app.key(module, dotted(call.func.value))
                if key not in app.routers:
                    continue
                given = call.args[0] if call.args else keyword(call, "path")
                raw = constant(given, module)
                if not isinstance(raw, str):
                    found.remark("dynamic-path", f"the path of {function.name} isn't constant", module.path, function.lineno)
                    continue
                used.add(key)
                verbs = [call.func.attr] if call.func.attr != "api_route" else [m.lower() for m in constant(keyword(call, "methods"), module) or ["get"]] if keyword(call, "methods") is not None else ["get"]
                converters = {n: CONVERTERS[c] for n, c in re.findall(r"\{([^{}:]+):([^{}]+)\}", raw) if c in CONVERTERS}
                template = re.sub(r"\{([^{}:]+):[^{}]+\}", r"{\1}", raw)
                for prefix in reached.get(key, ()):
                    for verb in verbs:
                        full = joined(prefix, template)
                        route = candidate(verb, full, module.path, function.lineno)
                        tags = constant(keyword(call, "tags"), module)
                        route["tags"] = (app.routers[key]["tags"] + (tags if isinstance(tags, list) else [])) or route["tags"]
                        own_id = constant(keyword(call, "operation_id"), module)
                        if isinstance(own_id, str):
                            route["operation_id"] = own_id
                        if doc := ast.get_docstring(function):
                            route["description"] = doc
                        for depends in (app.routers[key]["depends"], keyword(call, "dependencies")):
                            for d in depends.elts if isinstance(depends, ast.List) else ():
                                if isinstance(d, ast.Call) and d.args:
                                    _depend(app, module, d.args[0], full, route, converters, [], 0)
                        _body(_bind(app, module, function, full, route, converters), route)
                        last = {(p["in"], p["name"]): p for p in route["parameters"]}  # a later declaration replaces an earlier one
                        route["parameters"] = list(last.values())
                        _responses(app, module, function, call, route)
                        if errors.handlers:
                            errors.apply(module, function, route, lambda m, f, r: starlette_responses(project, m, f, r), lambda code: response(code, dict(DETAIL)))
                        found.routes.append(route)
    for key, router in app.routers.items():
        if key not in reached and key in used:
            found.remark("unreachable-router", f"router {key[1]} isn't mounted", key[0], router["line"])
    found.components = project.components
    return found
