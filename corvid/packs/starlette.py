"""Starlette: routes from Route, WebSocketRoute and Mount lists."""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping

from corvid.packs import Found
from corvid.packs.errors import ErrorHandlers
from corvid.packs.flask import _returned as _flask_returned
from corvid.packs.pyfacts import Module, Project, constant, dotted, keyword, literal_schema, parse
from corvid.packs.routes import candidate, joined, parameter, response

CONVERTERS = {"str": {"type": "string"}, "int": {"type": "integer"}, "float": {"type": "number"}, "path": {"type": "string"}, "uuid": {"type": "string", "format": "uuid"}}
MEDIA = {"PlainTextResponse": "text/plain", "HTMLResponse": "text/html", "FileResponse": "application/octet-stream", "StreamingResponse": "application/octet-stream"}


def _handler(project: Project, module: Module, name: str):
    place = project.resolve(module, name)
    if not place:
        return None
    for n in place[0].tree.body:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and n.name == place[1]:
            return place[0], n
    return None


def responses(project: Project, module: Module, function, route: dict) -> None:
    for n in ast.walk(function):
        if not isinstance(n, ast.Return) or n.value is None:
            continue
        call = n.value
        name = dotted(call.func).rpartition(".")[2] if isinstance(call, ast.Call) else ""
        if name.endswith("Response"):
            code = constant(keyword(call, "status_code"), module) if keyword(call, "status_code") is not None else 200
            status = code if isinstance(code, int) else 200
            if name == "RedirectResponse":
                route["responses"].append(response(307))
            elif name in MEDIA:
                route["responses"].append(response(status, {"type": "string"}, MEDIA[name]))
            else:
                content = call.args[0] if call.args else keyword(call, "content")
                route["responses"].append(response(status, (literal_schema(project, module, content) or {}) if content is not None else None))
        else:
            route["responses"].append(_flask_returned(project, module, call))
    seen: dict = {}
    route["responses"] = [seen.setdefault(r["status_code"], r) for r in route["responses"] if r["status_code"] not in seen]
    if not route["responses"]:
        route["gaps"].append("response-unknown")


def extract(files: Mapping[str, str]) -> Found:
    found = Found()
    project = parse(dict(files))
    for path, error in project.broken:
        found.remark("analysis-failed", error, path)
    errors = ErrorHandlers(project)

    def listed(module: Module, node: ast.AST | None, prefix: str, depth: int = 0) -> None:
        if isinstance(node, ast.Name) and depth < 8:
            place = project.resolve(module, node.id)
            for n in place[0].tree.body if place else ():
                if isinstance(n, (ast.Assign, ast.AnnAssign)) and any(isinstance(t, ast.Name) and t.id == place[1] for t in (n.targets if isinstance(n, ast.Assign) else [n.target])):
                    listed(place[0], n.value, prefix, depth + 1)
            return
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            listed(module, node.left, prefix, depth + 1)
            listed(module, node.right, prefix, depth + 1)
            return
        for call in node.elts if isinstance(node, (ast.List, ast.Tuple)) else ():
            kind = dotted(call.func).rpartition(".")[2] if isinstance(call, ast.Call) else ""
            if kind not in ("Route", "WebSocketRoute", "Mount"):
                continue
            raw = constant(call.args[0] if call.args else keyword(call, "path"), module)
            if not isinstance(raw, str):
                found.remark("dynamic-path", "a route's path isn't constant", module.path, call.lineno)
                continue
            if kind == "Mount":
                inner = keyword(call, "routes")
                app = keyword(call, "app") or (call.args[1] if len(call.args) > 1 else None)
                if inner is None and isinstance(app, ast.Call):
                    inner = keyword(app, "routes")
                listed(module, inner, joined(prefix, raw), depth + 1)
                continue
            endpoint = call.args[1] if len(call.args) > 1 else keyword(call, "endpoint")
            methods = constant(keyword(call, "methods"), module) if keyword(call, "methods") is not None else None
            handler = _handler(project, module, dotted(endpoint)) if endpoint is not None else None
            views = {}
            if handler and isinstance(handler[1], ast.ClassDef):
                views = {n.name: n for n in handler[1].body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name in ("get", "post", "put", "patch", "delete", "head", "options")}
            verbs = ["get"] if kind == "WebSocketRoute" else [m.lower() for m in methods if isinstance(m, str)] if isinstance(methods, list) else list(views) or ["get"]
            template = re.sub(r"\{([^{}:]+):[^{}]+\}", r"{\1}", raw)
            for verb in verbs:
                route = candidate(verb, joined(prefix, template), module.path, call.lineno)
                route["parameters"] = [parameter(n, "path", CONVERTERS.get(c or "str", {"type": "string"}), True) for n, c in re.findall(r"\{([^{}:]+)(?::([^{}]+))?\}", raw)]
                if kind == "WebSocketRoute":
                    route["x-websocket"] = True
                    route["responses"].append(response(101))
                elif handler:
                    responses(project, handler[0], views.get(verb, handler[1]), route)
                    errors.apply(handler[0], views.get(verb, handler[1]), route, lambda m, f, r: responses(project, m, f, r), lambda code: response(code, {"type": "string"}, "text/plain"))
                else:
                    route["gaps"].append("response-unknown")
                found.routes.append(route)

    for module in project.modules.values():
        for n in ast.walk(module.tree):
            if isinstance(n, ast.Call) and dotted(n.func).rpartition(".")[2] in ("Starlette", "Router") and keyword(n, "routes") is not None:
                listed(module, keyword(n, "routes"), "")
    found.components = project.components
    return found
