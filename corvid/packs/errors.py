"""Error handlers of Python apps: which one answers what a route's function raises."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

from corvid.packs.pyfacts import Module, Project, bases, constant, dotted, find_class, keyword
from corvid.packs.routes import response


def _status(given: ast.AST | None, module: Module) -> int | None:
    code = constant(given, module) if given is not None else None
    if isinstance(code, int):
        return code
    named = re.search(r"HTTP_(\d{3})", dotted(given)) if given is not None else None
    return int(named[1]) if named else None


class ErrorHandlers:
    """Handlers by status and by class name: a mapping given to the app, a call that adds one, or a decorator."""

    def __init__(self, project: Project):
        self.project = project
        self.handlers: dict[int | str, tuple[Module, ast.AST]] = {}
        for module in project.modules.values():
            for n in ast.walk(module.tree):
                if isinstance(n, ast.Call):
                    given = keyword(n, "exception_handlers")
                    if isinstance(given, ast.Dict):
                        for key, value in zip(given.keys, given.values):
                            self._add(module, key, self._function(module, value))
                    if isinstance(n.func, ast.Attribute) and n.func.attr in ("add_exception_handler", "register_error_handler") and len(n.args) == 2:
                        self._add(module, n.args[0], self._function(module, n.args[1]))
                elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    for d in n.decorator_list:
                        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ("exception_handler", "errorhandler", "app_errorhandler") and d.args:
                            self._add(module, d.args[0], (module, n))

    def _function(self, module: Module, node: ast.AST) -> tuple[Module, ast.AST] | None:
        place = self.project.resolve(module, dotted(node)) if dotted(node) else None
        for n in place[0].tree.body if place else ():
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == place[1]:
                return place[0], n
        return None

    def _add(self, module: Module, key: ast.AST | None, function) -> None:
        code = _status(key, module)
        name = code if code is not None else dotted(key).rpartition(".")[2] if key is not None else ""
        if function and name:
            self.handlers.setdefault(name, function)

    def _raised(self, module: Module, function: ast.AST) -> Iterator[tuple[int | None, list[str], bool]]:
        """(status, names of the class and its ancestors from near to far, whether it's an HTTP exception) of each raise."""
        for n in ast.walk(function):
            if isinstance(n, ast.Raise) and n.exc is not None:
                call = n.exc if isinstance(n.exc, ast.Call) else None
                name = dotted(call.func if call else n.exc)
                short = name.rpartition(".")[2]
                found = find_class(self.project, module, name) if name else None
                lineage = [b if isinstance(b, str) else b.name for _, b in reversed(bases(self.project, *found))] if found else []
                names = [short, *(x.rpartition(".")[2] for x in lineage)]
                http = "HTTPException" in names
                given = (keyword(call, "status_code") or (call.args[0] if call.args else None)) if call and short == "HTTPException" else None
                yield _status(given, module), names, http
            elif isinstance(n, ast.Call) and dotted(n.func).rpartition(".")[2] == "abort" and n.args and isinstance(constant(n.args[0], module), int):
                yield constant(n.args[0], module), ["HTTPException"], True

    def apply(self, module: Module, function: ast.AST, route: dict, describe: Callable[[Module, ast.AST, dict], None], default: Callable[[int], dict]) -> None:
        """Add the responses of the handlers that a function's exceptions reach: by status, then by the nearest class.

        default(status) is the framework's own answer to an HTTP exception, which a handler's replaces."""
        known = {r["status_code"]: r for r in route["responses"]}
        for code, names, http in self._raised(module, function):
            handler = self.handlers.get(code) if http and code else None
            handler = handler or next((self.handlers[n] for n in [*names, "Exception"] if n in self.handlers), None)
            answers = [default(code)] if http and code else []
            if handler:
                scratch = {**route, "responses": [], "gaps": []}
                describe(*handler, scratch)
                answers = scratch["responses"]
                if code and any(dotted(keyword(n, "status_code")).endswith(".status_code") for n in ast.walk(handler[1]) if isinstance(n, ast.Call) and keyword(n, "status_code") is not None):
                    answers = [{**r, "status_code": str(code)} for r in answers]
                if code and known.get(str(code)) == default(code):
                    del known[str(code)]
            for r in answers:
                known.setdefault(r["status_code"], r)
        route["responses"] = list(known.values())
