"""Contracts that JavaScript routes declare beside their handlers: Fastify's schemas, Elysia's hooks, Hono's createRoute."""

from __future__ import annotations

import re

from corvid.packs.routes import response
from corvid.packs.scanner import closing, split_top, string

#: The parts of a request by the names that frameworks give them.
PLACES = {"body": "body", "querystring": "query", "query": "query", "params": "path", "headers": "header", "cookies": "cookie", "cookie": "cookie"}
_NAME = re.compile(r"[A-Za-z_$][\w$]*")


def entries(text: str) -> dict[str, str]:
    """The values of an object literal by key, as text; a key alone stands for a name."""
    out = {}
    for entry in split_top(text.strip()[1:-1]) if text.strip().startswith("{") else ():
        key, _, value = entry.partition(":")
        out[string(key.strip()) or key.strip()] = value.strip() or key.strip()
    return out


class Declared:
    """Reads declarations with the names of their file and, for schemas, with the validators that the project uses."""

    def __init__(self, modules, checks):
        self.modules, self.checks = modules, checks

    def text(self, path: str, expression: str) -> tuple[str, str]:
        """The file and text that an expression stands for: that of a constant where it is a name."""
        e = re.sub(r"\s+as\s+const$", "", expression.strip())
        if not _NAME.fullmatch(e):
            return path, e
        file, name = self.modules.place(path, e)
        text = self.modules.texts[file]
        m = re.search(rf"\b(?:const|let|var)\s+{re.escape(name)}\s*(?::[^=\n]+)?=\s*", text)
        if not m:
            return path, e
        at = re.compile(r"[\w$.\s]*?(?=[(\[{])").match(text, m.end())
        return file, text[m.end() : closing(text, at.end()) + 1] if at else ""

    def schema(self, path: str, expression: str, depth: int = 0) -> dict:
        """A schema given as a validator or as a JSON Schema literal; {} where it is neither."""
        found = self.checks.schema(path, expression)
        if found is not None:
            return found
        file, text = self.text(path, expression)
        out = self._value(file, text, depth) if text.startswith("{") else None
        return out if isinstance(out, dict) else {}

    def _value(self, path: str, text: str, depth: int):
        text = re.sub(r"\s+as\s+const$", "", text.strip())
        if (s := string(text)) is not None:
            return s
        if re.fullmatch(r"-?\d+(?:\.\d+)?", text):
            return float(text) if "." in text else int(text)
        if text in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[text]
        if text.startswith("["):
            return [self._value(path, x, depth + 1) for x in split_top(text[1:-1])]
        if text.startswith("{"):
            return {k: self._value(path, v, depth + 1) for k, v in entries(text).items() if not k.startswith("...")}
        return self.schema(path, text, depth + 1) if depth < 12 else {}

    def apply(self, framework: str, path: str, args: list[str], route: dict) -> None:
        """What the arguments of a route after its path declare; a declared response takes the place of the handler's."""
        for a in args[1:]:
            file, text = self.text(path, a)
            if framework == "fastify" and text.startswith("{") and (given := entries(text).get("schema")):
                file, text = self.text(file, given)
                self._request(file, entries(text), route)
                self._responses(file, entries(text).get("response", ""), route)
            elif framework == "elysia" and a is not args[1] and text.startswith("{"):
                self._request(file, entries(text), route)
                self._responses(file, entries(text).get("response", ""), route)
            elif framework == "hono" and text.startswith("createRoute("):
                parts = entries(text[len("createRoute(") : -1])
                request = entries(self.text(file, parts.get("request", ""))[1])
                self._request(file, {k: v for k, v in request.items() if k != "body"}, route)
                if content := self._content(file, request.get("body", "")):
                    route["request_body"] = {"required": entries(request["body"]).get("required") != "false", "content": content}
                for status, said in entries(self.text(file, parts.get("responses", ""))[1]).items():
                    told = string(entries(said).get("description", "")) or ""
                    content = self._content(file, said)
                    self._answer(route, {**response(status, description=told), "content": content})

    def _content(self, path: str, text: str) -> list[dict]:
        content = entries(entries(self.text(path, text)[1]).get("content", ""))
        return [{"media_type": media, "schema": self.schema(path, entries(each).get("schema", ""))} for media, each in content.items()]

    def _request(self, path: str, parts: dict[str, str], route: dict) -> None:
        for name, text in parts.items():
            if name in PLACES:
                self.checks.said(route, PLACES[name], self.schema(path, text) or None)

    def _responses(self, path: str, text: str, route: dict) -> None:
        if not text:
            return
        file, text = self.text(path, text)
        by_status = entries(text)
        if by_status and all(re.fullmatch(r"\d{3}|[1-5][xX]{2}|default", k) for k in by_status):
            for status, each in by_status.items():
                self._answer(route, response(status.upper() if status != "default" else status, self.schema(file, each)))
        elif schema := self.schema(file, text):
            self._answer(route, response(200, schema))

    @staticmethod
    def _answer(route: dict, answer: dict) -> None:
        at = next((i for i, r in enumerate(route["responses"]) if r["status_code"] == answer["status_code"]), len(route["responses"]))
        route["responses"][at : at + 1] = [answer]
        route["gaps"] = [g for g in route["gaps"] if g != "response-unknown"]
