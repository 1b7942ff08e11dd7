"""What packs share: names, templates, candidates and choosing among them."""

from __future__ import annotations

import re
from collections.abc import Iterable

VERBS = ("get", "post", "put", "patch", "delete", "head", "options")


def joined(*parts: str | None) -> str:
    return "/" + "/".join(p for p in ((x or "").strip("/") for x in parts) if p)


def names_in(template: str) -> list[str]:
    return re.findall(r"\{([^}]+)\}", template)


def operation_id(method: str, path: str) -> str:
    parts = [p for s in re.sub(r"[{}]", "", path).split("/") for p in re.split(r"[^A-Za-z0-9]+", s) if p]
    return method.lower() + ("".join(p[0].upper() + p[1:] for p in parts) or "Root")


def candidate(method: str, path: str, file: str, line: int, **more) -> dict:
    """A route candidate with its defaults."""
    first = next((s for s in path.split("/") if s), "")
    return {
        "method": method.lower(), "path": path, "full_path": path, "operation_id": more.pop("operation_id", None) or operation_id(method, path),
        "origin": {"file": file, "line": line}, "parameters": [], "request_body": None, "responses": [], "security": [], "gaps": [],
        "tags": [first] if first and not first.startswith("{") else ["default"], "confidence": "high", **more,
    }


def parameter(name: str, where: str, schema: dict | None, required: bool, confidence: str = "high") -> dict:
    return {"name": name, "in": where, "required": required, "schema": schema, "confidence": confidence}


def response(status, schema: dict | None = None, media: str = "application/json", description: str = "", confidence: str = "high") -> dict:
    content = [{"media_type": media, "schema": schema}] if schema is not None or media != "application/json" else []
    return {"status_code": str(status), "description": description, "confidence": confidence, "content": content}


def score(c: dict, weights=(2, 1, 2)) -> int:
    r, p, b = weights
    return r * len(c["responses"]) + p * len(c["parameters"]) + b * bool(c["request_body"]) - len(c["gaps"])


def best(candidates: Iterable[dict], weights=(2, 1, 2)) -> list[dict]:
    """Of each method and path the candidate with the best score, the first of equals, in the order of the first."""
    out: dict = {}
    for c in candidates:
        key = c["method"], c["full_path"]
        if key not in out or score(c, weights) > score(out[key], weights):
            out[key] = c
    return list(out.values())


def firsts(candidates: Iterable[dict]) -> tuple[list[dict], list[dict]]:
    """The first candidate of each method and path, and the others."""
    out: dict = {}
    rest = [c for c in candidates if out.setdefault((c["method"], c["full_path"]), c) is not c]
    return list(out.values()), rest
