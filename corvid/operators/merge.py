"""Bringing a new scan into a document that people have edited, without losing their work."""

from __future__ import annotations

import copy
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.functions.schemas import canonical, map_refs

#: What of an operation is the user's prose.
PROSE = ("summary", "description", "tags", "externalDocs", "deprecated", "operationId")


def _examples(scanned: dict, user) -> dict:
    """A scanned parameter or media type with the user's examples."""
    out = copy.deepcopy(scanned)
    if isinstance(user, Mapping):
        if "example" in user:
            out["example"] = copy.deepcopy(user["example"])
        if isinstance(user.get("examples"), Mapping):
            out["examples"] = copy.deepcopy(user["examples"])
    return out


def _described(scanned: dict, user) -> dict:
    out = copy.deepcopy(scanned)
    if isinstance(user, Mapping) and isinstance(user.get("description"), str):
        out["description"] = user["description"]
    return out


def _outer(scanned: Mapping, user: Mapping, join) -> dict:
    """Entries by key: the scan's in its order, joined with the user's; then those that only the user has."""
    out = {k: join(v, user.get(k)) if isinstance(v, Mapping) else copy.deepcopy(v) for k, v in scanned.items()}
    return {**out, **{k: copy.deepcopy(v) for k, v in user.items() if k not in out}}


def _inner(scanned, user, join):
    """Entries of the scan alone, joined with the user's."""
    user = user if isinstance(user, Mapping) else {}
    return {k: join(v, user.get(k)) if isinstance(v, Mapping) else copy.deepcopy(v) for k, v in scanned.items()}


def _response(scanned: dict, user) -> dict:
    out = _described(scanned, user)
    own = user if isinstance(user, Mapping) else {}
    if isinstance(out.get("content"), Mapping):
        out["content"] = _inner(out["content"], own.get("content"), _examples)
    if isinstance(out.get("headers"), Mapping):
        out["headers"] = _inner(out["headers"], own.get("headers"), _described)
    return out


def _body(scanned: dict, user: Mapping, rename) -> dict:
    out = _described(scanned, user)
    fresh = scanned.get("content") if isinstance(scanned.get("content"), Mapping) else {}
    own = user.get("content") if isinstance(user.get("content"), Mapping) else {}
    out["content"] = _outer(map_refs(dict(fresh), rename), own, _examples)
    return out


def _parameters(scanned: list, user: list, rename) -> list:
    key = lambda p: (p.get("in"), p.get("name"))
    own = {key(p): p for p in user if isinstance(p, Mapping) and isinstance(p.get("name"), str) and isinstance(p.get("in"), str)}
    out = []
    for p in scanned:
        mine = own.pop(key(p), None) if isinstance(p, Mapping) else None
        out.append(map_refs(_described(_examples(p, mine), mine) if isinstance(p, Mapping) else p, rename))
    return out + [copy.deepcopy(p) for p in own.values()]


def merged_operation(scanned: Mapping, user: Mapping | None, rename=lambda n: n) -> dict:
    """The scan's contract with the user's prose, extensions and additions."""
    if user is None:
        return map_refs(copy.deepcopy(dict(scanned)), rename)
    out = copy.deepcopy(dict(scanned))
    out |= {k: copy.deepcopy(v) for k, v in user.items() if k in PROSE or k.startswith("x-")}
    lists = [x.get("parameters") for x in (scanned, user)]
    if any(isinstance(x, list) for x in lists):
        out["parameters"] = _parameters(*(x if isinstance(x, list) else [] for x in lists), rename)
    if isinstance(scanned.get("requestBody"), Mapping):
        own = user.get("requestBody")
        out["requestBody"] = _body(scanned["requestBody"], own if isinstance(own, Mapping) else {}, rename)
    elif "requestBody" in user:
        out["requestBody"] = copy.deepcopy(user["requestBody"])
    if isinstance(scanned.get("responses"), Mapping):
        own = user.get("responses")
        fresh = map_refs(dict(scanned["responses"]), rename)
        out["responses"] = _outer(fresh, own if isinstance(own, Mapping) else {}, _response)
    if "security" in user and "security" not in out:
        out["security"] = copy.deepcopy(user["security"])
    return out


def merge_document(document: Mapping, scanned: Mapping, changes: list[tuple[str, str, str]]) -> tuple[dict, dict]:
    """(document, report) after a scan's changes (kind, method, path): added and changed operations are taken over,
    removed ones reported and kept. Components and security schemes are only added; a name that is taken by something
    else gets the next free number, and references follow. The inputs stay as they are."""
    out = copy.deepcopy(dict(document))
    own = out.setdefault("components", {}).setdefault("schemas", {})
    fresh = scanned.get("components", {}).get("schemas", {})
    names, taken = {}, set(own) | set(fresh)
    for name, schema in fresh.items():
        new, n = name, 2
        if name in own and canonical(own[name]) != canonical(schema):
            while (new := f"{name}{n}") in taken:
                n += 1
            taken.add(new)
        names[name] = new
    rename = lambda n: names.get(n, n)
    for name, schema in fresh.items():
        if names[name] not in own:
            own[names[name]] = map_refs(copy.deepcopy(schema), rename)
    schemes = scanned.get("components", {}).get("securitySchemes", {})
    if schemes:
        out["components"]["securitySchemes"] = {**copy.deepcopy(schemes), **out["components"].get("securitySchemes", {})}
    report: dict = {"added": [], "changed": [], "removed": []}
    for kind, method, path in changes:
        fresh_operation = scanned.get("paths", {}).get(path, {}).get(method)
        if kind == "removed":
            report["removed"].append(f"{method} {path}")
        elif fresh_operation is not None:
            item = out.setdefault("paths", {}).setdefault(path, {})
            item[method] = merged_operation(fresh_operation, item.get(method), rename)
            report[kind].append(f"{method} {path}")
    report["renamed"] = {a: b for a, b in names.items() if a != b}
    return out, report


def merge_three_way(user: DataFrame, previous: DataFrame, following: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows by key from the user's, the last and the next scan, a full outer join: a value that the user changed since
    the last scan stays, others follow the next. `origin` is added, removed (kept as the user has it), edited or scanned."""
    named = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in columns), F.lit(True).alias(f"in_{p}"))
    both = named(user, "u").join(named(previous, "p"), keys, "full_outer").join(named(following, "n"), keys, "full_outer")
    edited = {c: F.col("in_u").isNotNull() & F.col("in_p").isNotNull() & ~F.col(f"u_{c}").eqNullSafe(F.col(f"p_{c}")) for c in columns}
    any_edit = F.lit(False)
    for condition in edited.values():
        any_edit = any_edit | condition
    gone = F.col("in_n").isNull()
    origin = F.when(gone, "removed").when(F.col("in_u").isNull(), "added").when(any_edit, "edited").otherwise("scanned")
    values = [F.when(gone, F.coalesce(f"u_{c}", f"p_{c}")).when(edited[c], F.col(f"u_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in columns]
    return both.select(*keys, *values, origin.alias("origin"))
