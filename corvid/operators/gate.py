"""The completeness gate: grading route candidates and recording what is not proven."""

from __future__ import annotations

import copy
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions.schemas import has_unknown

#: Gaps that leave a candidate at low confidence, and those that take it from high to medium.
LOW_GAPS = frozenset({"body-unknown", "response-unknown", "path-dynamic"})
MEDIUM_GAPS = frozenset({"body-schema-unknown", "response-schema-unknown", "query-unknown", "sse-events-unknown", "path-param-untyped"})
#: Statuses whose responses have no body, and media types that need no schema.
BODYLESS = re.compile(r"1..|204|205|304")
FREE_TEXT = frozenset({"text/html", "text/plain", "text/css"})
EVENTS = "text/event-stream"


def downgraded(confidence: str) -> str:
    return "medium" if confidence == "high" else "low"


def _media_typed(media: dict, components, gaps: set) -> bool:
    """Whether a response's media type says what it carries; notes what it doesn't."""
    base = media.get("media_type", "").partition(";")[0].strip().lower()
    shape = media.get("item_schema") if media.get("item_schema") is not None else media.get("schema")
    events = base == EVENTS
    if shape is not None:
        if has_unknown(shape, components):
            gaps.add("sse-events-unknown" if events else "response-schema-unknown")
        return True
    if events:
        gaps.add("sse-events-unknown")
        return True
    return base in FREE_TEXT


def gated(candidate: Mapping, components: Mapping | None = None) -> dict:
    """The candidate with its gaps found, its path parameters declared and its confidence graded; idempotent."""
    out = copy.deepcopy(dict(candidate))
    gaps = set(out.get("gaps") or ())
    declared = {p["name"]: p for p in out.get("parameters") or [] if p["in"] == "path"}
    out["parameters"] = list(out.get("parameters") or [])
    for name in re.findall(r"\{([^}]+)\}", out["full_path"]):
        if name not in declared:
            declared[name] = {"name": name, "in": "path", "required": True, "schema": {"type": "string"}, "confidence": "low"}
            out["parameters"].append(declared[name])
        elif declared[name].get("schema") is None:
            declared[name].update(schema={"type": "string"}, confidence=downgraded(declared[name]["confidence"]))
    out["parameters"] = [declared.get(p["name"], p) if p["in"] == "path" else p for p in out["parameters"]]
    body = out.get("request_body")
    if body and (not body.get("content") or any(has_unknown(m.get("schema"), components) for m in body["content"])):
        gaps.add("body-schema-unknown")
    responses = out["responses"] = list(out.get("responses") or [])
    if not responses:
        gaps.add("response-unknown")
    typed = []
    for r in responses:
        bodyless = bool(BODYLESS.fullmatch(str(r["status_code"])))
        media = [] if bodyless else [_media_typed(m, components, gaps) for m in r.get("content") or []]
        typed.append(all(media))
        if bodyless:
            r.pop("content", None)
    if not all(typed):
        gaps.add("response-schema-unknown")
    if responses and all(BODYLESS.fullmatch(str(r["status_code"])) for r in responses):
        gaps.discard("response-schema-unknown")
    if gaps & LOW_GAPS:
        out["confidence"] = "low"
    elif gaps & MEDIUM_GAPS and out.get("confidence") == "high":
        out["confidence"] = "medium"
    out["gaps"] = sorted(gaps)
    return out


def graded(confidence: Column, gaps: Column) -> Column:
    """The grade of a candidate by its gaps alone, as a Column: the last step of the gate on flat tables."""
    low = F.arrays_overlap(gaps, F.array(*map(F.lit, sorted(LOW_GAPS))))
    medium = F.arrays_overlap(gaps, F.array(*map(F.lit, sorted(MEDIUM_GAPS))))
    return F.when(low, "low").when(medium & (confidence == "high"), "medium").otherwise(confidence)


def gap_array(*named: tuple[str, Column]) -> Column:
    """The names whose conditions hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in named)), lambda g: g.isNotNull())
