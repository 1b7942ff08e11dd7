"""Framework packs: extractors from a project's files to route candidates.

A pack is a function of {path: text} to a Found; `extract` runs packs over the projects of a files table, one group a
project, and a pack that fails leaves an unresolved row instead of stopping the scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATES = "project string, framework string, ordinal long, kind string, name string, value string"


@dataclass
class Found:
    """What a pack found in a project: candidates, unresolved remarks, components and security schemes."""

    routes: list[dict] = field(default_factory=list)
    unresolved: list[dict] = field(default_factory=list)
    components: dict[str, object] = field(default_factory=dict)
    security: dict[str, object] = field(default_factory=dict)
    servers: list[str] = field(default_factory=list)

    def remark(self, reason: str, message: str, file: str = "", line: int = 0) -> None:
        self.unresolved.append({"reason": reason, "message": message, "file": file, "line": line})


Pack = Callable[[Mapping[str, str]], Found]


def registry() -> dict[str, tuple[str, Pack]]:
    """framework -> (language, pack), in the order in which packs are asked."""
    from corvid.packs import fastapi, flask, go, java, js, others, starlette

    return {
        "fastapi": ("python", fastapi.extract), "flask": ("python", flask.extract), "starlette": ("python", starlette.extract),
        **{name: ("javascript", pack) for name, pack in js.PACKS.items()}, **others.PACKS,
        **{name: ("go", pack) for name, pack in go.PACKS.items()}, **{name: ("java", pack) for name, pack in java.PACKS.items()},
    }


def extract(files: DataFrame, gates: DataFrame, counts=None) -> DataFrame:
    """Rows (project, framework, ordinal, kind, name, value as JSON) for the (project, framework) pairs in `gates`.

    kind is route, unresolved, component, security or server. Files are filtered to gated projects and the framework's
    language before they are grouped, and a pack sees them by their ordinal, if they have one, and path. `counts` is an accumulator of {name: n}: routes by
    framework, and failures of packs as "!framework"."""
    also = {"javascript": ("javascript", "typescript", "prisma"), "php": ("php", "yaml")}
    languages = [(f, each) for f, (lang, _) in registry().items() for each in also.get(lang, (lang,))]
    wanted = gates.join(files.sparkSession.createDataFrame(languages, "framework string, language string"), "framework")
    at = F.col("ordinal") if "ordinal" in files.columns else F.lit(0).alias("ordinal")
    chosen = files.select("project", "path", "content", "language", at).join(wanted, ["project", "language"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        project, framework = key
        try:
            found = registry()[framework][1]({p: c for _, p, c in sorted(zip(pdf["ordinal"], pdf["path"], pdf["content"]))})
            if not found.routes:
                found.remark("handler-unresolved", f"{framework} is there but no route was found")
        except Exception as error:  # a pack's failure is a remark about the project
            found = Found()
            found.remark("extraction-failed", f"{framework}: {type(error).__name__}: {error}")
            if counts is not None:
                counts.add({f"!{framework}": 1})
        if counts is not None and found.routes:
            counts.add({framework: len(found.routes)})
        rows = [("route", r["operation_id"], r) for r in found.routes] + [("unresolved", r["reason"], r) for r in found.unresolved]
        rows += [("component", n, s) for n, s in found.components.items()] + [("security", n, s) for n, s in found.security.items()] + [("server", u, u) for u in found.servers]
        return pd.DataFrame([(project, framework, n, kind, name, json.dumps(value)) for n, (kind, name, value) in enumerate(rows)], columns=["project", "framework", "ordinal", "kind", "name", "value"])

    return chosen.groupBy("project", "framework").applyInPandas(run, CANDIDATES)
