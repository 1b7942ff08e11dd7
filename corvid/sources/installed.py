"""Installed packages that a project's sources import, as further sources: read by executors, followed a few steps, never run."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.operators.fixpoint import fixpoint
from corvid.session import ship
from corvid.sources import tree
from corvid.tables import stored

#: Sizes of a manifest and of a file that are read, files of a project that are shown, and steps into packages.
MOST_MANIFEST, MOST_FILE, MOST_FILES, DEPTH = 256 << 10, 2_000_000, 64, 3
#: Conditions of a package's exports that a server meets.
CONDITIONS = ("import", "node", "default")
_SPECIFIER = re.compile(r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['"]([^'"\n]+)['"]""")
_SCRIPT = re.compile(r"\.[cm]?js$")


def package_of(specifier: str) -> tuple[str, str]:
    """(package, subpath such as "." or "./x") of a specifier."""
    parts = specifier.split("/")
    n = 2 if specifier.startswith("@") else 1
    return "/".join(parts[:n]), "/".join([".", *parts[n:]])


def _by_condition(target) -> str | None:
    if isinstance(target, dict):
        return next((found for k, v in target.items() if k in CONDITIONS and (found := _by_condition(v))), None)
    return target if isinstance(target, str) else None


def entry_of(manifest: dict, subpath: str) -> str | None:
    """The file of a package, below its folder, that a subpath stands for by its manifest; None where exports don't give it away."""
    exports = manifest.get("exports")
    if exports is None:
        return (manifest.get("module") or manifest.get("main") or "index.js") if subpath == "." else subpath[2:]
    table = exports if isinstance(exports, dict) and any(k.startswith(".") for k in exports) else {".": exports}
    if subpath in table:
        return _by_condition(table[subpath])
    for pattern, target in table.items():
        head, star, tail = pattern.partition("*")
        if star and subpath.startswith(head) and subpath.endswith(tail) and len(subpath) >= len(head) + len(tail):
            found = _by_condition(target)
            return found.replace("*", subpath[len(head) : len(subpath) - len(tail)]) if found else None
    return None


class Packages:
    """Resolution of specifiers to installed files below `top`, a project's folder in a file system."""

    def __init__(self, system: fs.FileSystem, top: str):
        self.system, self.top, self.manifests = system, top, {}

    def text(self, path: str, most: int) -> str | None:
        info = self.system.get_file_info(posixpath.join(self.top, path))
        if not info.is_file or info.size > most:
            return None
        with self.system.open_input_stream(info.path) as f:
            return f.read().decode("utf-8", "replace")

    def manifest(self, folder: str) -> dict | None:
        if folder not in self.manifests:
            try:
                found = json.loads(self.text(f"{folder}/package.json", MOST_MANIFEST) or "null")
            except ValueError:
                found = None
            self.manifests[folder] = found if isinstance(found, dict) else None
        return self.manifests[folder]

    def resolved(self, importer: str, specifier: str) -> str | None:
        """The installed script, as a path below the project, that a file means by a specifier: the nearest node_modules counts."""
        folder = posixpath.dirname(importer)
        if specifier.startswith("."):
            if "node_modules/" not in importer:
                return None  # a project's own files are known
            base = posixpath.normpath(posixpath.join(folder, specifier))
            tries = [base, *(base + e for e in (".js", ".mjs", ".cjs", "/index.js"))]
        elif specifier.startswith(("/", "node:")) or ".." in specifier:
            return None
        else:
            name, subpath = package_of(specifier)
            places = [folder]
            while places[-1]:
                places.append(posixpath.dirname(places[-1]))
            home = next((h for p in places if not p.endswith("node_modules") and self.manifest(h := posixpath.join(p, "node_modules", name)) is not None), None)
            entry = entry_of(self.manifest(home), subpath) if home else None
            if not entry:
                return None
            base = posixpath.normpath(posixpath.join(home, entry))
            if not base.startswith(home + "/"):
                return None
            tries = [base, base + ".js", base + "/index.js"]
        return next((t for t in tries if "node_modules/" in t and not t.startswith("..") and _SCRIPT.search(t) and self.text(t, MOST_FILE) is not None), None)


def _resolver(root: str, projects: bool, read: bool):
    """A function of Arrow batches (project, path, name): the targets of `name`, or with `read` of all that the file itself imports."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = tree._opened_fs(root)
        known: dict[str, Packages] = {}
        for batch in batches:
            rows = set()
            for r in batch.to_pylist():
                packages = known.setdefault(r["project"], Packages(system, posixpath.join(top, r["project"]) if projects else top))
                names = [r["name"]] if not read else dict.fromkeys(_SPECIFIER.findall(packages.text(r["target"], MOST_FILE) or ""))
                at = r["target"] if read else r["path"]
                rows |= {(r["project"], at, t) for n in names if (t := packages.resolved(at, n))}
            columns = list(zip(*sorted(rows))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["project", "path", "target"])

    return run


def installed_sources(missing: DataFrame, root: str, projects: bool = False, depth: int = DEPTH, most_files: int = MOST_FILES) -> tuple[DataFrame, DataFrame]:
    """(files, edges) of installed JavaScript packages: files (project, path, language, content) and edges (project, path, target).

    missing: project, path and name of what sources import and the project doesn't hold, as import_edges gives it. Names are
    resolved as Node's documentation says, in the nearest node_modules folder, by exports, module or main. What the found
    files import is followed `depth` steps, each new file once; of a project the nearest most_files are kept. Manifests over 256 KiB
    and files over 2 MB aren't read; what can't be found or read is left out. Executors read the folders at `root`, so it has to be a
    path that they see.
    """
    ship(missing.sparkSession)
    schema = "project string, path string, target string"
    seed = stored(missing.select("project", "path", "name").filter("name IS NOT NULL").repartition("project", "name").mapInArrow(_resolver(root, projects, False), schema).distinct(), "installed")
    turn = 0

    def step(last: DataFrame) -> DataFrame:
        nonlocal turn
        turn += 1
        if turn > depth:
            return last.limit(0)
        fresh = last.select("project", "target").distinct()
        return fresh.withColumn("path", F.lit("")).withColumn("name", F.lit("")).mapInArrow(_resolver(root, projects, True), schema)

    edges = fixpoint(seed, step, ["project", "path", "target"], "installed")
    near = edges.groupBy("project", "target").agg(F.min("round").alias("round"))
    kept = near.withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("round", "target"))).filter(F.col("n") <= most_files).select("project", "target")

    def contents(batches):
        system, top = tree._opened_fs(root)
        for batch in batches:
            texts = [Packages(system, posixpath.join(top, r["project"]) if projects else top).text(r["target"], MOST_FILE) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(["javascript"] * len(texts), pa.string()), pa.array(texts, pa.string())], ["project", "path", "language", "content"])

    files = stored(kept.mapInArrow(contents, "project string, path string, language string, content string").filter("content IS NOT NULL"), "installed")
    return files, edges.select("project", "path", "target").join(kept, ["project", "target"], "left_semi")
