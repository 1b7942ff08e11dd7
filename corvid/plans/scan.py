"""From a source tree to a graded inventory and its document: the whole scan as one plan."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.schemas import fingerprint, hoisted, without_hazards
from corvid.operators.dedupe import first_wins, free_names
from corvid.operators.gate import gated
from corvid.operators.nodes import unknown_schemas
from corvid.operators.score import frameworks, scan_report
from corvid.packs import extract, registry
from corvid.plans.context import review_contexts
from corvid.plans.progress import Progress
from corvid.sources import manifests
from corvid.sources.imports import import_edges
from corvid.sources.installed import installed_sources
from corvid.sources.scan import index_files, index_with_roots, listing
from corvid.tables import dropped, shared_dir, stored

#: Packages that hint at a framework, and imports that show one without a manifest.
HINTS: dict[str, tuple[str, ...]] = {
    "fastapi": ("fastapi",), "flask": ("flask",), "starlette": ("starlette",), "djangorestframework": ("djangorestframework",), "express": ("express",), "fastify": ("fastify",), "nest": ("@nestjs/core", "@nestjs/common"),
    "hono": ("hono", "@hono/zod-openapi"), "koa": ("koa", "@koa/router", "koa-router"), "nextjs": ("next",), "elysia": ("elysia",), "gin": ("github.com/gin-gonic/gin",), "chi": ("github.com/go-chi/chi", "github.com/go-chi/chi/v5"),
    "gorillamux": ("github.com/gorilla/mux",), "echo": ("github.com/labstack/echo/v4", "github.com/labstack/echo"), "fiber": ("github.com/gofiber/fiber/v2", "github.com/gofiber/fiber/v3"),
    "spring": ("org.springframework.boot:spring-boot-starter-web", "org.springframework.boot:spring-boot-starter-parent"), "jaxrs": ("jakarta.ws.rs:jakarta.ws.rs-api", "io.quarkus:quarkus-resteasy"), "micronaut": ("io.micronaut:micronaut-http-server-netty",),
    "aspnet": ("microsoft.aspnetcore.app", "microsoft.aspnetcore.openapi"), "fastendpoints": ("fastendpoints",), "axum": ("axum",), "actix": ("actix-web",), "rocket": ("rocket",), "laravel": ("laravel/framework",), "symfony": ("symfony/framework-bundle",), "slim": ("slim/slim",),
}
EVIDENCE: dict[str, tuple[str, str]] = {
    "fastapi": ("python", r"\bfrom\s+fastapi\b|\bimport\s+fastapi\b"), "flask": ("python", r"\bfrom\s+flask\b|\bimport\s+flask\b"), "starlette": ("python", r"\bfrom\s+starlette\b"), "djangorestframework": ("python", r"\bfrom\s+rest_framework\b"),
    "express": ("javascript", r"['\"]express['\"]"), "fastify": ("javascript", r"['\"]fastify['\"]"), "nest": ("javascript", r"['\"]@nestjs/common['\"]"), "hono": ("javascript", r"['\"](?:hono|@hono/zod-openapi)['\"]"), "koa": ("javascript", r"['\"](?:koa|@koa/router|koa-router)['\"]"),
    "nextjs": ("javascript", r"['\"]next/server['\"]|\bNextApiRequest\b"), "elysia": ("javascript", r"['\"]elysia['\"]"), "gin": ("go", "github.com/gin-gonic/gin"), "chi": ("go", "github.com/go-chi/chi"), "gorillamux": ("go", "github.com/gorilla/mux"), "echo": ("go", "github.com/labstack/echo"),
    "fiber": ("go", "github.com/gofiber/fiber"), "nethttp": ("go", r"http\.(?:HandleFunc|Handle|NewServeMux)\("), "spring": ("java", r"org\.springframework\.(?:web|stereotype)"), "jaxrs": ("java", r"(?:jakarta|javax)\.ws\.rs"), "micronaut": ("java", r"io\.micronaut\.http"),
    "aspnet": ("csharp", r"Microsoft\.AspNetCore|WebApplication\.CreateBuilder|ControllerBase"), "fastendpoints": ("csharp", r"\bFastEndpoints\b"), "axum": ("rust", r"\buse\s+axum\b|axum::"), "actix": ("rust", r"\bactix_web\b"), "rocket": ("rust", r"\brocket::|#\[macro_use\]\s*extern crate rocket"),
    "laravel": ("php", r"Illuminate\\"), "symfony": ("php", r"Symfony\\"), "slim": ("php", r"Slim\\"),
}
#: Packs that yield where another claims the project.
YIELDS = {"express": ("nest",), "fastify": ("nest",), "starlette": ("fastapi",), "nethttp": ("gin", "chi", "gorillamux", "echo", "fiber")}


def gates(files: DataFrame, packages: DataFrame, frameworks: Sequence[str] | None = None) -> DataFrame:
    """(project, framework): a hinting package is declared or a file shows the framework; yielding packs are left out."""
    spark = files.sparkSession
    hints = spark.createDataFrame([(f, p) for f, ps in HINTS.items() for p in ps], "framework string, package string")
    declared = manifests.gated_projects(packages, hints)
    text = F.when(F.col("language") == "typescript", "javascript").otherwise(F.col("language"))
    shown = F.array(*(F.when((text == lang) & F.col("content").rlike(pattern), F.lit(f)) for f, (lang, pattern) in EVIDENCE.items()))
    seen = files.select("project", F.explode(F.filter(shown, lambda f: f.isNotNull())).alias("framework")).distinct()
    found = without_yielding(declared.unionByName(seen).distinct(), YIELDS)
    return asked(found, frameworks) if frameworks else found


def without_yielding(found: DataFrame, yields: Mapping[str, Sequence[str]]) -> DataFrame:
    """(project, framework) without those that yield to another framework of the same project."""
    pairs = [(a, b) for a, bs in yields.items() for b in bs]
    other = F.explode(F.array(*(F.struct(F.lit(a).alias("framework"), F.lit(b).alias("other")) for a, b in pairs)))
    yielding = found.select("project", F.col("framework").alias("claimed")).select("project", "claimed", other.alias("y")).filter("claimed = y.other")
    return found.join(yielding.select("project", "y.framework").distinct(), ["project", "framework"], "left_anti")


def asked(found: DataFrame, frameworks: Sequence[str]) -> DataFrame:
    """What the caller named of what was found."""
    return found.filter(F.col("framework").isin(*frameworks))


@dataclass
class Scan:
    """The tables of a scan. operations: project, framework, ordinal, method, path, operation_id, file, confidence, gaps,
    candidate (JSON); components: project, name, schema; unresolved: project, framework, reason, message, file."""

    files: DataFrame
    packages: DataFrame
    operations: DataFrame
    components: DataFrame
    security: DataFrame
    servers: DataFrame
    unresolved: DataFrame
    meta: DataFrame
    candidates: DataFrame | None = None
    root: str | None = None
    projects: bool = False

    def close(self) -> None:
        """Delete the tables that the scan wrote; nothing of it can be read afterwards."""
        for df in (self.files, self.candidates):
            if df is not None:
                dropped(df)

    def frameworks(self) -> DataFrame:
        """(project, frameworks) of the operations found."""
        return frameworks(self.operations)

    def unknown_components(self) -> DataFrame:
        """(project, name, unknown) of components: whether any part of the shape isn't known, references followed."""
        return unknown_schemas(self.components.select("project", "name", "schema"), ["project"])

    def contexts(self, lines: int = 60, chars: int = 8_192, installed: bool = False) -> DataFrame:
        """(project, route, files, unavailable, limitations): the sources that go with a question about each operation with
        gaps; see review_contexts. The handler's text is the file from the line of its declaration on, up to `lines` lines. With
        `installed`, JavaScript packages under the scan's root are followed as well."""
        asked = self.operations.filter(F.size("gaps") > 0).select("project", F.concat(F.upper("method"), F.lit(" "), "path").alias("route"), "file", F.get_json_object("candidate", "$.origin.line").cast("int").alias("line"))
        first = asked.groupBy("project", "route").agg(F.min(F.struct("file", "line")).alias("at")).select("project", "route", F.col("at.file").alias("origin"), F.col("at.line").alias("line"))
        held = first.join(self.files.select("project", F.col("path").alias("origin"), "content"), ["project", "origin"], "left")
        text = F.substring(F.array_join(F.slice(F.split("content", "\n"), F.greatest(F.lit(1), F.coalesce("line", F.lit(1))), F.lit(lines)), "\n"), 1, chars)
        routes = held.select("project", "route", "origin", text.alias("handler"))
        if not installed or self.root is None:
            return review_contexts(routes, self.files)
        edges, missing = (stored(x, "imports") for x in import_edges(self.files))
        more, ways = installed_sources(missing, self.root, self.projects)
        found = missing.join(ways.select("project", "path").distinct(), ["project", "path"], "left_anti")
        return review_contexts(routes, self.files.select(*more.columns).unionByName(more), edges.unionByName(ways), found)

    def report(self) -> DataFrame:
        return scan_report(self.operations)

    def snapshot(self) -> tuple[DataFrame, DataFrame]:
        """(files: path, hash; routes: key, method, path, operation_id, file, fingerprint) of a scan, to diff with another's."""
        return self.files.select("project", "path", "hash"), routes_snapshot(self)


def _assembled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations and components by project: definitions hoisted, candidates gated, hazards stripped, names told apart.

    A project's routes and components meet in one group, which is the unit that its packs work on as well."""
    kinds = rows.filter(F.col("kind").isin("route", "component"))
    schema = "project string, kind string, framework string, ordinal long, name string, value string"

    def run(table: pa.Table) -> pa.Table:
        order = list(registry())
        data = sorted(table.to_pylist(), key=lambda r: (order.index(r["framework"]), r["ordinal"]))
        components: dict = {}
        for r in data:
            if r["kind"] == "component":
                components.setdefault(r["name"], json.loads(r["value"]))
        for name in list(components):
            components[name] = hoisted(components[name], components)
        routes = [(r["framework"], gated(json.loads(r["value"]), components)) for r in data if r["kind"] == "route"]
        names = free_names([c["operation_id"] for _, c in routes])
        out = []
        for n, ((framework, c), name) in enumerate(zip(routes, names)):
            out.append({"project": data[0]["project"], "kind": "route", "framework": framework, "ordinal": n, "name": name, "value": json.dumps(without_hazards({**c, "operation_id": name}))})
        for n, (name, s) in enumerate(components.items()):
            out.append({"project": data[0]["project"], "kind": "component", "framework": "", "ordinal": n, "name": name, "value": json.dumps(without_hazards(s))})
        types = pa.schema([("project", pa.string()), ("kind", pa.string()), ("framework", pa.string()), ("ordinal", pa.int64()), ("name", pa.string()), ("value", pa.string())])
        return pa.Table.from_pylist(out, schema=types)

    both = kinds.groupBy("project").applyInArrow(run, schema)
    j = lambda path: F.get_json_object("value", path)
    operations = both.filter("kind = 'route'").select(
        "project", "framework", "ordinal", j("$.method").alias("method"), j("$.full_path").alias("path"), F.col("name").alias("operation_id"), j("$.origin.file").alias("file"),
        j("$.confidence").alias("confidence"), F.from_json(j("$.gaps"), "array<string>").alias("gaps"), F.col("value").alias("candidate"),
    )
    return operations, both.filter("kind = 'component'").select("project", "name", F.col("value").alias("schema"), "ordinal")


def scan_project(spark: SparkSession, root: str, projects: bool = False, frameworks: Sequence[str] | None = None, on_progress: Callable[[str, str], None] | None = None, extra_roots: Sequence[str] = (), **options) -> Scan:
    """Scan the sources under root. With `projects`, each folder of root is a project and all are scanned in one job.

    Options are those of index_files. A project without any known framework or route has no operations and, if a pack was
    there, a remark. Files and candidates are written to the shared folder once; Scan.close() deletes them. on_progress is told
    of phases ("index", "extract", "done"), and, while packs run, of routes in batches and of packs that fail."""
    tell = on_progress or (lambda phase, detail: None)
    shared_dir(spark)
    tell("index", root)
    files, skipped = index_with_roots(spark, root, extra_roots, **options) if extra_roots else index_files(spark, root, projects, **options)
    files = stored(files, "files")
    texts = manifests.manifest_texts(spark, root, projects)
    packages = manifests.packages(texts)
    tell("extract", root)
    with Progress(spark, tell) as progress:
        rows = stored(extract(files, gates(files, packages, frameworks), progress.counts), "candidates")
    operations, components = _assembled(rows)
    j = lambda path: F.get_json_object("value", path)
    remarks = rows.filter("kind = 'unresolved'").select("project", "framework", j("$.reason").alias("reason"), j("$.message").alias("message"), j("$.file").alias("file"))
    unresolved = remarks.unionByName(skipped.withColumn("framework", F.lit("")))
    security = first_wins(rows.filter("kind = 'security'").select("project", "name", F.col("value").alias("scheme"), "ordinal"), ["project", "name"], F.col("ordinal"))
    servers = first_wins(rows.filter("kind = 'server'").select("project", F.col("name").alias("url"), "ordinal"), ["project", "url"], F.col("ordinal"))
    tell("done", root)
    return Scan(files, packages, operations, components, security, servers, unresolved, manifests.project_meta(texts, files), rows, root, projects)


#: Folders of a workspace that hold leaves, folders that may be one themselves, manifests that mark them, most leaves.
LEAF_PARENTS, LEAF_NAMES, LEAF_MANIFESTS, MOST_LEAVES = ("packages", "apps", "services"), ("server", "api", "app", "src"), manifests.NAMES, 40


def workspace_leaves(spark: SparkSession, root: str, most: int = MOST_LEAVES) -> list[str]:
    """Folders one level down that look like projects of their own, in order of their paths; a bounded list."""
    parents, names = "|".join(LEAF_PARENTS), "|".join(LEAF_NAMES)
    marked = "|".join(m.replace(".", r"\.") for m in LEAF_MANIFESTS)
    leaf = F.regexp_extract("path", rf"^((?:{parents})/[^/]+|(?:{names}))/(?:{marked}|[^/]+\.csproj)$", 1)
    return [r.leaf for r in listing(spark, root).select(leaf.alias("leaf")).filter("leaf <> ''").distinct().orderBy("leaf").limit(most).collect()]


def scan_workspace(spark: SparkSession, root: str, **options) -> tuple[DataFrame, list[Scan]]:
    """(operations, scans): the root's own, or, if it has no operations, those of its leaves, the first leaf winning."""
    whole = scan_project(spark, root, **options)
    if not whole.operations.isEmpty():
        return whole.operations, [whole]
    scans = [scan_project(spark, f"{root.rstrip('/')}/{leaf}", **options) for leaf in workspace_leaves(spark, root)]
    out = whole.operations.withColumn("leaf", F.lit(0))
    for n, found in enumerate(scans, 1):
        out = out.unionByName(found.operations.withColumn("leaf", F.lit(n)))
    return first_wins(out, ["method", "path"], F.struct("leaf", "ordinal")).drop("leaf"), scans


def routes_snapshot(scan: Scan) -> DataFrame:
    """Per operation its key and the fingerprint of its file and contract."""
    hashes = scan.files.select("project", F.col("path").alias("file"), "hash")
    ops = scan.operations.join(hashes, ["project", "file"], "left").select("project", "method", "path", "operation_id", "file", "hash", "candidate")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = {n: json.loads(s) for n, s in zip(right.column("name").to_pylist(), right.column("schema").to_pylist())}
        rows = left.to_pylist()
        prints = [fingerprint(r["hash"] or "", json.loads(r["candidate"]), known) for r in rows]
        keep = left.select(["project", "method", "path", "operation_id", "file"])
        return keep.append_column("key", pa.array([f"{r['method']} {r['path']}" for r in rows], pa.string())).append_column("fingerprint", pa.array(prints, pa.string()))

    grouped = ops.groupBy("project").cogroup(scan.components.select(F.col("project").alias("owner"), "name", "schema").groupBy("owner"))
    return grouped.applyInArrow(run, "project string, method string, path string, operation_id string, file string, key string, fingerprint string")


def write_snapshot(scan: Scan, path: str) -> None:
    """The snapshot of a scan as two Parquet tables, files and routes, replacing an earlier one at `path`."""
    for name, df in zip(("files", "routes"), scan.snapshot()):
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path.rstrip('/')}/files"), spark.read.parquet(f"{path.rstrip('/')}/routes")


def operation_object(candidate: Mapping) -> dict:
    """An OpenAPI operation from a candidate: empty descriptions and schemas are left out, missing required is false."""
    media = lambda items: {m["media_type"]: {k: m[s] for s, k in (("schema", "schema"), ("item_schema", "itemSchema")) if m.get(s)} for m in items or []}
    out: dict = {"operationId": candidate["operation_id"], "tags": candidate.get("tags") or []}
    if candidate.get("description"):
        out["description"] = candidate["description"]
    out["parameters"] = [{"name": p["name"], "in": p["in"], "required": bool(p.get("required")), **({"description": p["description"]} if p.get("description") else {}), **({"schema": p["schema"]} if p.get("schema") else {})} for p in candidate.get("parameters") or []]
    body = candidate.get("request_body")
    if body:
        out["requestBody"] = {"required": bool(body.get("required")), "content": media(body.get("content"))}
    out["responses"] = {r["status_code"]: {"description": r.get("description") or "", **({"content": c} if (c := media(r.get("content"))) else {})} for r in candidate.get("responses") or []} or {"default": {"description": "not proven"}}
    if candidate.get("security"):
        out["security"] = candidate["security"]
    return out | {k: v for k, v in candidate.items() if k.startswith("x-")} | ({"x-gaps": candidate["gaps"]} if candidate.get("gaps") else {})


def documents(scan: Scan) -> DataFrame:
    """(project, document): an OpenAPI 3.2 document as JSON for each project with operations."""
    pick = lambda df, name, value: df.groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias(value))
    ops = scan.operations.groupBy("project").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "candidate"))), lambda o: o["candidate"]).alias("operations"))
    joined = ops.join(scan.meta, "project", "left").join(pick(scan.components, "name", "schema"), "project", "left").join(pick(scan.security, "name", "scheme"), "project", "left")
    joined = joined.join(scan.servers.groupBy("project").agg(F.sort_array(F.collect_set("url")).alias("servers")), "project", "left")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                doc: dict = {"openapi": "3.2.0", "info": {"title": r["title"], "version": r["version"]}}
                if r["servers"]:
                    doc["servers"] = [{"url": u} for u in r["servers"]]
                paths = doc["paths"] = {}
                for c in map(json.loads, r["operations"]):
                    paths.setdefault(c["full_path"], {}).setdefault(c["method"], operation_object(c))
                parts = {"schemas": {k: json.loads(v) for k, v in sorted(r["schema"] or [])}, "securitySchemes": {k: json.loads(v) for k, v in sorted(r["scheme"] or [])}}
                doc["components"] = {k: v for k, v in parts.items() if v}
                out.append(json.dumps(doc))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["project", "document"])

    return joined.select("project", "title", "version", "operations", "schema", "scheme", "servers").mapInArrow(run, "project string, document string")


def write_documents(scan: Scan, path: str) -> None:
    """A JSON text file a project, in folders by project."""
    documents(scan).select("project", F.col("document").alias("value")).write.partitionBy("project").mode("overwrite").text(path)
