"""Dependency manifests as rows: what packages a project declares, and what it calls itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.dedupe import first_wins
from corvid.sources.scan import listing

#: Manifest names in the order in which they are asked, and the sections of package.json.
NAMES = ("package.json", "requirements.txt", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "Cargo.toml", "composer.json")
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
#: A line of each manifest that names a package, as (pattern, group of the name, group of the version).
LINES = {
    "requirements.txt": ((r"^\s*([A-Za-z0-9._-]+)([^#]*)", 1, 2),),
    "pyproject.toml": ((r'^\s*"([A-Za-z0-9._-]+)[<>=!~^;\[]', 1, 0), (r'^\s*([A-Za-z0-9._-]+)\s*=\s*"[^"]*"', 1, 0)),
    "go.mod": ((r"^\s*(?:require\s+)?([^\s/]\S*\.\S+)\s+(v\S+)", 1, 2),),
    "build.gradle": ((r"[\"']([A-Za-z0-9._-]+:[A-Za-z0-9._-]+)(?::([^\"']+))?[\"']", 1, 2),),
    "Cargo.toml": ((r'^\s*([A-Za-z0-9_-]+)\s*=\s*["{]', 1, 0),),
}
LINES["build.gradle.kts"] = LINES["build.gradle"]


def manifest_texts(spark: SparkSession, root: str, projects: bool = False) -> DataFrame:
    """(project, path, name, text) of manifests under root; those of .NET projects among them."""
    globs = "{" + ",".join([*NAMES, "*.csproj"]) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs).load(root)
    files = listing(spark, root, projects).join(raw.select(F.col("path").alias("url"), F.col("content").cast("string").alias("text")), "url")
    files = files.filter(~F.col("path").contains("node_modules"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    at_root = (~F.col("path").contains("/")) | name.rlike(r"\.csproj$") | (name == "package.json")
    return files.filter(at_root).select("project", "path", F.when(name.endswith(".csproj"), "*.csproj").otherwise(name).alias("name"), "text")


def _line_packages(texts: DataFrame, name: str) -> DataFrame:
    lines = texts.filter(F.col("name") == name).select("project", "path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    if name == "go.mod":
        lines = lines.filter(~F.col("line").contains("module ") & ~F.col("line").rlike(r"^\s*//"))
    out = None
    for pattern, package, version in reversed(LINES[name]):
        found = F.regexp_extract("line", pattern, package)
        row = F.struct(F.trim(F.lower(found)).alias("package"), (F.trim(F.regexp_extract("line", pattern, version)) if version else F.lit("")).alias("version"))
        out = F.when(found != "", row) if out is None else F.when(found != "", row).otherwise(out)
    return lines.withColumn("p", out).filter("p IS NOT NULL AND NOT line RLIKE '^\\\\s*-'").select("project", "path", "pos", "p.package", "p.version")


def _json_packages(texts: DataFrame, name: str, sections: tuple[str, ...], lower: bool) -> DataFrame:
    kept = texts.filter(F.col("name") == name)
    out = None
    for n, section in enumerate(sections):
        found = kept.select("project", "path", F.posexplode(F.from_json(F.get_json_object("text", f"$['{section}']"), "map<string,string>")).alias("pos", "package", "version"))
        found = found.withColumn("pos", F.col("pos") + n * 100_000)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("package", F.lower("package")) if lower else out


def _tag_packages(texts: DataFrame, name: str, pattern: str, package: Column, version: Column) -> DataFrame:
    tags = texts.filter(F.col("name") == name).select("project", "path", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("pos", "tag"))
    return tags.select("project", "path", "pos", F.lower(package).alias("package"), version.alias("version"))


def packages(texts: DataFrame) -> DataFrame:
    """(project, package, version) over all manifests, the first mention of a package winning."""
    inner = lambda tag: F.trim(F.regexp_extract("tag", rf"<{tag}>([^<]*)</{tag}>", 1))
    found = [_json_packages(texts, "package.json", SECTIONS, False)]
    found += [_line_packages(texts, n) for n in ("requirements.txt", "pyproject.toml", "go.mod")]
    found.append(_tag_packages(texts, "pom.xml", r"(?s)<(?:dependency|parent|plugin)>.*?</(?:dependency|parent|plugin)>", F.concat(inner("groupId"), F.lit(":"), inner("artifactId")), inner("version")))
    found += [_line_packages(texts, n) for n in ("build.gradle", "build.gradle.kts")]
    attribute = lambda a: F.regexp_extract("tag", rf'{a}="([^"]*)"', 1)
    found.append(_tag_packages(texts, "*.csproj", r"<(?:PackageReference|FrameworkReference)[^>]*>", attribute("Include"), attribute("Version")))
    found.append(_line_packages(texts, "Cargo.toml"))
    found.append(_json_packages(texts, "composer.json", ("require", "require-dev"), True))
    out = None
    for n, df in enumerate(found):
        df = df.withColumn("at", F.struct(F.lit(n).alias("kind"), F.size(F.split("path", "/")).alias("depth"), "path", F.col("pos").cast("long").alias("pos")))
        out = df if out is None else out.unionByName(df)
    out = out.filter("package <> ''")
    best = out.groupBy("project", "package").agg(F.min_by("version", "at").alias("version"))
    return best


def project_meta(texts: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, title, version): from package.json, pyproject.toml or go.mod at the root, else the defaults."""
    root = texts.filter(~F.col("path").contains("/"))
    field = lambda name: F.get_json_object("text", f"$.{name}")
    toml = lambda name: F.nullif(F.regexp_extract("text", rf'(?m)^\s*{name}\s*=\s*"([^"]+)"', 1), F.lit(""))
    module = F.nullif(F.regexp_extract("text", r"(?m)^module\s+(?:\S*/)?([^/\s]+)", 1), F.lit(""))
    title = F.when(F.col("name") == "package.json", field("name")).when(F.col("name") == "pyproject.toml", toml("name")).when(F.col("name") == "go.mod", module)
    version = F.when(F.col("name") == "package.json", field("version")).when(F.col("name") == "pyproject.toml", toml("version"))
    rank = F.when(F.col("name") == "package.json", 0).when(F.col("name") == "pyproject.toml", 1).otherwise(2)
    named = root.select("project", title.alias("title"), version.alias("version"), rank.alias("rank")).filter("title IS NOT NULL")
    best = first_wins(named, ["project"], F.col("rank"))
    return projects.select("project").distinct().join(best, "project", "left").select("project", F.coalesce("title", F.lit("Scanned API")).alias("title"), F.coalesce("version", F.lit("1.0.0")).alias("version"))


def gated_projects(found: DataFrame, hints: DataFrame) -> DataFrame:
    """(project, framework) where a framework's package hint is declared: a semi-join on (framework, package)."""
    return found.select("project", "package").join(hints, "package").select("project", "framework").distinct()
