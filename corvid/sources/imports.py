"""What files of a project import of each other, from a table of sources: specifiers by patterns, targets by joins.

Nothing is parsed: a specifier in a comment counts too. It only decides which sources are shown with a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.operators.names import by_suffix, resolved_names

#: What a JavaScript specifier may leave out, in the order in which it is tried.
SCRIPT_ENDS = ("", ".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js")
#: Fixed values by language: the separator of names, and the patterns of the file's scope, imports, wildcards and declared types.
SCOPED = {
    "java": (".", r"(?m)^\s*package\s+([\w.]+)", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;", r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\.\*\s*;", r"\b(?:class|interface|enum|record)\s+([A-Z]\w*)"),
    "csharp": (".", r"(?m)^\s*namespace\s+([\w.]+)", r"(?m)^\s*using\s+\w+\s*=\s*([\w.]+)\s*;", r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", r"\b(?:class|interface|enum|record|struct)\s+([A-Z]\w*)"),
    "php": ("\\", r"(?m)^\s*namespace\s+([\w\\]+)", r"(?m)^\s*use\s+(?:function\s+)?\\?([\w\\]+)(?:\s+as\s+\w+)?\s*;", r"(?!)()", r"\b(?:class|interface|trait|enum)\s+([A-Z]\w*)"),
}


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _without_last(parts: Column, n: Column | int = 1) -> Column:
    return F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - n))


def normal_path(parts: Column) -> Column:
    """A path of the given parts with "." and ".." carried out; what leads out of the project is dropped."""
    step = lambda way, p: F.when(p.isin("", "."), way).when(p == "..", _without_last(way)).otherwise(F.concat(way, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z]+$", "")


def script_imports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, missing) of JavaScript and TypeScript: relative specifiers by the first file that they may stand for."""
    own = files.filter(F.col("language").isin("javascript", "typescript"))
    specifier = F.explode(F.array_distinct(_all(F.col("content"), r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)['"]([^'"\n]+)['"]""")))
    named = own.select("project", "path", specifier.alias("name"))
    place = normal_path(F.concat(_without_last(F.split("path", "/")), F.split("name", "/")))
    local = named.filter(F.col("name").startswith(".")).withColumn("at", place)
    bases = F.array(F.col("at"), F.regexp_replace("at", r"\.[mc]?jsx?$", ""))  # ./x.js may be written for x.ts
    tries = F.flatten(F.transform(bases, lambda b: F.array(*(F.concat(b, F.lit(e)) for e in SCRIPT_ENDS))))
    looked = local.select("project", "path", "name", F.posexplode(tries).alias("n", "target"))
    met = looked.join(own.select("project", F.col("path").alias("target")), ["project", "target"])
    edges = met.groupBy("project", "path", "name").agg(F.min_by("target", "n").alias("target"))
    lost = named.join(edges, ["project", "path", "name"], "left_anti").select("project", "path", "name")
    return edges.select("project", "path", "target"), lost


def python_imports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, missing) of Python: modules by the end of their path; what is imported from one may be a module itself."""
    own = files.filter("language = 'python'")
    froms = r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+\(?([^\n#)]*)"
    pairs = F.arrays_zip(_all(F.col("content"), froms, 1).alias("module"), _all(F.col("content"), froms, 2).alias("names"))
    whole = F.transform(_all(F.col("content"), r"(?m)^[ \t]*import[ \t]+([\w.]+)"), lambda m: F.struct(m.alias("module"), F.lit("").alias("names")))
    found = own.select("project", "path", F.explode(F.concat(pairs, whole)).alias("i")).select("project", "path", "i.module", "i.names")
    dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    steps = F.split(_plain(F.col("path")), "/")
    package = _without_last(steps, F.when(F.element_at(steps, -1) == "__init__", dots - 1).otherwise(dots))
    rest = F.filter(F.split(F.regexp_replace("module", r"^\.+", ""), r"\."), lambda p: p != "")
    module = F.array_join(F.when(dots > 0, F.concat(package, rest)).otherwise(rest), "/")
    inside = F.filter(F.transform(F.split("names", ","), lambda x: F.regexp_extract(x, r"^\s*(\w+)", 1)), lambda x: x != "")
    asked = found.select("project", "path", module.alias("module"), inside.alias("inside"))
    ways = F.array_distinct(F.concat(F.transform("inside", lambda x: F.concat(F.col("module"), F.when(F.col("module") != "", "/").otherwise(""), x)), F.array("module")))
    named = asked.select("project", "path", "module", F.explode(ways).alias("name")).filter("name <> ''")
    plain = _plain(F.col("path"))
    modules = own.select("project", "path", F.explode(F.array_distinct(F.array(plain, F.regexp_replace(plain, "(?:^|/)__init__$", "")))).alias("module"), F.col("path").alias("ordinal"))
    index = by_suffix(named.select("project", "name"), modules, ["project"]).withColumnRenamed("path", "target")
    met = named.join(index, ["project", "name"])
    lost = named.select("project", "path", "module").distinct().join(met.select("project", "path", "module"), ["project", "path", "module"], "left_anti")
    return met.select("project", "path", "target").distinct(), lost.select("project", "path", F.translate("module", "/", ".").alias("name"))


def scoped_imports(files: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """(edges, missing) of Java, C# or PHP: the types that a file names, by import, own scope and wildcard. Ambiguous
    ones have no edge; explicit imports of what the project doesn't declare are missing."""
    separator, scope, imports, wildcards, types = SCOPED[language]
    own, text = files.filter(F.col("language") == language), F.col("content")
    last = lambda n: F.element_at(F.split(n, "\\" + separator), -1)
    facts = own.select(
        "project", "path", F.regexp_extract(text, scope, 1).alias("scope"), _all(text, imports).alias("explicit"), _all(text, wildcards).alias("wildcards"), F.array_distinct(_all(text, types)).alias("types"),
        F.array_distinct(_all(text, r"\b([A-Z]\w*)\b")).alias("names"),
    )
    table = F.map_from_entries(F.transform(F.array_distinct(F.transform("explicit", last)), lambda n: F.struct(n, F.element_at(F.filter("explicit", lambda x: last(x) == n), -1))))
    named = facts.select("project", "path", F.explode("names").alias("name"), "scope", table.alias("imports"), "wildcards").withColumn("use", F.struct("project", "path", "name"))
    declared = facts.select("project", F.explode("types").alias("type"), "scope", F.col("path").alias("declared_in"))
    symbols = declared.select("project", F.when(F.col("scope") == "", F.col("type")).otherwise(F.concat("scope", F.lit(separator), "type")).alias("symbol"), "declared_in")
    met = resolved_names(named, symbols, separator, ["project"], short=False).filter("symbol IS NOT NULL")
    edges = met.select("project", F.col("use.path").alias("path"), F.col("declared_in").alias("target")).filter("path <> target").distinct()
    lost = facts.select("project", "path", F.explode("explicit").alias("name")).join(symbols.select("project", F.col("symbol").alias("name")).distinct(), ["project", "name"], "left_anti")
    return edges, lost.select("project", "path", "name")


def go_symbols(files: DataFrame) -> DataFrame:
    """(project, folder, name, path): what the files of a Go package declare at their top and others may use."""
    own = files.filter("language = 'go'")
    folder = F.array_join(_without_last(F.split("path", "/")), "/")
    single = _all(F.col("content"), r"(?m)^(?:func|type|var|const)\s+([A-Za-z_]\w*)")
    grouped = F.flatten(F.transform(_all(F.col("content"), r"(?ms)^(?:type|var|const)\s*\((.*?)^\)"), lambda x: _all(x, r"(?m)^\t([A-Za-z_]\w*)")))
    return own.select("project", folder.alias("folder"), F.explode(F.array_distinct(F.concat(single, grouped))).alias("name"), "path").filter("name NOT IN ('main', 'init', '_')")


def go_imports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, missing) of Go: the files of a package that declare what a file uses, its own package's and imported ones'.

    An import path means the only folder of the project that ends as it does; its package goes by the alias or the last part of the
    path, without a version. Uses and declarations meet by project, folder and name."""
    own, text = files.filter("language = 'go'"), F.col("content")
    folder = F.array_join(_without_last(F.split("path", "/")), "/")
    line = r'(?m)^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([\w.\-]+(?:/[\w.\-]+)+)"\s*$'
    pairs = F.array_distinct(F.arrays_zip(_all(text, line, 1).alias("alias"), _all(text, line, 2).alias("name")))
    packages = own.select("project", "path", F.explode(pairs).alias("p")).select("project", "path", "p.alias", "p.name")
    plain = F.regexp_replace("name", r"/v[0-9]+$", "")
    packages = packages.withColumn("called", F.when(F.col("alias") != "", F.col("alias")).otherwise(F.element_at(F.split(plain, "/"), -1)))
    folders = own.select("project", folder.alias("module")).filter("module <> ''").distinct().select("project", "module", F.col("module").alias("path"), F.col("module").alias("ordinal"))
    found = by_suffix(packages.select("project", "name"), folders, ["project"], least=1, unique=True).withColumnRenamed("path", "folder")
    used = F.array_distinct(F.arrays_zip(_all(text, r"\b([A-Za-z_]\w*)\.([A-Z]\w*)", 1).alias("called"), _all(text, r"\b([A-Za-z_]\w*)\.([A-Z]\w*)", 2).alias("symbol")))
    outside = own.select("project", "path", F.explode(used).alias("u")).select("project", "path", "u.called", "u.symbol")
    outside = outside.join(packages.select("project", "path", "called", "name").join(found, ["project", "name"]), ["project", "path", "called"]).select("project", "path", "folder", F.col("symbol").alias("name"))
    inside = own.select("project", "path", folder.alias("folder"), F.explode(F.array_distinct(_all(text, r"(?<![\w.])([A-Za-z_]\w*)"))).alias("name"))
    declared = go_symbols(files).select("project", "folder", "name", F.col("path").alias("target"))
    edges = outside.unionByName(inside).distinct().join(declared, ["project", "folder", "name"]).filter("path <> target").select("project", "path", "target").distinct()
    return edges, packages.join(found, ["project", "name"], "left_anti").select("project", "path", "name")


def rust_imports(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, missing) of Rust: `use crate::a::b::C` by the only file that ends in a/b/C or else a/b, `mod x` by the file beside."""
    rust = files.filter("language = 'rust'")
    used = F.array_distinct(_all(F.col("content"), r"\buse\s+(?:crate|super|self)::([\w:]+)"))
    inner = F.transform(_all(F.col("content"), r"(?m)^\s*(?:pub(?:\([\w:]+\))?\s+)?mod\s+(\w+)\s*;"), lambda m: m)
    named = rust.select("project", "path", F.explode(F.concat(used, inner)).alias("module")).withColumn("module", F.regexp_replace(F.regexp_replace("module", ":+$", ""), "::", "/"))
    ways = F.array_distinct(F.filter(F.array(F.struct(F.lit(0).alias("n"), F.col("module").alias("name")), F.struct(F.lit(1).alias("n"), F.regexp_replace("module", "/?[^/]*$", "").alias("name"))), lambda w: w["name"] != ""))
    tries = named.select("project", "path", "module", F.explode(ways).alias("w")).select("project", "path", "module", "w.n", "w.name")
    plain = F.regexp_replace(_plain(F.col("path")), "/(?:mod|lib)$", "")
    modules = rust.select("project", "path", plain.alias("module"), F.col("path").alias("ordinal"))
    index = by_suffix(tries.select("project", "name"), modules, ["project"], unique=True).withColumnRenamed("path", "target")
    met = tries.join(index, ["project", "name"]).groupBy("project", "path", "module").agg(F.min_by("target", "n").alias("target"))
    lost = named.join(met, ["project", "path", "module"], "left_anti").select("project", "path", F.regexp_replace("module", "/", "::").alias("name"))
    return met.select("project", "path", "target").filter("path <> target").distinct(), lost


def import_edges(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges: project, path, target; missing: project, path, name) of files (project, path, language, content).

    Targets are files of the same project; missing names what no file of it stands for, such as installed packages. Relative
    and module paths are exploded into the files that they may mean and joined by equality, so no file is compared with
    another. A file may import itself only by mistake; such edges are harmless."""
    parts = [script_imports(files), python_imports(files), *(scoped_imports(files, each) for each in SCOPED), rust_imports(files), go_imports(files)]
    edges, missing = parts[0]
    for e, m in parts[1:]:
        edges, missing = edges.unionByName(e), missing.unionByName(m)
    return edges.distinct(), missing.distinct()
