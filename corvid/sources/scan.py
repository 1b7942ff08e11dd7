"""Source trees as DataFrames: which files of a project are analysed, decoded and hashed.

Listing and rules are relational: what lies in a directory is a table derived from the listing, so build output is
recognised by joins, and contents are read for files that pass name and size filters only.
"""

from __future__ import annotations

import itertools
import posixpath
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.sources import tree
from corvid.sources.rules import BESIDE_DIST, BESIDE_TARGET, COMPILED, BUNDLED, CONFIG_FILE, IGNORE_FILES, IGNORED_DIRS, INSIDE_DIST, INSIDE_TARGET, LANGUAGES, PRISMA_FILE, PROJECT_FILE, TEST_FILE, ignored
from corvid.tables import stored

#: The default budgets of a scan.
MAX_FILE_BYTES, MAX_FILES, MAX_TOTAL_BYTES = 2 << 20, 10_000, 64 << 20


class BudgetExceeded(ValueError):
    """A project is larger than the scan may be."""


def listing(spark: SparkSession, root: str, projects: bool = False) -> DataFrame:
    """(project, path, length, url) of all files under root; with `projects`, root's folders are projects of their own.

    Contents aren't read: the column is pruned. Spark lists no empty files, which hold nothing to analyse."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("url"), "length")
    top = re.sub(r"^file:/*", "/", root).rstrip("/")
    inside = F.regexp_replace(F.regexp_replace("url", r"^[a-z0-9+.-]+:/*(?:[^/]*(?=/" + re.escape(top.lstrip("/")) + "))?", "/"), "^" + re.escape(top) + "/", "")
    if not projects:
        return files.select(F.lit(top.rsplit("/", 1)[-1]).alias("project"), inside.alias("path"), "length", "url")
    return files.select(F.regexp_extract(inside, "^([^/]+)/", 1).alias("project"), F.regexp_replace(inside, "^[^/]+/", "").alias("path"), "length", "url")


def entries(files: DataFrame) -> DataFrame:
    """(project, dir, entry): what each directory holds, derived from the listing."""
    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n - 1), "/").alias("dir"), F.get(parts, n - 1).alias("entry")))
    return files.select("project", F.explode(steps).alias("s")).select("project", "s.dir", "s.entry").distinct()


def _within(dir_: Column, name: Column) -> Column:
    return F.when(dir_ == "", name).otherwise(F.concat(dir_, F.lit("/"), name))


def built_dirs(files: DataFrame) -> DataFrame:
    """(project, dir) of build output and virtual environments: directories with a telling name and telling marks."""
    held = entries(files)
    named = held.filter(F.col("entry").isin("dist", "build", "out", "target", "bin", "obj", "env", "venv"))
    named = named.select("project", F.col("dir").alias("parent"), F.col("entry").alias("name"), _within(F.col("dir"), F.col("entry")).alias("dir"))
    inside = held.groupBy("project", "dir").agg(F.collect_set("entry").alias("inside"))
    beside = inside.select("project", F.col("dir").alias("parent"), F.col("inside").alias("beside"))
    known = named.join(inside, ["project", "dir"]).join(beside, ["project", "parent"])
    some = lambda c, names: F.arrays_overlap(c, F.array(*map(F.lit, names)))
    match = lambda c, pattern: F.exists(c, lambda e: e.rlike(pattern))
    n = F.col("name")
    built = (
        F.when(n == "target", some("beside", BESIDE_TARGET) | some("inside", INSIDE_TARGET))
        .when(n.isin("bin", "obj"), match("beside", PROJECT_FILE) | some("inside", ("Debug", "Release")) | match("inside", COMPILED))
        .when(n.isin("env", "venv"), some("inside", ("pyvenv.cfg", "activate")) | (F.array_contains("inside", "bin") & F.array_contains("inside", "lib")))
        .otherwise(some("beside", BESIDE_DIST) & (some("inside", INSIDE_DIST) | match("inside", BUNDLED)))
    )
    return known.filter(built).select("project", "dir")


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    out = F.when(path.rlike(CONFIG_FILE), "yaml").when(path.rlike(PRISMA_FILE), "prisma")
    for name in dict.fromkeys(LANGUAGES.values()):
        out = out.when(ext.isin(*(e for e, v in LANGUAGES.items() if v == name)), name)
    return out


def ignore_rules(spark: SparkSession, root: str, projects: bool = False, names: Sequence[str] = IGNORE_FILES) -> DataFrame:
    """(project, folder, text) of ignore files in folders of any depth. Spark's readers skip hidden files, so they are
    found by globs of the file system itself, on the driver, as Spark's own listing is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(path).toUri().getPath().rstrip("/")
    rows = []
    for n in itertools.count():
        if n and not any(s.isDirectory() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*" * n)) or ()):
            break
        for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{'*/' * n}{{{','.join(names)}}}")) or ():
            inside = status.getPath().toUri().getPath()[len(top) + 1 :].rpartition("/")[0]
            project, _, folder = inside.partition("/") if projects else (top.rsplit("/", 1)[-1], "", inside)
            stream = fs.open(status.getPath())
            try:
                rows.append((project, folder, spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return spark.createDataFrame(rows, "project string, folder string, text string")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 by its mark, else UTF-8; null for binary content."""
    mark, size = F.hex(F.substring(content, 1, 2)), F.octet_length(content)
    rest = F.substring(content, 3, 2**31 - 1)
    wide = lambda charset: F.when(size % 2 == 0, F.decode(rest, charset))
    text = F.when(mark == "FFFE", wide("UTF-16LE")).when(mark == "FEFF", wide("UTF-16BE")).otherwise(F.decode(F.when(F.try_validate_utf8(content.cast("string")).isNotNull(), content).otherwise(F.lit(None)), "UTF-8"))
    return F.when(F.instr(text, F.char(F.lit(0))) == 0, text)


def in_locale(name: Column | str) -> Column:
    """What to order names by so that they stand as a reader expects, not by their bytes: a, A, b, é, f."""
    return F.collate(name, "UNICODE")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def too_large(length: Column, most: int = MAX_FILE_BYTES) -> Column:
    return length > most


def budget_use(files: DataFrame, max_files: int = MAX_FILES, max_total_bytes: int = MAX_TOTAL_BYTES) -> DataFrame:
    """(project, files, bytes, over) of files (project, length): what a scan would read, and whether that is too much."""
    used = files.groupBy("project").agg(F.count(F.lit(1)).alias("files"), F.sum("length").cast("long").alias("bytes"))
    return used.withColumn("over", (F.col("files") > max_files) | (F.col("bytes") > max_total_bytes))


def _listed(spark: SparkSession, root: str, projects: bool, ignore: Sequence[str], include_tests: bool, max_file_bytes: int, max_files: int, max_total_bytes: int) -> DataFrame:
    """What source_tree gives, for stores that only Spark's readers can open: all is listed, then joined with the rules. Names
    that start with an underscore stay unseen."""
    files = listing(spark, root, projects)
    rules = ignore_rules(spark, root, projects).groupBy("project").agg(F.collect_list(F.struct("folder", "text")).alias("rules"))

    own = files.filter(~F.concat(F.lit("/"), "path").rlike(r"/\.[^/]+/") & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED_DIRS))))
    built = built_dirs(own)
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    pruned = own.select("project", "path", F.explode(ancestors).alias("dir")).join(built, ["project", "dir"], "left_semi").select("project", "path").distinct()
    own = own.join(pruned, ["project", "path"], "left_anti").withColumn("language", language(F.col("path"))).filter("language IS NOT NULL")
    if not include_tests:
        own = own.filter(~F.col("path").rlike(TEST_FILE))
    extra = list(ignore)

    @F.pandas_udf("boolean")
    def left_out(path: pd.Series, rules: pd.Series) -> pd.Series:
        return pd.Series([ignored(p, [(r["folder"], r["text"]) for r in rs] if rs is not None else [], extra) for p, rs in zip(path, rules)], dtype=bool)

    own = own.join(rules, "project", "left").filter(~left_out("path", "rules")).drop("rules")
    over = budget_use(own.filter(~too_large(F.col("length"), max_file_bytes)), max_files, max_total_bytes).filter("over").first()
    if over:
        raise BudgetExceeded(f"project {over.project} has {over.files} files of {over.bytes} bytes; the budget is {max_files} files, {max_total_bytes} bytes")

    globs = "{" + ",".join([*(f"*.{e}" for e in LANGUAGES), "*.yml", "*.yaml", "*.prisma"]) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs).load(root).filter(F.col("length") <= max_file_bytes)
    return own.join(raw.select(F.col("path").alias("url"), "content"), "url", "left").select("project", "path", "length", "content", "language")


def index_files(
    spark: SparkSession, root: str, projects: bool = False, ignore: Sequence[str] = (), include_tests: bool = False,
    max_file_bytes: int = MAX_FILE_BYTES, max_files: int = MAX_FILES, max_total_bytes: int = MAX_TOTAL_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(files, unresolved) of the projects under root.

    files: project, path, content, bytes, hash, language, ordinal (by path); unresolved: project, reason, message, file
    for files too large or not text. More than max_files files or max_total_bytes bytes of a project is an error."""
    if min(max_file_bytes, max_files, max_total_bytes) <= 0:
        raise ValueError("budgets must be positive")
    if tree.readable(root):
        found = tree.source_tree(spark, root, projects, ignore, include_tests, max_file_bytes, max_total_bytes)
        read = stored(found.withColumn("language", language(F.col("path"))), "sources")
    else:
        read = _listed(spark, root, projects, ignore, include_tests, max_file_bytes, max_files, max_total_bytes)
    large, small = read.filter(too_large(F.col("length"), max_file_bytes)), read.filter(~too_large(F.col("length"), max_file_bytes))
    over = budget_use(small, max_files, max_total_bytes).filter("over").first()
    if over:
        raise BudgetExceeded(f"project {over.project} has {over.files} files of {over.bytes} bytes; the budget is {max_files} files, {max_total_bytes} bytes")
    read = small.withColumn("text", decoded(F.col("content")))
    ordinal = F.row_number().over(Window.partitionBy("project").orderBy(in_locale("path"), "path"))
    kept = read.filter("text IS NOT NULL").select("project", "path", F.col("text").alias("content"), F.col("length").alias("bytes"), content_hash(F.col("text")).alias("hash"), "language", ordinal.alias("ordinal"))
    skipped = lambda df, why: df.select("project", F.lit("source-skipped").alias("reason"), F.lit(why).alias("message"), F.col("path").alias("file"))
    return kept, skipped(large, f"larger than {max_file_bytes} bytes").unionByName(skipped(read.filter("text IS NULL"), "not text"))


def with_extra(files: DataFrame, extra: DataFrame, max_files: int = MAX_FILES, max_total_bytes: int = MAX_TOTAL_BYTES) -> DataFrame:
    """Files and those of an extra root whose paths aren't there yet; the budgets hold for both together."""
    out = files.unionByName(extra.join(files.select("project", "path"), ["project", "path"], "left_anti"))
    over = budget_use(out.withColumnRenamed("bytes", "length"), max_files, max_total_bytes).filter("over").first()
    if over:
        raise BudgetExceeded(f"project {over.project} has {over.files} files of {over.bytes} bytes with its extra roots; the budget is {max_files} files, {max_total_bytes} bytes")
    return out


def index_with_roots(spark: SparkSession, root: str, extra_roots: Sequence[str] = (), **options) -> tuple[DataFrame, DataFrame]:
    """index_files of root and of folders inside it that its rules leave out, paths below root; what root has wins."""
    files, unresolved = index_files(spark, root, **options)
    project = F.lit(root.rstrip("/").rsplit("/", 1)[-1])
    for extra in extra_roots:
        inside = posixpath.normpath(extra)
        if inside in ("", ".", "..") or inside.startswith(("../", "/")):
            raise ValueError(f"an extra root must be a folder inside the project: {extra}")
        more, remarks = index_files(spark, f"{root.rstrip('/')}/{inside}", **options)
        files = with_extra(files, more.withColumn("path", F.concat(F.lit(inside + "/"), "path")).withColumn("project", project))
        unresolved = unresolved.unionByName(remarks.withColumn("file", F.concat(F.lit(inside + "/"), "file")).withColumn("project", project))
    return files, unresolved
