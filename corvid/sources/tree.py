"""Source trees as a Spark data source: executors walk folders, and what a rule leaves out is never opened.

A partition is a folder with the ignore rules that hold in it. The driver opens a few folders at the top, until there are enough
partitions; below, each task lists folder by folder, decides about subfolders by their name, by what lies beside and inside them
and by the rules so far, and reads the files that stay. Spark's own file readers skip names that start with an underscore
(`__init__.py` among them) and list everything before anything can be left out.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvid.session import ship
from corvid.sources import rules

SCHEMA = "project string, path string, length long, content binary"
#: Partitions that the driver makes at least, if there are so many folders; rows and bytes of a batch.
PARTS, ROWS, BYTES = 32, 256, 8 << 20


@dataclass(frozen=True)
class Folder(InputPartition):
    """A folder of a project (path below the project) and the ignore files above it. Not deep: only its own files."""

    project: str
    top: str
    path: str = ""
    ignoring: tuple[tuple[str, str], ...] = ()
    deep: bool = True


@dataclass
class Walker:
    """Walks folders of a file system. `listed` is told of each folder that is opened."""

    system: fs.FileSystem
    ignore: Sequence[str] = ()
    include_tests: bool = False
    ignore_files: Sequence[str] = rules.IGNORE_FILES
    listed: Callable[[str], None] = field(default=lambda path: None)

    def entries(self, folder: str) -> dict[str, fs.FileInfo]:
        self.listed(folder)
        return {x.base_name: x for x in self.system.get_file_info(fs.FileSelector(folder, recursive=False))}

    def text(self, path: str) -> str:
        with self.system.open_input_stream(path) as f:
            return f.read().decode("utf-8", "replace")

    def opened(self, at: Folder) -> tuple[list[tuple[str, fs.FileInfo]], list[Folder]]:
        """(files that stay, as paths below the project; folders to go on with) of one folder."""
        here = posixpath.join(at.top, at.path) if at.path else at.top
        held = self.entries(here)
        below = lambda name: f"{at.path}/{name}" if at.path else name
        own = [(at.path, self.text(held[n].path)) for n in self.ignore_files if n in held and held[n].is_file]
        ignoring = (*at.ignoring, *own)
        files, folders = [], []
        for name, info in sorted(held.items()):
            path = below(name)
            if info.type == fs.FileType.Directory:
                if self._left_out(path, name, info, set(held), ignoring):
                    continue
                folders.append(Folder(at.project, at.top, path, ignoring))
            elif rules.language_of(path) and (self.include_tests or not re.search(rules.TEST_FILE, path)) and not rules.ignored(path, ignoring, self.ignore):
                files.append((path, info))
        return files, folders

    def _left_out(self, path: str, name: str, info: fs.FileInfo, beside: set[str], ignoring: Sequence[tuple[str, str]]) -> bool:
        if name.startswith(".") or name in rules.IGNORED_DIRS or isinstance(self.system, fs.LocalFileSystem) and os.path.islink(info.path):
            return True
        # a folder is closed by rules if anything in it would be and no rule takes anything back
        if rules.ignored(f"{path}/\1", ignoring, self.ignore) and not any(line.startswith("!") for _, text in ignoring for line in text.splitlines()):
            return True
        built = rules.built(name, beside, None)
        return rules.built(name, beside, set(self.entries(info.path))) if built is None else built

    def files(self, at: Folder) -> Iterator[tuple[str, fs.FileInfo]]:
        """All files that stay under a folder, one folder open at a time."""
        pending = [at]
        while pending:
            found, folders = self.opened(pending.pop())
            yield from found
            if at.deep:
                pending += reversed(folders)


def _opened_fs(root: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(root) if re.match(r"[a-z][a-z0-9+.-]*:", root) else (fs.LocalFileSystem(), os.path.abspath(root))
    return system, path.rstrip("/")


def readable(root: str) -> bool:
    """Whether there is a file system for root here; Spark may know others."""
    try:
        system, path = _opened_fs(root)
        return system.get_file_info(path).type == fs.FileType.Directory
    except (OSError, ValueError, NotImplementedError, pa.ArrowInvalid):
        return False


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def _walker(self) -> tuple[Walker, str]:
        system, top = _opened_fs(self.options["path"])
        return Walker(system, json.loads(self.options.get("ignore", "[]")), self.options.get("tests") == "true"), top

    def partitions(self) -> Sequence[InputPartition]:
        walker, top = self._walker()
        if self.options.get("projects") == "true":
            line = [Folder(x.base_name, x.path) for x in walker.entries(top).values() if x.type == fs.FileType.Directory and not x.base_name.startswith(".")]
        else:
            line = [Folder(top.rsplit("/", 1)[-1], top)]
        line.sort(key=lambda f: f.project)
        done: list[Folder] = []
        while line and len(line) + len(done) < PARTS:
            at = line.pop(0)
            done.append(Folder(at.project, at.top, at.path, at.ignoring, deep=False))
            line += walker.opened(at)[1]
        return [*done, *line]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        walker, _ = self._walker()
        most, budget = int(self.options["max_file_bytes"]), int(self.options["max_total_bytes"])
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["project", "path", "length", "content"])

        for path, info in walker.files(partition):
            content = None
            if info.size <= most and budget >= 0:  # beyond the budget the scan ends with an error, so nothing more is read
                with walker.system.open_input_stream(info.path) as f:
                    content = f.read()
                budget -= info.size
                held += info.size
            rows.append((partition.project, path, info.size, content))
            if len(rows) >= ROWS or held >= BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class SourceTree(DataSource):
    """Format "source_tree": project, path, length and content (null where the file or the budget is too large)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def source_tree(spark: SparkSession, root: str, projects: bool = False, ignore: Sequence[str] = (), include_tests: bool = False, max_file_bytes: int = 2 << 20, max_total_bytes: int = 64 << 20) -> DataFrame:
    """The sources under root, or, with `projects`, those of each of its folders."""
    ship(spark)
    spark.dataSource.register(SourceTree)
    options = {"projects": str(projects).lower(), "ignore": json.dumps(list(ignore)), "tests": str(include_tests).lower(), "max_file_bytes": str(max_file_bytes), "max_total_bytes": str(max_total_bytes)}
    return spark.read.format("source_tree").options(**options).load(root)
