"""Which folders and files of a project are its own sources: names, marks of build output, ignore files."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

#: Directories that never hold a project's own sources.
IGNORED_DIRS = (
    "node_modules", ".git", ".next", ".nuxt", "coverage", ".turbo", ".cache", "vendor", "__pycache__", ".venv",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".eggs", "site-packages", "egg-info", ".gradle",
)
#: Which files beside or inside mark a directory of that name as build output.
BESIDE_TARGET = ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")
INSIDE_TARGET = ("classes", "test-classes", "maven-status", "generated-sources", "generated-test-sources")
BESIDE_DIST = ("package.json", "pyproject.toml", "setup.py", "pom.xml", "build.gradle")
INSIDE_DIST = ("assets", "static", "lib", "bdist.linux-x86_64")
PROJECT_FILE, COMPILED, BUNDLED = r"\.(csproj|sln|fsproj|vbproj)$", r"(?i)\.(dll|exe|pdb|cache)$", r"(?i)\.(map|whl|tar\.gz|egg)$"
#: Languages by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript",
    "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "go": "go", "java": "java", "cs": "csharp", "rs": "rust", "php": "php",
}
CONFIG_FILE, PRISMA_FILE = r"(?:^|/)config/.*\.ya?ml$", r"(?:^|/)(?:schema|(?:src/)?prisma/[^/]+)\.prisma$"
#: Fixed value: paths of tests, fixtures and examples.
TEST_FILE = (
    r"(?i)(?:\.test|\.spec|\.stories)\.[a-z]+$|_test\.go$|(?:^|[/\\])test_[^/\\]+\.py$|Test\.java$|Tests\.cs$|Test\.php$"
    r"|(?:^|[/\\])(?:tests?|__tests__|scripts?|fixtures?|e2e)[/\\]|^examples?[/\\]"
)
#: Fixed value: the name of ignore files (a caller may name more).
IGNORE_FILES = (".gitignore",)


def language_of(path: str) -> str | None:
    """The language of a file by its path, as `language` has it for columns."""
    if re.search(CONFIG_FILE, path):
        return "yaml"
    if re.search(PRISMA_FILE, path):
        return "prisma"
    ext = re.search(r"\.([A-Za-z]+)$", path)
    return LANGUAGES.get(ext[1].lower()) if ext else None


def built(name: str, beside: set[str], inside: set[str] | None) -> bool | None:
    """Whether a folder of that name is build output or a virtual environment, by what lies beside and inside it; without
    `inside`, None where that has to be known."""
    some = lambda pattern, names: any(re.search(pattern, n) for n in names)
    held = inside or set()
    if name == "target":
        verdict = bool(beside & set(BESIDE_TARGET)) or bool(held & set(INSIDE_TARGET))
    elif name in ("bin", "obj"):
        verdict = some(PROJECT_FILE, beside) or bool(held & {"Debug", "Release"}) or some(COMPILED, held)
    elif name in ("env", "venv"):
        verdict = bool(held & {"pyvenv.cfg", "activate"}) or {"bin", "lib"} <= held
    elif name in ("dist", "build", "out"):
        if not beside & set(BESIDE_DIST):
            return False
        verdict = bool(held & set(INSIDE_DIST)) or some(BUNDLED, held)
    else:
        return False
    return None if inside is None and not verdict else verdict


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (regular expression of paths below the file's folder, whether it takes back)."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    only_dir, line = line.endswith("/"), line.rstrip("/")
    anchored = "/" in line
    out = []
    for part in line.lstrip("/").split("/"):
        if part == "**":
            out.append(".*")
        else:
            out.append(re.sub(r"\(\?s:(.*)\)\\[zZ]", r"\1", fnmatch.translate(part)).replace(".*", "[^/]*"))
    body = "/".join(out).replace(".*/", "(?:.*/)?")
    return ("" if anchored else "(?:.*/)?") + body + ("/.*" if only_dir else "(?:/.*)?"), negated


def ignored(path: str, rules: Sequence[tuple[str, str]], extra: Sequence[str] = ()) -> bool:
    """Whether ignore files (folder, text) leave a path out: the last rule that matches decides, deeper folders after
    outer ones; the caller's own patterns are final."""
    verdict = False
    for folder, text in sorted(rules, key=lambda r: (r[0].count("/") + bool(r[0]), r[0])):
        if folder and not path.startswith(folder + "/"):
            continue
        below = path[len(folder) + 1 :] if folder else path
        for rule in filter(None, map(ignore_pattern, text.splitlines())):
            if re.fullmatch(rule[0], below):
                verdict = not rule[1]
    return verdict or any(re.fullmatch(r[0], path) for r in map(ignore_pattern, extra) if r and not r[1])
