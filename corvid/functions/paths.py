"""Route path dialects and names derived from paths, as Column functions (no Python on the executors but for one dialect)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The placeholder syntax of each dialect as (Java pattern, replacement), applied in order.
DIALECTS: dict[str, tuple[tuple[str, str], ...]] = {
    "express": ((r":([A-Za-z0-9_]+)\([^)]*\)", "{$1}"), (r":([A-Za-z0-9_]+)\?", "{$1}"), (r":([A-Za-z0-9_]+)", "{$1}"), (r"\*([A-Za-z0-9_]+)", "{$1}"), (r"\*", "{wildcard}")),
    "hono": ((r":([A-Za-z0-9_]+)", "{$1}"), (r"\*\s*([A-Za-z0-9_]+)", "{$1}"), (r"\*\s*", "{wildcard}")),
    "fastapi": ((r"\{([^{}:]+):[^{}]+\}", "{$1}"),),
    "flask": ((r"<(?:[A-Za-z]+:)?([A-Za-z_][A-Za-z0-9_]*)>", "{$1}"),),
    "django": ((r"\(\?P<([^>]+)>[^)]*\)", "{$1}"), (r"<(?:[A-Za-z]+:)?([A-Za-z_][A-Za-z0-9_]*)>", "{$1}"), (r"\^", ""), (r"\$$", ""), (r"/\?", "/"), (r"\?", "")),
    "gin": ((r":([A-Za-z0-9_]+)", "{$1}"), (r"\*([A-Za-z0-9_]+)", "{$1}")),
    "echo": ((r":([A-Za-z0-9_]+)", "{$1}"), (r"\*[A-Za-z0-9_]*", "{wildcard}")),
    "chi": ((r"\{([^}:]+):[^}]*\}", "{$1}"),),
    "nethttp": ((r"^\s*[!#$%&'*+.^_`|~0-9A-Za-z-]+\s+(?=\S)", ""), (r"\{([A-Za-z0-9_]+)\.\.\.\}", "{$1}")),
    "axum": ((r":([A-Za-z0-9_]+)", "{$1}"), (r"\*([A-Za-z0-9_]+)", "{$1}")),
    "actix": ((r"\{\s*([^{}:]*?)\s*(?::[^{}]*)?\}\*?", "{$1}"),),
    "rocket": ((r"<([A-Za-z_][A-Za-z0-9_]*)(?::[^>]+)?>", "{$1}"),),
    "laravel": ((r"\{([^}?]+)\?\}", "{$1}"), (r"/+$", "")),
    "symfony": ((r"\{([^{}:?]+)[^}]*\}", "{$1}"),),
    "aspnet": ((r"\{\*{0,}([A-Za-z0-9_]+)(?::[^}?]+)?\??\}", "{$1}"),),
    "nextjs": ((r"/\([^)/]*\)(?=/|$)", ""), (r"\[\[\.\.\.([^\]/]+)\]\]", "{$1}"), (r"\[\.\.\.([^\]/]+)\]", "{$1}"), (r"\[([^\]/]+)\]", "{$1}")),
}
#: Dialects that share another's rules.
DIALECTS |= {"koa": DIALECTS["hono"], "elysia": DIALECTS["hono"], "fiber": DIALECTS["echo"], "gorillamux": DIALECTS["chi"]}
#: Dialects whose paths get a leading slash, and "/" where nothing is left.
ROOTED = {"axum", "laravel"}


def template_path(raw: Column, dialect: str) -> Column:
    """A route path in a framework's own syntax as a path template with {name} placeholders (null stays null)."""
    if dialect == "slim":
        return _slim(raw)
    out = F.trim(raw) if dialect in ROOTED or dialect == "aspnet" else raw
    if dialect in ROOTED:
        out = F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))
    for pattern, replacement in DIALECTS[dialect]:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(out == "", "/").otherwise(out) if dialect in ROOTED else out


#: A route's syntax in parts: an escaped character, an opening or closing brace, or a run of anything else.
_PARTS = re.compile(r"\\.|[{}]|[^\\{}]+|\\$", re.S)


def balanced_template(raw: str | None) -> str | None:
    """The placeholders of a path whose constraints may hold nested braces, without the constraints.

    The path's parts go to the topmost of a stack of open placeholders; closing the outermost keeps its name. Placeholders
    that are never closed stay as they were written."""
    if raw is None:
        return None
    open_parts: list[list[str]] = [[]]
    for part in _PARTS.findall(raw if raw.startswith("/") else "/" + raw):
        if part == "{":
            open_parts.append([])
        elif part == "}" and len(open_parts) > 1:
            inner = "".join(open_parts.pop())
            name = re.split(":", inner, maxsplit=1)[0] if len(open_parts) == 1 else inner
            open_parts[-1].append("{" + name + "}")
        else:
            open_parts[-1].append(part)
    return "{".join("".join(x) for x in open_parts)


def _slim(raw: Column) -> Column:
    @F.pandas_udf("string")
    def convert(paths: pd.Series) -> pd.Series:
        return paths.map(balanced_template)

    return convert(raw)


def parameters(template: Column) -> Column:
    """Names in braces, in order."""
    return F.regexp_extract_all(template, F.lit(r"\{([^}]+)\}"), 1)


def join_stripped(*parts: Column) -> Column:
    """Parts without slashes at their ends, joined by one, after a leading slash; null and empty parts don't count."""
    cleaned = F.filter(F.array(*(F.regexp_replace(F.coalesce(p, F.lit("")), r"^/+|/+$", "") for p in parts)), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(cleaned, "/"))


def join_trailing(*parts: Column) -> Column:
    """Like join_stripped, with a trailing slash."""
    joined = join_stripped(*parts)
    return F.when(joined == "/", joined).otherwise(F.concat(joined, F.lit("/")))


def join_prefix(prefix: Column, path: Column) -> Column:
    """A group's prefix and a route's path, where "/" is the prefix itself."""
    head, tail = F.regexp_replace(prefix, "/$", ""), F.regexp_replace(F.coalesce(path, F.lit("")), "^/", "")
    return F.when(tail == "", F.when(head == "", "/").otherwise(head)).otherwise(F.concat(head, F.lit("/"), tail))


def join_collapsed(base: Column, sub: Column) -> Column:
    """Both parts as they are, with runs of slashes made one."""
    joined = F.regexp_replace(F.concat(base, sub), "/+", "/")
    return F.when(joined == "", "/").otherwise(joined)


def _upper_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1))


def operation_id(method: Column, path: Column) -> Column:
    """The method and the camel-cased segments of a path: get, /items/{item-id} -> getItemsItemId."""
    segments = F.filter(F.split(F.regexp_replace(path, r"[{}]", ""), "/"), lambda s: s != "")

    def camel(s):
        pieces = F.transform(F.split(s, "[^A-Za-z0-9]+"), _upper_first)
        # a run of other characters at the end has no letter to join to: its last character stays
        return F.concat(F.array_join(pieces, ""), F.right(F.regexp_extract(s, r"[^A-Za-z0-9]+$", 0), F.lit(1)))

    return F.concat(F.lower(method), F.array_join(F.transform(segments, camel), ""))


def dashed_operation_id(method: Column, path: Column) -> Column:
    """The variant that splits at slashes and dashes only."""
    parts = F.filter(F.split(F.regexp_replace(path, r"[{}]", ""), r"[/\-]"), lambda s: s != "")
    return F.concat(F.lower(method), F.array_join(F.transform(parts, _upper_first), ""))


def tag(path: Column, file: Column) -> Column:
    """The first segment of a path if it is no placeholder, else the file's stem (index: default)."""
    first = F.get(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(0))
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce(file, F.lit("default")), "/"), -1), r"\.[jt]sx?$", "")
    return F.when(first.isNotNull() & ~first.startswith("{"), first).when(stem == "index", "default").otherwise(stem)


#: Endings of a plural as (pattern, replacement); the first that a word has applies.
SINGULAR = (("ies$", "y"), ("ses$", "s"), ("s$", ""))


def singular_word(word: str) -> str:
    """A resource's name for one of it: categories -> category, statuses -> status, users -> user."""
    return next((re.sub(p, r, word) for p, r in SINGULAR if re.search(p, word)), word)


def singular(word: Column) -> Column:
    """singular_word as a Column."""
    out = word
    for pattern, replacement in reversed(SINGULAR):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, replacement)).otherwise(out)
    return out


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"[\s\-]+", "_"))


#: What a FastAPI path converter says of its parameter.
CONVERTERS = {"int": ("integer", None), "float": ("number", None), "path": ("string", None), "str": ("string", None), "uuid": ("string", "uuid")}


def converter_types(raw: Column) -> Column:
    """The parameters of a FastAPI path in order, as (name, type, format); without a known converter the type is null."""
    names = F.regexp_extract_all(raw, F.lit(r"\{([^{}:]+)(?::([^{}]+))?\}"), F.lit(1))
    kinds = F.regexp_extract_all(raw, F.lit(r"\{([^{}:]+)(?::([^{}]+))?\}"), F.lit(2))
    known = lambda at: F.create_map(*(F.lit(x) for k, v in CONVERTERS.items() if v[at] for x in (k, v[at])))
    one = lambda z: F.struct(z["name"].alias("name"), F.try_element_at(known(0), z["kind"]).alias("type"), F.try_element_at(known(1), z["kind"]).alias("format"))
    return F.transform(F.arrays_zip(names.alias("name"), kinds.alias("kind")), one)


def autoload_segment(segment: Column) -> Column:
    """A folder's name as a path segment: __id or _id is a parameter."""
    return F.when(segment.contains("__"), F.replace(segment, F.lit("__"), F.lit(":"))).when(segment.startswith("_"), F.concat(F.lit(":"), F.substring(segment, 2, 2**31 - 1))).otherwise(segment)


def next_path(file: Column) -> Column:
    """A page or route file's place as a path template."""
    app = F.regexp_replace(F.regexp_replace(file, r"(^|/)app/", "/"), r"/route\.(ts|tsx|js|jsx|mjs|cjs)$", "")
    pages = F.regexp_replace(F.regexp_replace(F.regexp_replace(file, r"(^|/)pages/", "/"), r"\.(ts|tsx|js|jsx|cjs)$", ""), r"/index$", "")
    return join_stripped(template_path(F.concat(F.lit("/"), F.when(file.rlike(r"(^|/)app/"), app).otherwise(pages)), "nextjs"))


def pointer_unescaped(name: Column) -> Column:
    """A JSON pointer's token as it was before escaping."""
    return F.replace(F.replace(name, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def component_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")
