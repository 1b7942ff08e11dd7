"""PHP (laravel, symfony, slim), C# (aspnet, fastendpoints), Rust (axum, actix, rocket) and Django REST framework:
route evidence from declarations, parameters from templates; bodies and responses where a declaration shows them."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Mapping

from corvid.functions.paths import singular_word
from corvid.packs import Found
from corvid.packs.pyfacts import bases, constant, dotted, find_class, parse
from corvid.packs.routes import VERBS, best, candidate, firsts, joined, names_in, parameter, response
from corvid.packs.scanner import calls, closing, line_at, object_schema, split_top, status, string, template, without_comments
from corvid.packs.types import Php, Rust
from corvid.packs.validators import fluent_validation


def _route(verb: str, full: str, file: str, text: str, at: int, **more) -> dict:
    route = candidate(verb, full, file, line_at(text, at), **more)
    route["parameters"] = [parameter(n, "path", {"type": "string"}, True) for n in names_in(full)]
    return route


def _open(route: dict) -> dict:
    if not route["responses"]:
        route["gaps"].append("response-unknown")
    return route


def _texts(files: Mapping[str, str], suffix: str, hashes: bool = False) -> dict[str, str]:
    return {p: without_comments(t, hashes) for p, t in files.items() if p.endswith(suffix)}


# --- PHP -------------------------------------------------------------------------------------------------------------

#: The actions of a resource as (verbs, suffix).
RESOURCE = {
    "index": (("get",), ""), "create": (("get",), "/create"), "store": (("post",), ""), "show": (("get",), "/{x}"), "edit": (("get",), "/{x}/edit"),
    "update": (("put", "patch"), "/{x}"), "destroy": (("delete",), "/{x}"),
}


def _nested(segments: str) -> tuple[str, str]:
    """A resource's collection path and the name of its own binding: photos.comments -> photos/{photo}/comments, comment."""
    parts = [p for p in segments.strip("/").split(".") if p]
    names = [singular_word(p.split("/")[-1].replace("-", "_")) for p in parts]
    return "/".join(x for p, n in zip(parts, names) for x in (p, f"{{{n}}}"))[: -len(names[-1]) - 3] if parts else "", names[-1] if names else "resource"


def _php_rules(text: str) -> dict | None:
    """The schema of an array of validation rules ('field' => 'required|string|max:5')."""
    properties, required = {}, []
    for entry in split_top(text):
        m = re.match(r"['\"]([\w.*]+)['\"]\s*=>\s*(.+)$", entry, re.S)
        if not m:
            return None
        rules = (string(m[2]) or "").split("|") if string(m[2]) is not None else re.findall(r"['\"]([^'\"]+)['\"]", m[2])
        schema: dict = {}
        for rule in rules:
            name, _, argument = rule.partition(":")
            schema |= {"integer": {"type": "integer"}, "numeric": {"type": "number"}, "boolean": {"type": "boolean"}, "string": {"type": "string"}, "array": {"type": "array", "items": {}}, "email": {"type": "string", "format": "email"}, "url": {"type": "string", "format": "uri"}, "uuid": {"type": "string", "format": "uuid"}, "date": {"type": "string", "format": "date"}, "file": {"type": "string", "format": "binary"}, "image": {"type": "string", "format": "binary"}}.get(name, {})
            number = schema.get("type") in ("integer", "number")
            if name in ("min", "max") and argument.isdigit():
                schema[("minimum" if name == "min" else "maximum") if number else ("minLength" if name == "min" else "maxLength")] = int(argument)
            elif name == "in":
                schema["enum"] = argument.split(",")
            elif name == "required" and "." not in m[1]:
                required.append(m[1])
            elif name == "nullable" and isinstance(schema.get("type"), str):
                schema["type"] = [schema["type"], "null"]
        properties[m[1]] = schema or {"type": "string"}
    return {"type": "object", "properties": properties, **({"required": required} if required else {})}


def laravel(files: Mapping[str, str]) -> Found:
    found, texts = Found(), _texts(files, ".php", True)
    methods = {(c[1], m[1]): t[m.start() : closing(t, t.find("{", m.end()))] for t in texts.values() for c in re.finditer(r"\bclass\s+(\w+)[^{]*\{", t) for m in re.finditer(r"function\s+(\w+)\s*\(", t[c.end() : closing(t, c.end() - 1)]) for t in [t[c.end() :]]}
    requests = {c[1]: m for t in texts.values() for c in re.finditer(r"\bclass\s+(\w+)\s+extends\s+FormRequest[^{]*\{", t) if (m := re.search(r"function\s+rules\s*\(.*?return\s*\[(.*?)\]\s*;", t[c.end() :], re.S))}

    def described(route: dict, controller: str, action: str) -> dict:
        code = methods.get((controller, action))
        if code is None:
            return _open(route)
        rules = next((requests[n][1] for n in re.findall(r"\b([A-Z]\w*Request)\s+\$", code) if n in requests), None)
        inline = re.search(r"validate\(\s*\[(.*?)\]\s*\)", code, re.S)
        schema = _php_rules(rules or (inline[1] if inline else "")) if rules or inline else None
        if schema and route["method"] in ("get", "head"):
            route["parameters"] += [parameter(n, "query", s, n in schema.get("required", ())) for n, s in schema["properties"].items()]
        elif schema:
            media = "multipart/form-data" if any(s.get("format") == "binary" for s in schema["properties"].values()) else "application/json"
            route["request_body"] = {"required": True, "content": [{"media_type": media, "schema": schema}]}
        for m in re.finditer(r"response\(\)->(json|noContent)\(", code):
            args = split_top(code[m.end() : closing(code, m.end() - 1)])
            route["responses"].append(response((status(args[1]) if len(args) > 1 else None) or (204 if m[1] == "noContent" else 200), None if m[1] == "noContent" else {}))
        return _open(route)

    def walk(path: str, text: str, start: int, end: int, prefix: str) -> Iterator[dict]:
        skip = start
        for m in re.finditer(r"Route::", text[start:end]):
            at = start + m.start()
            if at < skip:
                continue
            own, name_at, parts = prefix, at + 7, []
            while c := re.compile(r"(\w+)\s*\(").match(text, name_at):
                close = closing(text, c.end() - 1)
                parts.append((c[1], split_top(text[c.end() : close]), c.end() - 1, close))
                follow = re.compile(r"\s*->\s*").match(text, close + 1)
                if not follow:
                    break
                name_at = follow.end()
            controller = ""
            for name, args, opened, close in parts:
                if name == "prefix" and args and string(args[0]) is not None:
                    own = joined(own, string(args[0]))
                elif name == "controller" and args:
                    controller = args[0].partition("::")[0].rpartition("\\")[2]
                elif name == "group":
                    if args and args[0].startswith("[") and (g := re.search(r"['\"]prefix['\"]\s*=>\s*['\"]([^'\"]+)", args[0])):
                        own = joined(own, g[1])
                    yield from walk(path, text, opened + 1, close, own)
                    skip = close
                elif name in (*VERBS, "any", "match") and args:
                    verbs = VERBS if name == "any" else [v.lower() for v in re.findall(r"['\"](\w+)['\"]", args[0])] if name == "match" else (name,)
                    args = args[1:] if name == "match" else args
                    raw = string(args[0])
                    if raw is None:
                        found.remark("dynamic-path", "a route's path isn't constant", path, line_at(text, at))
                        continue
                    target = re.search(r"\[\s*\\?([\w\\]+)::class\s*,\s*['\"](\w+)['\"]|['\"]([\w\\]+)@(\w+)['\"]", args[1]) if len(args) > 1 else None
                    owner, action = ((target[1] or target[3]).rpartition("\\")[2], target[2] or target[4]) if target else (controller, string(args[1]) if len(args) > 1 else "")
                    for verb in verbs:
                        yield described(_route(verb, template(joined(own, raw), "laravel"), path, text, at), owner, action or "")
                elif name in ("resource", "apiResource") and args and string(args[0]) is not None:
                    segment = string(args[0])
                    owner = args[1].partition("::")[0].rpartition("\\")[2] if len(args) > 1 else ""
                    named = {n: a for n, a, _, _ in parts}
                    only = re.findall(r"['\"](\w+)['\"]", " ".join(named.get("only", [])))
                    without = re.findall(r"['\"](\w+)['\"]", " ".join(named.get("except", []))) + (["create", "edit"] if name == "apiResource" else [])
                    collection, binding = _nested(segment)
                    for action, (verbs, suffix) in RESOURCE.items():
                        if (not only or action in only) and action not in without:
                            for verb in verbs:
                                route = described(_route(verb, joined(own, collection) + suffix.replace("x", binding), path, text, at), owner, action)
                                if not route["responses"]:  # the action is there whether or not its method was found
                                    route["responses"].append(response(200, confidence="low"))
                                yield route

    def all_routes() -> Iterator[dict]:
        for path, text in texts.items():
            prefix = "/api" if path.endswith("routes/api.php") else ""
            yield from walk(path, text, 0, len(text), prefix)

    found.routes = best(all_routes())
    return found


def symfony(files: Mapping[str, str]) -> Found:
    """Attributes on controllers, and YAML route files."""
    found, texts = Found(), _texts(files, ".php")
    types = Php(texts, found.components)

    def attribute(text: str) -> tuple[str | None, list[str]]:
        args = split_top(text)
        path = next((string(re.sub(r"^path\s*:\s*", "", a)) for a in args if a.startswith(("'", '"', "path:"))), "")
        verbs = next((re.findall(r"['\"](\w+)['\"]", a) for a in args if a.startswith("methods")), [])
        return path, [v.lower() for v in verbs]

    def contract(text: str, opened: int, route: dict) -> dict:
        close = closing(text, opened)
        for p in split_top(text[opened + 1 : close]):
            m = re.match(r"((?:#\[[^\]]*\]\s*)*)([?\\\w|]+)\s+\$(\w+)\s*(=)?", p)
            if not m:
                continue
            own = next((x for x in route["parameters"] if (x["in"], x["name"]) == ("path", m[3])), None)
            if own:
                own["schema"] = types.schema(m[2]) or own["schema"]
            elif "MapRequestPayload" in m[1]:
                route["request_body"] = {"required": True, "content": [{"media_type": "application/json", "schema": types.schema(m[2])}]}
            elif "MapQueryParameter" in m[1]:
                route["parameters"].append(parameter(m[3], "query", types.schema(m[2]), not m[4] and not m[2].startswith("?")))
            elif "MapQueryString" in m[1]:
                whole = types.components.get(types.schema(m[2]).get("$ref", "").rpartition("/")[2], {})
                route["parameters"] += [parameter(n, "query", each, n in whole.get("required", ())) for n, each in whole.get("properties", {}).items()]
        brace = text.find("{", close)
        code = text[brace : closing(text, brace)] if brace >= 0 else ""
        for m in re.finditer(r"(?:\$this->json|new\s+JsonResponse)\(", code):
            args = split_top(code[m.end() : closing(code, m.end() - 1)])
            made = re.match(r"new\s+([\\\w]+)\(", args[0]) if args else None
            route["responses"].append(response((status(args[1]) if len(args) > 1 else None) or 200, types.schema(made[1]) if made else {}))
        said = re.match(r"\s*:\s*([?\\\w|]+)", text[close + 1 :])
        if said and not route["responses"] and (schema := types.schema(said[1])):
            route["responses"].append(response(200, schema))
        return route

    def candidates() -> Iterator[dict]:
        for path, text in texts.items():
            for c in re.finditer(r"((?:#\[[^\]]*\]\s*)*)(?:final\s+|abstract\s+)*class\s+(\w+)[^{]*\{", text):
                base = next((attribute(m[1])[0] or "" for m in re.finditer(r"#\[Route\((.*?)\)\]", c[1], re.S)), "")
                end = closing(text, c.end() - 1)
                for m in re.finditer(r"#\[Route\((.*?)\)\]\s*(?:#\[[^\]]*\]\s*)*(?:public\s+)?function\s+(\w+)\s*\(", text[c.end() : end], re.S):
                    raw, verbs = attribute(m[1])
                    if raw is None:
                        found.remark("dynamic-path", "a route's path isn't constant", path, line_at(text, c.end() + m.start()))
                        continue
                    opened = c.end() + m.end() - 1
                    for verb in verbs or ["get"]:
                        yield _open(contract(text, opened, _route(verb, template(joined(base, raw), "symfony"), path, text, c.end() + m.start())))
        import yaml

        for path, text in files.items():
            if not re.search(r"(?:^|/)config/.*\.ya?ml$", path):
                continue
            try:
                routes = yaml.safe_load(text)
            except yaml.YAMLError as error:
                found.remark("analysis-failed", str(error), path)
                continue
            for name, r in routes.items() if isinstance(routes, dict) else ():
                if isinstance(r, dict) and isinstance(r.get("path"), str) and "controller" in {*r, *(r.get("defaults") or {})} | {k.strip("_") for k in r.get("defaults") or {}}:
                    verbs = r.get("methods") or ["GET"]
                    for verb in re.findall(r"\w+", verbs) if isinstance(verbs, str) else verbs:
                        yield _open(_route(verb.lower(), template(joined(r["path"]), "symfony"), path, text, max(0, text.find(str(name)))))

    found.routes = best(candidates())
    return found


def slim(files: Mapping[str, str]) -> Found:
    found, texts = Found(), _texts(files, ".php", True)

    def walk(path: str, text: str, start: int, end: int, prefixes: dict[str, str]) -> Iterator[dict]:
        skip = start
        for m in re.finditer(r"\$(\w+)\s*->\s*(get|post|put|patch|delete|options|any|map|group)\s*\(", text[start:end]):
            at, opened = start + m.start(), start + m.end() - 1
            if at < skip or m[1] not in prefixes:
                continue
            close = closing(text, opened)
            args = split_top(text[opened + 1 : close])
            verbs: tuple | list = VERBS if m[2] == "any" else (m[2],)
            if m[2] == "map":
                verbs, args = [v.lower() for v in re.findall(r"['\"](\w+)['\"]", args[0])], args[1:]
            raw = string(args[0]) if args else None
            if raw is None:
                found.remark("dynamic-path", "a route's path isn't constant", path, line_at(text, at))
            elif m[2] == "group":
                name = re.search(r"function\s*\(\s*(?:[\w\\]+\s+)?\$(\w+)", text[opened:close])
                yield from walk(path, text, opened + 1, close, {**prefixes, (name[1] if name else m[1]): prefixes[m[1]] + raw})
                skip = close
            else:
                full = template(prefixes[m[1]] + raw, "slim")
                for verb in verbs:
                    if verb == "options" and re.search(r"\{routes[^}]*\}", full):
                        continue
                    yield _open(_route(verb, full, path, text, at))

    found.routes = best(r for p, t in texts.items() for r in walk(p, t, 0, len(t), {"app": ""}))
    return found


# --- C# --------------------------------------------------------------------------------------------------------------

_CS_SCALARS = {"string": {"type": "string"}, "int": {"type": "integer", "format": "int32"}, "long": {"type": "integer", "format": "int64"}, "bool": {"type": "boolean"}, "double": {"type": "number", "format": "double"}, "float": {"type": "number", "format": "float"}, "decimal": {"type": "number"}, "Guid": {"type": "string", "format": "uuid"}, "DateTime": {"type": "string", "format": "date-time"}, "DateOnly": {"type": "string", "format": "date"}, "IFormFile": {"type": "string", "format": "binary"}}


def _cs_schema(kind: str, texts: Mapping[str, str], components: dict, depth: int = 0) -> dict:
    kind = kind.strip()
    if depth > 6 or not kind:
        return {}
    if kind.endswith("?"):
        inner = _cs_schema(kind[:-1], texts, components, depth + 1)
        return {**inner, "type": [inner["type"], "null"]} if isinstance(inner.get("type"), str) else inner
    if kind in _CS_SCALARS:
        return dict(_CS_SCALARS[kind])
    if m := re.fullmatch(r"(?:Task|ValueTask|ActionResult|Results|Ok)<(.+)>", kind):
        return _cs_schema(m[1], texts, components, depth + 1)
    if m := re.fullmatch(r"(?:I?List|IEnumerable|ICollection|I?ReadOnlyList|IReadOnlyCollection|HashSet|IAsyncEnumerable)<(.+)>|(.+)\[\]", kind):
        return {"type": "array", "items": _cs_schema(m[1] or m[2], texts, components, depth + 1)}
    if m := re.fullmatch(r"I?Dictionary<[^,]+,(.+)>", kind):
        return {"type": "object", "additionalProperties": _cs_schema(m[1], texts, components, depth + 1)}
    name = kind.rpartition(".")[2]
    for text in texts.values():
        m = re.search(rf"\b(class|record|enum)\s+{re.escape(name)}\b\s*(\([^)]*\))?[^{{;]*([{{;])", text)
        if not m:
            continue
        if name not in components:
            components[name] = {}
            body = text[m.end() : closing(text, m.end() - 1)] if m[3] == "{" else ""
            if m[1] == "enum":
                components[name] = {"type": "string", "enum": re.findall(r"\b([A-Z]\w*)\b\s*(?:=[^,]*)?(?:,|$)", body.strip())}
            else:
                fields = re.findall(r"public\s+(required\s+)?(?:virtual\s+)?([\w<>\[\]?,. ]+?)\s+(\w+)\s*\{\s*get", body)
                fields += [("required", *p.strip().rsplit(" ", 1)) for p in split_top((m[2] or "")[1:-1]) if " " in p.strip()]
                camel = lambda n: n[:1].lower() + n[1:]
                properties = {camel(n): _cs_schema(k, texts, components, depth + 1) for _, k, n in fields}
                required = [camel(n) for r, k, n in fields if r or not (k.endswith("?") or k in _CS_SCALARS)]
                components[name] = {"type": "object", "properties": properties, **({"required": required} if required else {})}
        return {"$ref": f"#/components/schemas/{name}"}
    return {}


def aspnet(files: Mapping[str, str]) -> Found:
    """Controllers by attributes, and minimal APIs by Map calls."""
    found, texts = Found(), _texts(files, ".cs")

    def action(route: dict, parameters: str, returns: str) -> dict:
        for p in split_top(parameters):
            m = re.match(r"(?:\[From(Body|Query|Route|Header|Form|Services)[^\]]*\]\s*)?([\w<>\[\]?,.]+)\s+(\w+)\s*(=)?", p)
            if not m or m[1] == "Services":
                continue
            schema = _cs_schema(m[2], texts, found.components)
            own = next((x for x in route["parameters"] if x["name"].lower() == m[3].lower()), None)
            if own:
                own["schema"] = schema or own["schema"]
            elif m[1] == "Body" or (m[1] is None and schema.get("$ref")):
                route["request_body"] = {"required": True, "content": [{"media_type": "application/json", "schema": schema}]}
            elif m[1] == "Form":
                route["request_body"] = {"required": True, "content": [{"media_type": "multipart/form-data", "schema": schema}]}
            elif m[1] in ("Query", "Header") or schema.get("type"):
                route["parameters"].append(parameter(m[3], "header" if m[1] == "Header" else "query", schema or {"type": "string"}, not m[4] and not m[2].endswith("?")))
        schema = _cs_schema(returns, texts, found.components)
        if schema:
            route["responses"].append(response(200, schema))
        return route

    def candidates() -> Iterator[dict]:
        for path, text in texts.items():
            for c in re.finditer(r"((?:\[(?:[^\[\]]|\[[^\]]*\])*\]\s*)*)(?:public\s+|sealed\s+|abstract\s+|partial\s+)*class\s+(\w+)\s*(?:\([^)]*\))?\s*:[^{]*Controller[^{]*\{", text):
                base = next((m[1] for m in re.finditer(r'\[Route\(\s*"([^"]*)"', c[1])), "")
                token = re.sub(r"Controller$", "", c[2])
                end = closing(text, c.end() - 1)
                for m in re.finditer(r"((?:\[(?:[^\[\]]|\[[^\]]*\])*\]\s*)+)public\s+(?:async\s+|virtual\s+|override\s+)*([\w<>\[\]?,. ]+?)\s+(\w+)\s*\(", text[c.end() : end]):
                    at = c.end() + m.start()
                    opened = c.end() + m.end() - 1
                    for verb, raw in re.findall(r'\[?\bHttp(Get|Post|Put|Patch|Delete|Head|Options)\b(?:\(\s*"([^"]*)")?', m[1]):
                        raw = raw or next(iter(re.findall(r'\[Route\(\s*"([^"]*)"', m[1])), "")
                        full = raw if raw.startswith(("/", "~/")) else f"{base}/{raw}"
                        full = full.lstrip("~").replace("[controller]", token).replace("[action]", m[3])
                        route = _route(verb.lower(), joined(template(full, "aspnet")), path, text, at)
                        action(route, text[opened + 1 : closing(text, opened)], m[2])
                        for code, kind in re.findall(r"ProducesResponseType\((?:typeof\((?:[^()]+)\)\s*,\s*)?(?:StatusCodes\.Status)?(\d{3})(\w*)", m[1]):
                            if code not in {r["status_code"] for r in route["responses"]}:
                                route["responses"].append(response(code))
                        yield _open(route)
            groups: dict[str, str] = {}
            for m in re.finditer(r'(?:var\s+)?(\w+)\s*=\s*(\w+)\s*\.\s*MapGroup\(\s*"([^"]*)"', text):
                groups[m[1]] = joined(groups.get(m[2], ""), m[3])
            for m in re.finditer(r"(\w+)\s*(?:\.\s*MapGroup\(\s*\"([^\"]*)\"\s*\))?\s*\.\s*Map(Get|Post|Put|Patch|Delete)\s*\(", text):
                opened = m.end() - 1
                args = split_top(text[opened + 1 : closing(text, opened)])
                raw = string(args[0]) if args else None
                if raw is None:
                    found.remark("dynamic-path", "a route's path isn't constant", path, line_at(text, m.start()))
                    continue
                route = _route(m[3].lower(), joined(groups.get(m[1], ""), m[2], template(raw, "aspnet")), path, text, m.start())
                handler = re.match(r"(?:async\s*)?\(([^)]*)\)\s*=>", args[1]) if len(args) > 1 else None
                if handler:
                    action(route, handler[1], "")
                for r in re.finditer(r"(?:Typed)?Results\.(Ok|Created|NoContent|NotFound|BadRequest|Accepted|Unauthorized|Conflict)\(([^()]*)", args[1] if len(args) > 1 else ""):
                    route["responses"].append(response(status(r[1]) or 200, (object_schema(r[2]) or {}) if r[2].strip() and r[1] in ("Ok", "Created") else None))
                yield _open(route)

    found.routes = best(candidates())
    _validated(texts, found.components)
    return found


def _validated(texts: Mapping[str, str], components: dict) -> None:
    """Rules of AbstractValidator<Dto> and Validator<Dto> classes go into the components of their DTOs."""
    for text in texts.values():
        for m in re.finditer(r"class\s+\w+\s*(?:\([^)]*\))?\s*:\s*(?:Abstract)?Validator<\s*([\w.]+)\s*>[^{]*\{", text):
            name = m[1].rpartition(".")[2]
            if components.get(name):
                ruled = fluent_validation(text[m.end() : closing(text, m.end() - 1)], components[name])
                components[name] = {k: v for k, v in ruled.items() if k != "required" or v}


def fastendpoints(files: Mapping[str, str]) -> Found:
    found, texts = Found(), _texts(files, ".cs")

    def candidates() -> Iterator[dict]:
        for path, text in texts.items():
            for c in re.finditer(r"class\s+(\w+)\s*(?:\([^)]*\))?\s*:\s*(Endpoint\w*)\s*(?:<([^{]*?)>)?\s*\{", text):
                body = text[c.end() : closing(text, c.end() - 1)]
                conf = re.search(r"void\s+Configure\s*\(\s*\)\s*\{", body)
                if not conf:
                    continue
                code = body[conf.end() : closing(body, conf.end() - 1)]
                verbs, raws = [], []
                for call in calls(code):
                    if call.name in ("Get", "Post", "Put", "Patch", "Delete"):
                        verbs.append(call.name.lower())
                        raws += [r for r in map(string, call.args) if r is not None]
                    elif call.name == "Verbs":
                        verbs += [v.rpartition(".")[2].lower() for v in call.args]
                    elif call.name == "Routes":
                        raws += [r for r in map(string, call.args) if r is not None]
                kinds = split_top(c[3] or "")
                for raw in raws or ["/"]:
                    for verb in verbs or ["get"]:
                        route = _route(verb, joined(template(raw, "aspnet")), path, text, c.start())
                        request = _cs_schema(kinds[0], texts, found.components) if kinds and "WithoutRequest" not in c[2] else {}
                        if request and verb not in ("get", "head"):
                            route["request_body"] = {"required": True, "content": [{"media_type": "application/json", "schema": request}]}
                        answer = _cs_schema(kinds[-1], texts, found.components) if len(kinds) > 1 or (kinds and "WithoutRequest" in c[2]) else {}
                        if answer:
                            route["responses"].append(response(200, answer))
                        yield _open(route)

    found.routes = firsts(candidates())[0]
    _validated(texts, found.components)
    return found


# --- Rust ------------------------------------------------------------------------------------------------------------


def _rust_contract(text: str, name: str, types: Rust, route: dict) -> dict:
    """The route with what its handler's signature says (extractors and results) and the statuses that its body names."""
    m = re.search(rf"\bfn\s+{re.escape(name)}\s*(?:<[^>(]*>)?\s*\(", text)
    if not m:
        return route
    end = closing(text, m.end() - 1)
    opened = text.find("{", end)
    signature, code = text[m.end() : end], text[opened : closing(text, opened) + 1] if opened >= 0 else ""
    result = text[end + 1 : opened]
    if found := re.search(r"\b(?:\w+::)*(Json|Form)\s*<((?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*)>", signature):
        media = "application/json" if found[1] == "Json" else "application/x-www-form-urlencoded"
        route["request_body"] = {"required": True, "content": [{"media_type": media, "schema": types.schema(found[2])}]}
    if found := re.search(r"\bQuery\s*<((?:[^<>]|<[^<>]*>)*)>", signature):
        whole = types.schema(found[1])
        whole = types.components.get(whole.get("$ref", "").rpartition("/")[2], whole)
        route["parameters"] += [parameter(n, "query", each, n in whole.get("required", ())) for n, each in whole.get("properties", {}).items()]
    if found := re.search(r"\bPath\s*<((?:[^<>]|<[^<>]*>)*)>", signature):
        kinds = split_top(found[1].strip()[1:-1]) if found[1].strip().startswith("(") else [found[1]]
        own = [p for p in route["parameters"] if p["in"] == "path"]
        for p, kind in zip(own, kinds if len(kinds) == len(own) else ()):
            p["schema"] = types.schema(kind) or p["schema"]
    for p in route["parameters"]:  # an argument of the parameter's name, as rocket writes it
        if p["in"] in ("path", "query") and (own := re.search(rf"\b{re.escape(p['name'])}\s*:\s*([^,]+)", signature)):
            p["schema"] = types.schema(own[1]) or p["schema"]
    answer = re.search(r"\bJson\s*<((?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*)>", result)
    named = [x for x in map(status, re.findall(r"\bStatusCode::[A-Z_]+", code)) if x]
    built = [(status("HttpResponse." + x) or status(x), rest) for x, rest in re.findall(r"\bHttpResponse::(\w+)\(\)([^;,}]*)", code)]
    if answer:
        good = next((x for x in named if x < 300), 200)
        route["responses"].append(response(good, types.schema(answer[1])))
        named = [x for x in named if x != good]
    route["responses"] += [response(code_, {} if ".json(" in rest else None) for code_, rest in built if code_]
    route["responses"] += [response(x) for x in dict.fromkeys(named)]
    return route


def axum(files: Mapping[str, str]) -> Found:
    found, texts = Found(), _texts(files, ".rs")
    types = Rust(texts, found.components)
    bodies = {m[1]: (p, t, t.find("{", closing(t, m.end() - 1)), closing(t, t.find("{", closing(t, m.end() - 1)))) for p, t in texts.items() for m in re.finditer(r"\bfn\s+(\w+)\s*(?:<[^>]*>)?\s*\(", t)}
    nested = {n for t in texts.values() for n in re.findall(r"\.(?:nest|merge)\s*\((?:[^(),]*,)?\s*(?:\w+::)*(\w+)\s*\(", t)}

    def chain(name: str, prefix: str, way: tuple[str, ...]) -> Iterator[dict]:
        path, text, start, end = bodies[name]
        for c in calls(text, start, end):
            if c.name == "route" and len(c.args) == 2:
                raw = string(c.args[0])
                if raw is None:
                    found.remark("dynamic-path", "a route's path isn't constant", path, line_at(text, c.at))
                    continue
                for verb, handler in re.findall(r"\b(get|post|put|patch|delete|head|options|any)\s*\(\s*(?:\w+::)*(\w*)", c.args[1]):
                    owner = next((t for t in (text, *texts.values()) if re.search(rf"\bfn\s+{handler}\b", t)), text) if handler else text
                    for v in VERBS if verb == "any" else (verb,):
                        yield _open(_rust_contract(owner, handler, types, _route(v, re.sub("/+", "/", prefix + template(raw, "axum")).rstrip("/") or "/", path, text, c.at)))
            elif c.name in ("nest", "merge") and c.args:
                target = re.match(r"(?:\w+::)*(\w+)\s*\(", c.args[-1])
                raw = string(c.args[0]) if c.name == "nest" else ""
                if target and target[1] in bodies and raw is not None and target[1] not in way:
                    yield from chain(target[1], prefix + (template(raw, "axum") if raw else ""), (*way, target[1]))

    found.routes = best(r for n, (_, t, a, b) in bodies.items() if n not in nested and "Router::new" in t[a:b] for r in chain(n, "", (n,)))
    return found


def _rust_attributes(dialect: str):
    def extract(files: Mapping[str, str]) -> Found:
        found, texts = Found(), _texts(files, ".rs")
        types = Rust(texts, found.components)
        mounts: dict[str, list[str]] = {}
        for text in texts.values():
            if dialect == "rocket":
                for m in re.finditer(r'\.mount\(\s*"([^"]*)"\s*,\s*routes!\[([^\]]*)\]', text):
                    for name in re.findall(r"(\w+)\s*(?:,|$)", m[2].strip()):
                        mounts.setdefault(name, []).append(m[1])
            else:
                for m in re.finditer(r'web::scope\(\s*"([^"]*)"\s*\)', text):
                    at = m.end()
                    while c := re.compile(r"\s*\.\s*(\w+)\s*\(").match(text, at):
                        end = closing(text, c.end() - 1)
                        inside = text[c.end() : end]
                        if c[1] == "service" and re.fullmatch(r"\s*(?:\w+::)*\w+\s*", inside):
                            mounts.setdefault(inside.strip().rpartition("::")[2], []).append(m[1])
                        at = end + 1

        def candidates() -> Iterator[dict]:
            for path, text in texts.items():
                for m in re.finditer(r'#\[(get|post|put|patch|delete|head|options)\(\s*"([^"]*)"[^\]]*\]\s*(?:#\[[^\]]*\]\s*)*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)', text):
                    raw = m[2].split("?")[0]
                    query = re.findall(r"<(\w+)(?:\.\.)?>", m[2].partition("?")[2])
                    for prefix in mounts.get(m[3], [""] if dialect == "actix" else []):
                        route = _route(m[1], joined(prefix, template(raw, dialect)), path, text, m.start())
                        route["parameters"] += [parameter(q, "query", {"type": "string"}, False) for q in query]
                        yield _open(_rust_contract(text, m[3], types, route))
                    if dialect == "rocket" and m[3] not in mounts:
                        found.remark("unreachable-router", f"{m[3]} isn't mounted", path, line_at(text, m.start()))
                if dialect == "actix":
                    for m in re.finditer(r'\.route\(\s*"([^"]*)"\s*,\s*web::(get|post|put|patch|delete|head)\(\)', text):
                        scope = [s for s in re.finditer(r'web::scope\(\s*"([^"]*)"\s*\)', text[: m.start()]) if m.start() < text.find(";", s.end()) or text.find(";", s.end()) < 0]
                        yield _open(_route(m[2], joined(scope[-1][1] if scope else "", template(m[1], dialect)), path, text, m.start()))

        found.routes = best(candidates())
        return found

    return extract


# --- Django REST framework -------------------------------------------------------------------------------------------

#: A router's actions as (verb, on one object, status), and the mixins that bring them.
ACTIONS = {"list": ("get", False, 200), "create": ("post", False, 201), "retrieve": ("get", True, 200), "update": ("put", True, 200), "partial_update": ("patch", True, 200), "destroy": ("delete", True, 204)}
MIXINS = {"ModelViewSet": tuple(ACTIONS), "ReadOnlyModelViewSet": ("list", "retrieve"), "ListModelMixin": ("list",), "CreateModelMixin": ("create",), "RetrieveModelMixin": ("retrieve",), "UpdateModelMixin": ("update", "partial_update"), "DestroyModelMixin": ("destroy",)}
FIELDS = {"CharField": {"type": "string"}, "IntegerField": {"type": "integer"}, "FloatField": {"type": "number"}, "DecimalField": {"type": "string", "format": "decimal"}, "BooleanField": {"type": "boolean"}, "EmailField": {"type": "string", "format": "email"}, "URLField": {"type": "string", "format": "uri"}, "UUIDField": {"type": "string", "format": "uuid"}, "DateTimeField": {"type": "string", "format": "date-time"}, "DateField": {"type": "string", "format": "date"}}


def drf(files: Mapping[str, str]) -> Found:
    found, project = Found(), parse(dict(files))
    for path, error in project.broken:
        found.remark("analysis-failed", error, path)

    def serializer(module, cls) -> dict | None:
        given = next((n.value for n in cls.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "serializer_class" for t in n.targets)), None)
        place = find_class(project, module, dotted(given)) if given is not None else None
        if not place:
            return None
        name = place[1].name.removesuffix("Serializer") or place[1].name
        if name not in found.components:
            properties = {n.targets[0].id: dict(FIELDS.get(dotted(n.value.func).rpartition(".")[2], {})) for n in place[1].body if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.targets[0], ast.Name)}
            meta = next((n for n in place[1].body if isinstance(n, ast.ClassDef) and n.name == "Meta"), None)
            listed = next((constant(n.value) for n in meta.body if isinstance(n, ast.Assign) and n.targets[0].id == "fields"), None) if meta else None
            properties |= {f: {} for f in listed if isinstance(listed, list) and f not in properties} if isinstance(listed, list) else {}
            found.components[name] = {"type": "object", "properties": properties}
            found.components[f"partial_{name}"] = {"type": "object", "properties": properties}
        return {"$ref": f"#/components/schemas/{name}"}

    def viewset(module, cls, base: str, file: str, line: int) -> Iterator[dict]:
        names = {n.rpartition(".")[2] if isinstance(n, str) else n.name for _, n in bases(project, module, cls)}
        own = {n.name for n in cls.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
        actions = [a for a in ACTIONS if a in own or any(a in MIXINS.get(n, ()) for n in names)]
        shape = serializer(module, cls)
        for a in actions:
            verb, one, code = ACTIONS[a]
            route = candidate(verb, base + ("{id}/" if one else ""), file, line)
            route["parameters"] = [parameter("id", "path", {"type": "string"}, True)] if one else []
            if verb in ("post", "put", "patch"):
                body = {"$ref": shape["$ref"].replace("schemas/", "schemas/partial_")} if shape and verb == "patch" else shape
                route["request_body"] = {"required": True, "content": [{"media_type": "application/json", "schema": body or {}}]}
            if code == 204:
                route["responses"].append(response(204))
            elif shape:
                route["responses"].append(response(code, {"type": "array", "items": shape} if a == "list" else shape))
            yield _open(route)

    def dj(raw: str) -> str:
        return template(raw, "django")

    def urls(module, node, prefix: str, depth: int) -> Iterator[dict]:
        for call in node.elts if isinstance(node, (ast.List, ast.Tuple)) else ():
            if not isinstance(call, ast.Call) or dotted(call.func).rpartition(".")[2] not in ("path", "re_path", "url") or len(call.args) < 2:
                continue
            raw, target = constant(call.args[0], module), call.args[1]
            if not isinstance(raw, str):
                found.remark("dynamic-path", "a route's path isn't constant", module.path, call.lineno)
                continue
            full = "/" + "/".join(p for p in (prefix.strip("/"), dj(raw).strip("/")) if p) + "/"
            full = re.sub("/+", "/", full)
            name = dotted(target.func) if isinstance(target, ast.Call) else dotted(target)
            if name.rpartition(".")[2] == "include" and depth < 8:
                inner = constant(target.args[0], module) if target.args else None
                if isinstance(inner, str) and inner in project.by_suffix:
                    yield from listed(project.modules[project.by_suffix[inner]], full, depth + 1)
                elif target.args and dotted(target.args[0]).endswith(".urls"):
                    yield from routed(module, dotted(target.args[0]).rpartition(".")[0], full)
            elif name.endswith(".as_view"):
                place = find_class(project, module, name.removesuffix(".as_view"))
                for verb in [n.name for n in place[1].body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name in VERBS] if place else ():
                    route = candidate(verb, full, module.path, call.lineno)
                    route["parameters"] = [parameter(n, "path", {"type": "string"}, True) for n in names_in(full)]
                    yield _open(route)

    def routed(module, router: str, prefix: str) -> Iterator[dict]:
        for n in ast.walk(module.tree):
            if isinstance(n, ast.Call) and dotted(n.func) == f"{router}.register" and len(n.args) >= 2:
                raw, place = constant(n.args[0], module), find_class(project, module, dotted(n.args[1]))
                if isinstance(raw, str) and place:
                    yield from viewset(*place, re.sub("/+", "/", f"{prefix}/{raw.strip('/')}/" if raw else prefix), module.path, n.lineno)

    def listed(module, prefix: str, depth: int) -> Iterator[dict]:
        for n in module.tree.body:
            value = n.value if isinstance(n, (ast.Assign, ast.AugAssign)) and any(isinstance(t, ast.Name) and t.id == "urlpatterns" for t in (n.targets if isinstance(n, ast.Assign) else [n.target])) else None
            if isinstance(value, ast.Attribute) and value.attr == "urls":
                yield from routed(module, dotted(value.value), prefix)
            elif value is not None:
                parts = [value.left, value.right] if isinstance(value, ast.BinOp) else [value]
                for part in parts:
                    yield from routed(module, dotted(part.value), prefix) if isinstance(part, ast.Attribute) else urls(module, part, prefix, depth)

    included = {s for m in project.modules.values() for c in ast.walk(m.tree) if isinstance(c, ast.Call) and dotted(c.func).endswith("include") and c.args and isinstance(s := constant(c.args[0]), str)}
    roots = [m for p, m in project.modules.items() if re.search(r"(?:^|/)urls\.py$", p) and not any(project.by_suffix.get(s) == p for s in included)]
    found.routes = firsts(r for m in roots for r in listed(m, "/", 0))[0]
    return found


PACKS = {
    "laravel": ("php", laravel), "symfony": ("php", symfony), "slim": ("php", slim), "aspnet": ("csharp", aspnet), "fastendpoints": ("csharp", fastendpoints),
    "axum": ("rust", axum), "actix": ("rust", _rust_attributes("actix")), "rocket": ("rust", _rust_attributes("rocket")), "djangorestframework": ("python", drf),
}
