"""Java: Spring, JAX-RS and Micronaut controllers, by annotations on classes, methods and parameters."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from corvid.packs import Found
from corvid.packs.routes import best, candidate, joined, names_in, parameter, response
from corvid.packs.scanner import closing, line_at, split_top, status, string, without_comments

SCALARS = {
    "String": {"type": "string"}, "CharSequence": {"type": "string"}, "char": {"type": "string"}, "boolean": {"type": "boolean"}, "Boolean": {"type": "boolean"}, "BigDecimal": {"type": "number"},
    "int": {"type": "integer", "format": "int32"}, "Integer": {"type": "integer", "format": "int32"}, "short": {"type": "integer", "format": "int32"}, "long": {"type": "integer", "format": "int64"}, "Long": {"type": "integer", "format": "int64"}, "BigInteger": {"type": "integer"},
    "float": {"type": "number", "format": "float"}, "Float": {"type": "number", "format": "float"}, "double": {"type": "number", "format": "double"}, "Double": {"type": "number", "format": "double"},
    "UUID": {"type": "string", "format": "uuid"}, "URI": {"type": "string", "format": "uri"}, "LocalDate": {"type": "string", "format": "date"}, "LocalTime": {"type": "string", "format": "time"}, "Duration": {"type": "string", "format": "duration"},
    **{n: {"type": "string", "format": "date-time"} for n in ("LocalDateTime", "Instant", "OffsetDateTime", "ZonedDateTime", "Date")}, "byte[]": {"type": "string", "format": "binary"}, "MultipartFile": {"type": "string", "format": "binary"},
}
LISTS = {"List", "Set", "Collection", "Iterable", "Flux", "Stream", "ArrayList", "Page"}
WRAPPERS = {"Optional", "Mono", "ResponseEntity", "HttpResponse", "CompletableFuture", "Single", "Maybe", "Publisher", "Response", "HttpEntity"}


@dataclass
class Style:
    """A framework's annotations: which mark controllers, routes and parameters."""

    controller: str
    prefix: tuple[str, ...]
    verbs: dict[str, tuple[str, ...]]
    path_annotation: str | None
    places: dict[str, str]
    status: tuple[str, ...] = ()
    body_by_default: bool = False


def _mapping(suffix: str) -> dict[str, tuple[str, ...]]:
    return {f"{v.capitalize()}{suffix}": (v,) for v in ("get", "post", "put", "patch", "delete")}


STYLES = {
    "spring": Style(r"RestController|Controller", ("RequestMapping",), {**_mapping("Mapping"), "RequestMapping": ()}, None, {"PathVariable": "path", "RequestParam": "query", "RequestHeader": "header", "CookieValue": "cookie", "RequestBody": "body", "RequestPart": "form"}, ("ResponseStatus",)),
    "jaxrs": Style(r"Path", ("Path",), {v.upper(): (v,) for v in ("get", "post", "put", "patch", "delete", "head", "options")}, "Path", {"PathParam": "path", "QueryParam": "query", "HeaderParam": "header", "CookieParam": "cookie", "FormParam": "form", "Context": "", "BeanParam": ""}, (), True),
    "micronaut": Style(r"Controller", ("Controller",), {v.capitalize(): (v,) for v in ("get", "post", "put", "patch", "delete", "head", "options")}, None, {"PathVariable": "path", "QueryValue": "query", "Header": "header", "CookieValue": "cookie", "Body": "body", "Part": "form"}, ("Status",)),
}


@dataclass
class Annotation:
    name: str
    values: dict[str, str] = field(default_factory=dict)

    def strings(self, *keys: str) -> list[str]:
        for k in keys:
            if k in self.values:
                text = self.values[k]
                parts = split_top(text[1:-1]) if text.startswith("{") else [text]
                return [s for s in map(string, parts) if s is not None]
        return []


@dataclass
class Method:
    annotations: list[Annotation]
    returns: str
    name: str
    parameters: list[tuple[list[Annotation], str, str]]
    at: int
    body: str


@dataclass
class Class:
    file: str
    name: str
    kind: str
    annotations: list[Annotation]
    extends: list[str]
    start: int
    end: int
    header: str = ""


_ANNOTATION = re.compile(r"@(?!interface\b)([A-Za-z_][\w.]*)\s*")
_CLASS = re.compile(r"((?:@[\w.]+\s*(?:\((?:[^()]|\([^()]*\))*\))?\s*|(?:public|protected|private|abstract|final|static|sealed)\s+)*)\b(class|interface|record|enum)\s+([A-Z]\w*)\s*([^{;]*)\{")


def annotations(text: str) -> tuple[list[Annotation], str]:
    """Leading annotations of a declaration, and the rest of it."""
    out = []
    while m := _ANNOTATION.match(text.lstrip()):
        text = text.lstrip()
        end, values = m.end(), {}
        if end < len(text) and text[end] == "(":
            close = closing(text, end)
            for part in split_top(text[end + 1 : close]):
                k = re.match(r"([A-Za-z_]\w*)\s*=(?!=)\s*", part)
                values[k[1] if k else "value"] = part[k.end() :] if k else part
            end = close + 1
        out.append(Annotation(m[1].rpartition(".")[2], values))
        text = text[end:]
    return out, text.lstrip()


def classes(files: Mapping[str, str]) -> tuple[dict[str, str], list[Class]]:
    texts = {p: without_comments(t) for p, t in files.items() if p.endswith(".java")}
    out = []
    for path, text in texts.items():
        for m in _CLASS.finditer(text):
            marks, _ = annotations(re.sub(r"^\s*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*", "", m[1]))
            parents = re.findall(r"[A-Z]\w*", re.sub(r"<[^<>]*>", "", re.sub(r"^\s*\([^)]*\)", "", m[4])))
            out.append(Class(path, m[3], m[2], marks, parents, m.end(), closing(text, m.end() - 1), m[4]))
    return texts, out


def members(text: str, cls: Class) -> Iterator[str | Method]:
    """Fields as text and methods of a class body."""
    at = cls.start
    while at < cls.end:
        semi, brace, paren = (text.find(c, at, cls.end) for c in ";{(")
        # annotations may hold brackets: step over them
        lead = at
        while (m := re.compile(r"\s*@(?!interface\b)[\w.]+\s*").match(text, lead, cls.end)) is not None:
            lead = closing(text, m.end()) + 1 if m.end() < cls.end and text[m.end()] == "(" else m.end()
        semi, brace, paren = (text.find(c, lead, cls.end) for c in ";{(")
        ends = [x for x in (semi, brace) if x >= 0]
        if not ends:
            return
        stop = min(ends)
        assigned = 0 <= text.find("=", lead, stop) < (paren if paren >= 0 else stop)
        if 0 <= paren < stop and not assigned:
            close = closing(text, paren)
            body, tail = text.find("{", close, cls.end), text.find(";", close, cls.end)
            has_body = body >= 0 and (tail < 0 or body < tail)
            end = closing(text, body) if has_body else tail if tail >= 0 else cls.end
            marks, rest = annotations(text[at:paren].strip())
            words = re.sub(r"\b(?:public|protected|private|abstract|final|static|default|synchronized)\b", "", rest).split()
            if words and len(words) >= 2:
                returns = re.sub(r"^<[^>]*>\s*", "", " ".join(words[:-1]))
                parameters = []
                for p in _parameters(text[paren + 1 : close]):
                    own, declared = annotations(p)
                    declared = re.sub(r"\bfinal\s+", "", declared).strip()
                    kind, _, name = declared.rpartition(" ")
                    parameters.append((own, kind.strip(), name))
                yield Method(marks, returns, words[-1], parameters, lead, text[body:end] if has_body else "")
            at = end + 1
        elif stop == brace and not assigned:
            at = closing(text, brace) + 1
        else:
            end = text.find(";", closing(text, brace) if stop == brace else lead, cls.end)
            yield text[at : end if end >= 0 else cls.end].strip()
            at = (end if end >= 0 else cls.end) + 1


def _parameters(text: str) -> list[str]:
    """Parameters at commas outside brackets, generics included."""
    out, depth, start = [], 0, 0
    for part in re.finditer(r"[<>,()\"]", text):
        c = part[0]
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(text[start : part.start()].strip())
            start = part.end()
    last = text[start:].strip()
    return out + [last] if last else out


class Model:
    """Schemas of a project's classes."""

    def __init__(self, texts: dict[str, str], found: list[Class]):
        self.texts, self.classes, self.components = texts, {c.name: c for c in reversed(found)}, {}

    def of(self, kind: str, depth: int = 0) -> dict:
        kind = kind.strip()
        if depth > 6 or kind in ("void", "Void", "?", "Object", ""):
            return {}
        if kind in SCALARS:
            return dict(SCALARS[kind])
        if kind.endswith("[]"):
            return {"type": "array", "items": self.of(kind[:-2], depth + 1)}
        if m := re.fullmatch(r"([\w.]+)\s*<(.*)>", kind, re.S):
            head, args = m[1].rpartition(".")[2], _parameters(m[2])
            if head in LISTS:
                return {"type": "array", "items": self.of(args[0], depth + 1)}
            if head in ("Map", "HashMap"):
                return {"type": "object", "additionalProperties": self.of(args[-1], depth + 1)}
            if head in WRAPPERS:
                return self.of(args[0], depth + 1)
            kind = head
        name = kind.rpartition(".")[2]
        return self.component(name, depth) if name in self.classes else {}

    def component(self, name: str, depth: int) -> dict:
        ref = {"$ref": f"#/components/schemas/{name}"}
        if name in self.components:
            return ref
        cls = self.classes[name]
        text = self.texts[cls.file]
        self.components[name] = {}
        if cls.kind == "enum":
            head = split_top(text[cls.start : cls.end].split(";")[0])
            self.components[name] = {"type": "string", "enum": [re.match(r"\w+", v)[0] for v in head if re.match(r"[A-Z_]\w*", v)]}
            return ref
        properties, required = {}, []
        for parent in cls.extends:
            if parent in self.classes and self.classes[parent].kind == "class":
                self.component(parent, depth + 1)
                inner = self.components[parent]
                properties |= inner.get("properties", {})
                required += inner.get("required", [])
        fields = [f for f in members(text, cls) if isinstance(f, str)]
        if cls.kind == "record":
            fields += _parameters(cls.header[cls.header.find("(") + 1 : cls.header.rfind(")")])
        for f in fields:
            marks, rest = annotations(f)
            if re.search(r"\bstatic\b", rest) or any(a.name == "JsonIgnore" for a in marks):
                continue
            m = re.fullmatch(r"(?:(?:public|protected|private|final|transient|volatile)\s+)*(.+?)\s+(\w+)\s*(?:=.*)?", rest, re.S)
            if not m:
                continue
            wire = next((s for a in marks if a.name == "JsonProperty" for s in a.strings("value")), m[2])
            properties[wire] = self.constrained(self.of(m[1], depth + 1), marks)
            if any(a.name in ("NotNull", "NotBlank", "NotEmpty") for a in marks) or m[1] in ("int", "long", "double", "float", "boolean"):
                required.append(wire)
        self.components[name] = {"type": "object", "properties": properties, **({"required": required} if required else {})}
        return ref

    @staticmethod
    def constrained(schema: dict, marks: list[Annotation]) -> dict:
        out = dict(schema)
        for a in marks:
            number = lambda k, a=a: int(a.values[k]) if a.values.get(k, "").strip().lstrip("-").isdigit() else None
            if a.name == "Size":
                lows = {"minLength": number("min"), "maxLength": number("max")} if out.get("type") == "string" else {"minItems": number("min"), "maxItems": number("max")}
                out |= {k: v for k, v in lows.items() if v is not None}
            elif a.name in ("Min", "Max") and number("value") is not None:
                out["minimum" if a.name == "Min" else "maximum"] = number("value")
            elif a.name == "Email":
                out["format"] = "email"
            elif a.name == "Pattern" and string(a.values.get("regexp")):
                out["pattern"] = string(a.values["regexp"])
            elif a.name == "NotBlank":
                out.setdefault("minLength", 1)
        return out


#: Statuses of the methods that build a response.
BUILT = {"ok": 200, "created": 201, "accepted": 202, "noContent": 204, "badRequest": 400, "unauthorized": 401, "notFound": 404, "notAllowed": 405, "unprocessableEntity": 422, "serverError": 500}


class ErrorMethods:
    """Micronaut's error handlers: methods marked Error, of their controller if it has routes and else of the whole app, and
    classes that implement ExceptionHandler."""

    def __init__(self, model: Model, found: list[Class], verbs: Mapping[str, tuple[str, ...]]):
        self.model, self.classes = model, {c.name: c for c in reversed(found)}
        self.handlers: dict[tuple[str, str | int], Method] = {}
        for cls in found:
            methods = [m for m in members(model.texts[cls.file], cls) if isinstance(m, Method)]
            if any(a.name == "Controller" for a in cls.annotations):
                routed = any(a.name in verbs for m in methods for a in m.annotations)
                for m in methods:
                    for a in (a for a in m.annotations if a.name == "Error"):
                        scope = cls.name if routed and a.values.get("global", "").strip() != "true" else ""
                        kind = re.match(r"([\w.]+)\.class", a.values.get("exception") or a.values.get("value") or "")
                        if kind:
                            self.handlers.setdefault((scope, kind[1].rpartition(".")[2]), m)
                        if code := status(a.values.get("status")):
                            self.handlers.setdefault((scope, code), m)
            kind = re.search(r"\bExceptionHandler\s*<\s*([\w.]+)", cls.header)
            handle = next((m for m in methods if m.name == "handle" and len(m.parameters) == 2), None)
            if kind and handle:
                self.handlers.setdefault(("", kind[1].rpartition(".")[2]), handle)

    def _lineage(self, name: str) -> list[str]:
        """A class's name and those of its ancestors, near ones first."""
        out = [name]
        for n in out:
            out += [p for p in (self.classes[n].extends if n in self.classes else ()) if p not in out]
        return out

    def apply(self, cls: Class, method: Method, route: dict) -> None:
        """Add the responses to what a method throws: by the controller's own handlers, then by those of the app."""
        known = {r["status_code"] for r in route["responses"]}
        for m in re.finditer(r"\bthrow\s+new\s+([\w.]+)\s*\(", method.body):
            args = split_top(method.body[m.end() : closing(method.body, m.end() - 1)])
            name = m[1].rpartition(".")[2]
            code = status(args[0]) if name == "HttpStatusException" and args else None
            wanted = [code, *self._lineage(name)] if code else self._lineage(name)
            handler = next((h for scope in (cls.name, "") for w in wanted if (h := self.handlers.get((scope, w)))), None)
            answer = self._answer(handler, code) if handler else response(code) if code else None
            if answer and answer["status_code"] not in known:
                known.add(answer["status_code"])
                route["responses"].append(answer)

    def _answer(self, handler: Method, thrown: int | None) -> dict:
        marked = next((status((a.values.get("value") or "").strip()) for a in handler.annotations if a.name == "Status"), None)
        built = re.search(r"\.status\(\s*([\w.]+)|HttpResponse\s*\.\s*(?:<[^>]*>\s*)?(" + "|".join(BUILT) + r")\b", handler.body)
        code = marked or (status(built[1]) if built and built[1] else BUILT[built[2]] if built else None) or thrown or 500
        return response(code, self.model.of(handler.returns) or None)


def pack(framework: str):
    style = STYLES[framework]

    def routes_of(model: Model, found: Found, cls: Class, methods: list[Method], base: list[str], errors: ErrorMethods | None) -> Iterator[dict]:
        for method in methods:
            named = {a.name: a for a in method.annotations}
            for annotation in method.annotations:
                if annotation.name not in style.verbs:
                    continue
                verbs = style.verbs[annotation.name]
                if not verbs:
                    verbs = tuple(v.lower() for v in re.findall(r"RequestMethod\.(\w+)", annotation.values.get("method", ""))) or ("get",)
                holder = named.get(style.path_annotation) if style.path_annotation else annotation
                subs = holder.strings("value", "path", "uri") if holder else []
                if holder and not subs and ("value" in holder.values or "path" in holder.values):
                    found.remark("dynamic-path", f"the path of {cls.name}.{method.name} isn't constant", cls.file, line_at(model.texts[cls.file], method.at))
                    continue
                for verb in verbs:
                    for prefix in base or [""]:
                        for sub in subs or [""]:
                            full = re.sub(r"\{\s*([^{}:?]+?)\s*(?::[^{}]*(?:\{[^}]*\}[^{}]*)*)?\}", r"{\1}", joined(prefix, re.sub(r"\{\?.*?\}$", "", sub)))
                            route = described(model, cls, method, candidate(verb, full, cls.file, line_at(model.texts[cls.file], method.at)), named)
                            if errors:
                                errors.apply(cls, method, route)
                            yield route

    def described(model: Model, cls: Class, method: Method, route: dict, named: dict) -> dict:
        template_names = names_in(route["full_path"])
        form: dict = {}
        for marks, kind, name in method.parameters:
            mark = next((a for a in marks if a.name in style.places), None)
            place = style.places[mark.name] if mark else None
            given = (mark.strings("value", "name") or [name])[0] if mark else name
            schema = model.of(kind)
            if place is None:
                if name in template_names:
                    place = "path"
                elif framework == "micronaut" and schema.get("$ref") is None and schema:
                    place = "query"
                elif style.body_by_default or (framework == "micronaut" and schema.get("$ref")):
                    place = "body" if schema else ""
                elif schema.get("type") in ("string", "integer", "number", "boolean"):
                    place = "query"
                elif framework == "spring" and schema.get("$ref"):
                    inner = model.components[schema["$ref"].rpartition("/")[2]]
                    route["parameters"] += [parameter(k, "query", v, False) for k, v in inner.get("properties", {}).items()]
                    continue
            if place in ("path", "query", "header", "cookie"):
                optional = mark is None or mark.values.get("required", "").strip() == "false" or "defaultValue" in mark.values or any(a.name in ("Nullable", "DefaultValue") for a in marks) or kind.startswith("Optional") or (framework == "jaxrs" and place != "path")
                wire = given.lower() if place == "header" and given == name else given
                if not schema:
                    route["gaps"].append({"path": "path-param-untyped", "query": "query-unknown"}.get(place, "header-unknown"))
                route["parameters"].append(parameter(wire, place, schema or {"type": "string"}, place == "path" or not optional))
            elif place == "body":
                route["request_body"] = {"required": not (mark and mark.values.get("required", "").strip() == "false"), "content": [{"media_type": "application/json", "schema": schema}]}
            elif place == "form":
                form[given] = schema
        if form:
            route["request_body"] = {"required": True, "content": [{"media_type": "multipart/form-data", "schema": {"type": "object", "properties": form, "required": list(form)}}]}
        code = next((status((a.values.get("value") or a.values.get("code") or "").strip()) for n, a in named.items() if n in style.status), None)
        returns = method.returns.strip()
        schema = model.of(returns)
        built = re.search(r"\.status\(\s*([\w.]+)\s*\)|ResponseEntity\.(created|noContent|accepted|ok)\b|HttpResponse\.(created|noContent|accepted|ok)\b", method.body)
        if code is None and built:
            code = status(built[1]) if built[1] else {"created": 201, "noContent": 204, "accepted": 202, "ok": 200}[built[2] or built[3]]
        if returns in ("void", "Void") or re.fullmatch(r"\w+<Void>", returns):
            route["responses"].append(response(code or (204 if framework == "jaxrs" else 200)))
        elif schema:
            route["responses"].append(response(code or 200, schema))
        elif framework == "spring" and returns == "String":
            route["responses"].append(response(code or 200, {"type": "string"}, "text/html"))
        else:
            route["gaps"].append("response-unknown")
        return route

    def extract(files: Mapping[str, str]) -> Found:
        found = Found()
        texts, all_classes = classes(files)
        model = Model(texts, all_classes)
        by_name = {c.name: c for c in all_classes}
        candidates: list[dict] = []
        errors = ErrorMethods(model, all_classes, style.verbs) if framework == "micronaut" else None
        for cls in all_classes:
            marks = {a.name: a for a in cls.annotations}
            if cls.kind not in ("class", "record") or not any(re.fullmatch(style.controller, n) for n in marks):
                continue
            methods = [m for m in members(texts[cls.file], cls) if isinstance(m, Method)]
            base = next((marks[p].strings("value", "path") for p in style.prefix if p in marks), [])
            for parent in cls.extends:  # mappings declared on an interface; the class's own win
                above = by_name.get(parent)
                if above is None or above.kind != "interface":
                    continue
                own = {(m.name, len(m.parameters)): m for m in methods}
                for m in members(texts[above.file], above):
                    if isinstance(m, Method):
                        mine = own.get((m.name, len(m.parameters)))
                        if mine is not None and not any(a.name in style.verbs for a in mine.annotations):
                            mine.annotations = m.annotations
                            mine.parameters = [(a or b, k, n) for (a, k, n), (b, _, _) in zip(mine.parameters, m.parameters)]
                inherited = {a.name: a for a in above.annotations}
                base = base or next((inherited[p].strings("value", "path") for p in style.prefix if p in inherited), [])
            candidates += routes_of(model, found, cls, methods, base, errors)
        found.routes = best(candidates)
        found.components = model.components
        return found

    return extract


PACKS = {name: pack(name) for name in STYLES}
