"""Facts from Python sources, by the standard library's parser: imports, classes, functions, constants, schemas."""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from corvid.functions.schemas import of_literal, partial

#: Schemas of scalar annotations, and the wrappers whose argument counts.
SCALARS: dict[str, dict] = {
    "str": {"type": "string"}, "int": {"type": "integer"}, "float": {"type": "number"}, "bool": {"type": "boolean"}, "bytes": {"type": "string", "format": "binary"},
    "None": {"type": "null"}, "Decimal": {"type": "number"}, "datetime": {"type": "string", "format": "date-time"}, "date": {"type": "string", "format": "date"},
    "time": {"type": "string", "format": "time"}, "timedelta": {"type": "string", "format": "duration"}, "UUID": {"type": "string", "format": "uuid"},
    "EmailStr": {"type": "string", "format": "email"}, "HttpUrl": {"type": "string", "format": "uri"}, "AnyUrl": {"type": "string", "format": "uri"},
}
LISTS = {"list", "List", "Sequence", "Iterable", "set", "Set", "frozenset", "FrozenSet", "tuple", "Tuple"}
MAPS = {"dict", "Dict", "Mapping"}
DEPTH = 6


@dataclass
class Module:
    path: str
    tree: ast.Module
    names: dict[str, tuple[str, str]] = field(default_factory=dict)  # local name -> (module, name or "")
    constants: dict[str, object] = field(default_factory=dict)


@dataclass
class Project:
    """A project's parsed modules; modules are found by any suffix of their dotted path, later files winning."""

    modules: dict[str, Module] = field(default_factory=dict)
    by_suffix: dict[str, str] = field(default_factory=dict)
    broken: list[tuple[str, str]] = field(default_factory=list)
    models: dict[str, tuple[Module, ast.ClassDef]] = field(default_factory=dict)
    components: dict[str, object] = field(default_factory=dict)

    def resolve(self, module: Module, name: str) -> tuple[Module, str] | None:
        """Where a module's name is defined: (module, name there), following imports; the module itself if not imported."""
        head, _, rest = name.partition(".")
        if head not in module.names:
            return module, name
        source, inner = module.names[head]
        full = f"{source}.{inner}" if inner else source
        for dotted, left in ((full, rest), (source, ".".join(filter(None, (inner, rest))))):
            if dotted in self.by_suffix:
                return self.modules[self.by_suffix[dotted]], left
        return None


def dotted(node: ast.AST) -> str:
    """a.b.c of a name or attribute chain, else an empty string."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := dotted(node.value)):
        return f"{head}.{node.attr}"
    return ""


def constant(node: ast.AST | None, module: Module | None = None):
    """A constant's value (names of module constants and joined strings included); Ellipsis where it isn't one."""
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, ast.Name) and module is not None and node.id in module.constants:
        return module.constants[node.id]
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        a, b = constant(node.left, module), constant(node.right, module)
        return a + b if isinstance(a, str) and isinstance(b, str) else ...
    if isinstance(node, ast.JoinedStr):
        parts = [constant(v.value if isinstance(v, ast.FormattedValue) else v, module) for v in node.values]
        return "".join(map(str, parts)) if ... not in parts else ...
    if isinstance(node, (ast.List, ast.Tuple)):
        return [constant(x, module) for x in node.elts]
    return ...


def keyword(call: ast.Call, name: str) -> ast.AST | None:
    return next((k.value for k in call.keywords if k.arg == name), None)


def parse(files: dict[str, str]) -> Project:
    out = Project()
    for path, text in files.items():
        if not path.endswith(".py"):
            continue
        try:
            module = Module(path, ast.parse(text))
        except (SyntaxError, ValueError) as error:
            out.broken.append((path, str(error)))
            continue
        out.modules[path] = module
        parts = path.removesuffix(".py").removesuffix("/__init__").split("/")
        for k in range(len(parts)):
            out.by_suffix[".".join(parts[k:])] = path
        for node in ast.walk(module.tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    module.names[a.asname or a.name.partition(".")[0]] = (a.name if a.asname else a.name.partition(".")[0], "")
            elif isinstance(node, ast.ImportFrom):
                base = parts[: len(parts) - node.level + path.endswith("__init__.py")] if node.level else []
                source = ".".join([*base, *([node.module] if node.module else [])])
                for a in node.names:
                    module.names[a.asname or a.name] = (source, a.name)
        for node in module.tree.body:
            if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                value = constant(node.value, module)
                if value is not ...:
                    module.constants[node.targets[0].id] = value
            elif isinstance(node, ast.ClassDef):
                out.models.setdefault(f"{path}:{node.name}", (module, node))
    return out


def find_class(project: Project, module: Module, name: str) -> tuple[Module, ast.ClassDef] | None:
    place = project.resolve(module, name)
    return project.models.get(f"{place[0].path}:{place[1]}") if place else None


def bases(project: Project, module: Module, cls: ast.ClassDef, depth: int = 8) -> list[tuple[Module, ast.ClassDef | str]]:
    """A class's ancestors, nearest last; those outside the project by name."""
    out: list = []
    if depth:
        for b in cls.bases:
            name = dotted(b.value if isinstance(b, ast.Subscript) else b)
            found = find_class(project, module, name)
            if found and found[1] is not cls:
                out += bases(project, *found, depth - 1) + [found]
            else:
                out.append((module, name))
    return out


def kind_of(project: Project, module: Module, cls: ast.ClassDef) -> str:
    names = {n.rpartition(".")[2] if isinstance(n, str) else n.name for _, n in bases(project, module, cls)}
    if names & {"Enum", "IntEnum", "StrEnum"}:
        return "enum"
    if names & {"BaseModel", "BaseSettings", "SQLModel", "GenericModel"}:
        return "model"
    if names & {"TypedDict", "NamedTuple"} or any(dotted(d.func if isinstance(d, ast.Call) else d).endswith("dataclass") for d in cls.decorator_list):
        return "record"
    return "class"


def nullable(schema: dict) -> dict:
    kinds = schema.get("type")
    if isinstance(kinds, str):
        return {**schema, "type": [kinds, "null"]}
    return {"anyOf": [schema, {"type": "null"}]}


def schema_of(project: Project, module: Module, node: ast.AST | None, depth: int = 0) -> dict:
    """The schema of an annotation; {} where it isn't known. Classes become components."""
    if node is None or depth > DEPTH:
        return {}
    if isinstance(node, ast.Constant):
        if node.value is None:
            return {"type": "null"}
        return schema_of(project, module, ast.parse(node.value, mode="eval").body, depth + 1) if isinstance(node.value, str) else {}
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return _union(project, module, [node.left, node.right], depth)
    if isinstance(node, ast.Subscript):
        head = dotted(node.value).rpartition(".")[2]
        args = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        if head in ("Optional", "Union"):
            return _union(project, module, [*args, *([ast.Constant(None)] if head == "Optional" else [])], depth)
        if head == "Annotated":
            return schema_of(project, module, args[0], depth)
        if head == "Literal":
            values = [constant(a) for a in args]
            base = of_literal(values[0])
            return {**base, "enum": values}
        if head in ("tuple", "Tuple") and not (len(args) == 2 and isinstance(args[1], ast.Constant) and args[1].value is ...):
            return {"type": "array", "prefixItems": [schema_of(project, module, a, depth + 1) for a in args], "minItems": len(args), "maxItems": len(args)}
        if head in LISTS:
            unique = {"uniqueItems": True} if head.lower().endswith("set") else {}
            return {"type": "array", "items": schema_of(project, module, args[0], depth + 1), **unique}
        if head in MAPS:
            return {"type": "object", "additionalProperties": schema_of(project, module, args[-1], depth + 1)}
        return schema_of(project, module, node.value, depth + 1)
    name = dotted(node)
    short = name.rpartition(".")[2]
    if short in SCALARS:
        return dict(SCALARS[short])
    if short in LISTS:
        return {"type": "array", "items": {}}
    if short in MAPS:
        return {"type": "object", "additionalProperties": {}}
    found = find_class(project, module, name) if name else None
    if found is None or kind_of(project, *found) == "class":
        return {}
    return component(project, *found)


def _union(project: Project, module: Module, nodes: list[ast.AST], depth: int) -> dict:
    flat = [schema_of(project, module, n, depth + 1) for n in nodes]
    rest = [s for s in flat if s != {"type": "null"}]
    out = rest[0] if len(rest) == 1 else {"anyOf": rest}
    return out if len(rest) == len(flat) else nullable(out)


#: Constraints of fields by the argument that sets them.
CONSTRAINTS = {"ge": "minimum", "gt": "exclusiveMinimum", "le": "maximum", "lt": "exclusiveMaximum", "min_length": "minLength", "max_length": "maxLength", "pattern": "pattern", "regex": "pattern", "description": "description"}


def constrained(schema: dict, call: ast.AST | None, module: Module) -> dict:
    if not isinstance(call, ast.Call):
        return schema
    more = {CONSTRAINTS[k.arg]: v for k in call.keywords if k.arg in CONSTRAINTS and (v := constant(k.value, module)) is not ...}
    return {**schema, **more}


def component(project: Project, module: Module, cls: ast.ClassDef) -> dict:
    """A reference to the class's component, which is made on first use."""
    ref = {"$ref": f"#/components/schemas/{cls.name}"}
    if cls.name in project.components:
        return ref
    project.components[cls.name] = {}
    lineage = [x for x in bases(project, module, cls) if not isinstance(x[1], str)] + [(module, cls)]
    if kind_of(project, module, cls) == "enum":
        values = [constant(n.value, module) for _, c in lineage for n in c.body if isinstance(n, ast.Assign)]
        project.components[cls.name] = {**of_literal(values[0] if values else ""), "enum": [v for v in values if v is not ...]}
        return ref
    properties, required = {}, []
    for owner, c in lineage:
        for n in c.body:
            if not isinstance(n, ast.AnnAssign) or not isinstance(n.target, ast.Name) or dotted(n.annotation).endswith("ClassVar"):
                continue
            call = n.value if isinstance(n.value, ast.Call) and dotted(n.value.func).rpartition(".")[2] in ("Field", "field") else None
            alias = constant(keyword(call, "alias"), owner) if call else ...
            name = alias if isinstance(alias, str) else n.target.id
            properties[name] = constrained(schema_of(project, owner, n.annotation, 1), call, owner)
            default = n.value is not None and call is None
            if call is not None:
                first = call.args[0] if call.args else keyword(call, "default") or keyword(call, "default_factory")
                default = first is not None and not (isinstance(first, ast.Constant) and first.value is ...)
            if name in required:
                required.remove(name)
            if not default:
                required.append(name)
    schema: dict = {"type": "object", "properties": properties, **({"required": required} if required else {})}
    doc = ast.get_docstring(cls)
    project.components[cls.name] = {**schema, **({"description": doc} if doc else {})}
    return ref


def literal_schema(project: Project, module: Module, node: ast.AST | None) -> dict | None:
    """The schema of a returned expression; None where it isn't a literal or a known class."""
    if isinstance(node, ast.Dict):
        keys = [constant(k, module) if k is not None else ... for k in node.keys]
        named = {k: literal_schema(project, module, v) or {} for k, v in zip(keys, node.values) if isinstance(k, str)}
        out = {"type": "object", "properties": named, "required": list(named)}
        return out if len(named) == len(keys) else partial(out, ["spread"])
    if isinstance(node, (ast.List, ast.Tuple)):
        return {"type": "array", "items": (literal_schema(project, module, node.elts[0]) or {}) if node.elts else {}}
    if isinstance(node, ast.ListComp):
        return {"type": "array", "items": literal_schema(project, module, node.elt) or {}}
    if isinstance(node, ast.JoinedStr):
        return {"type": "string"}
    if isinstance(node, ast.Call) and (found := find_class(project, module, dotted(node.func))) and kind_of(project, *found) != "class":
        return component(project, *found)
    value = constant(node, module) if node is not None else ...
    return None if value is ... else of_literal(value)
