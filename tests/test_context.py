from pyspark.sql import functions as F

from corvid.plans import context
from corvid.sources import imports

SOURCES = {
    "web/src/app.ts": "import { load } from './lib/load';\nimport x from './lib/x.js';\nimport express from 'express';\nconst y = require('../shared');\n", "web/src/lib/load.ts": "export const load = 1", "web/src/lib/x.ts": "export {}", "web/shared/index.js": "module.exports = 1",
    "py/app/main.py": "from .routers import items, users\nfrom app.models import Thing\nimport app.util\nimport os\n", "py/app/routers/__init__.py": "", "py/app/routers/items.py": "from ..models import Thing\nfrom . import users", "py/app/routers/users.py": "x", "py/app/models.py": "class Thing: ...", "py/app/util.py": "y",
    "j/a/Ctl.java": "package a;\nimport b.Dto;\nimport c.*;\nimport org.x.Outside;\nclass Ctl { Dto d; Same s; Wild w; Twice t; }", "j/a/Same.java": "package a;\nclass Same {}", "j/b/Dto.java": "package b;\nclass Dto {}", "j/c/Wild.java": "package c;\nclass Wild {}", "j/c/T1.java": "package c;\nclass Twice {}", "j/c/T2.java": "package c;\nclass Twice {}",
    "p/C.php": "<?php\nnamespace App;\nuse Lib\\Dto as D;\nuse Lib\\Tool;\nclass C { function a(Tool $t, Own $o) {} }", "p/Tool.php": "<?php\nnamespace Lib;\nclass Tool {}", "p/Own.php": "<?php\nnamespace App;\nclass Own {}",
    "r/src/main.rs": "mod routes;\nuse crate::models::Thing;\nuse crate::routes::users::list;\n", "r/src/routes/mod.rs": "pub mod users;", "r/src/routes/users.rs": "pub fn list() {}", "r/src/models.rs": "pub struct Thing;",
    "g/main.go": 'package main\nimport (\n\t"example.com/svc/store"\n\tdb "example.com/svc/data/v2"\n\t"fmt"\n\t"github.com/gin-gonic/gin"\n)\nfunc main() { store.Open(); db.Rows(); helper() }\n', "g/help.go": "package main\nfunc helper() {}\n", "g/aside.go": "package main\nfunc other() {}\n",
    "g/store/a.go": "package store\nfunc Open() { shut() }\n", "g/store/b.go": "package store\nfunc shut() {}\nfunc Unused() {}\n", "g/data/v2/d.go": "package data\nvar (\n\tRows = 1\n)\n", "n/A.cs": "using Lib;\nnamespace App;\nclass A { B b; }", "n/B.cs": "namespace Lib;\nclass B {}",
}
LANGUAGE = {"ts": "typescript", "js": "javascript", "py": "python", "java": "java", "php": "php", "rs": "rust", "go": "go", "cs": "csharp"}


def table(spark, sources, project="one"):
    return spark.createDataFrame([(project, p, LANGUAGE[p.rsplit(".", 1)[1]], t) for p, t in sources.items()], "project string, path string, language string, content string")


def test_imports_of_every_language(spark):
    files = table(spark, SOURCES).unionByName(table(spark, {"web/src/lib/load.js": "other project"}, "two"))
    edges, missing = imports.import_edges(files)
    got = {(r.path, r.target) for r in edges.collect() if r.project == "one"}
    assert got == {
        ("web/src/app.ts", "web/src/lib/load.ts"), ("web/src/app.ts", "web/src/lib/x.ts"), ("web/src/app.ts", "web/shared/index.js"),
        ("py/app/main.py", "py/app/routers/items.py"), ("py/app/main.py", "py/app/routers/users.py"), ("py/app/main.py", "py/app/routers/__init__.py"), ("py/app/main.py", "py/app/models.py"), ("py/app/main.py", "py/app/util.py"),
        ("py/app/routers/items.py", "py/app/models.py"), ("py/app/routers/items.py", "py/app/routers/users.py"), ("py/app/routers/items.py", "py/app/routers/__init__.py"),
        ("j/a/Ctl.java", "j/b/Dto.java"), ("j/a/Ctl.java", "j/a/Same.java"), ("j/a/Ctl.java", "j/c/Wild.java"), ("p/C.php", "p/Tool.php"), ("p/C.php", "p/Own.php"),
        ("r/src/main.rs", "r/src/routes/mod.rs"), ("r/src/main.rs", "r/src/models.rs"), ("r/src/main.rs", "r/src/routes/users.rs"), ("r/src/routes/mod.rs", "r/src/routes/users.rs"),
        ("g/main.go", "g/store/a.go"), ("g/main.go", "g/help.go"), ("g/store/a.go", "g/store/b.go"), ("g/main.go", "g/data/v2/d.go"), ("n/A.cs", "n/B.cs"),
    }
    lost = {(r.path, r.name) for r in missing.collect()}
    assert {("web/src/app.ts", "express"), ("py/app/main.py", "os"), ("j/a/Ctl.java", "org.x.Outside"), ("g/main.go", "github.com/gin-gonic/gin"), ("p/C.php", "Lib\\Dto")} <= lost
    assert imports.import_edges(files.limit(0))[0].count() == 0


def test_contexts_of_routes(spark):
    filler = "".join(f"// filler line number {k} of a long file\n" for k in range(400))
    handler = "function list(req, res) { return useful(req) }"
    sources = {
        "src/app.js": "const h = require('./handlers');\napp.get('/x', h.list);\n", "src/handlers.js": f"const u = require('./useful');\nconst z = require('./aside');\n{filler}{handler}\n{filler}", "src/useful.js": f"const d = require('./deep');\n{filler}function useful(a) {{\n  return 7\n}}\n{filler}",
        "src/aside.js": "1", "src/deep.js": "require('left-pad')",
    }
    routes = spark.createDataFrame([("one", "GET /x", "src/app.js", handler), ("one", "GET /y", "src/app.js", None), ("one", "GET /z", None, "nothing holds this text"), ("two", "GET /x", "src/app.js", handler)], "project string, route string, origin string, handler string")
    got = {(r.project, r.route): r for r in context.review_contexts(routes, table(spark, sources)).collect()}
    assert len(got) == 4
    x = got["one", "GET /x"]
    assert [f.path for f in x.files] == ["src/handlers.js", "src/useful.js", "src/aside.js", "src/deep.js"]  # useful shares the handler's name
    first, second = x.files[0], x.files[1]
    assert first.truncated and handler in first.source and first.source.startswith("const u") and context.MARKER in first.source and len(first.source) <= 6000
    assert second.truncated and "function useful(a)" in second.source and x.unavailable == ["left-pad"] and x.limitations == []
    for f in x.files:
        assert all(part in sources[f.path] for part in f.source.split(context.MARKER))
    y = got["one", "GET /y"]
    assert [f.path for f in y.files][:2] == ["src/app.js", "src/handlers.js"] and y.limitations == ["The file that holds the handler wasn't found."]
    assert got["one", "GET /z"].files == [] and got["two", "GET /x"].files == [] and got["two", "GET /x"].unavailable == ["src/app.js"]
    small = context.review_contexts(routes, table(spark, sources), most_files=1).filter("project = 'one' AND route = 'GET /x'").first()
    assert len(small.files) == 1 and {"src/useful.js", "src/aside.js"} <= set(small.unavailable) and any("budget" in x for x in small.limitations)


def test_declarations(spark):
    got = context.declarations(table(spark, {"a.py": "x = 1\nclass A:\n    def b(self): ...\n\nasync def c(): ...\n"})).select("name", F.col("start"), F.col("end")).collect()
    assert {(r.name, r.start, r.end) for r in got} == {("A", 6, 15), ("b", 15, 37), ("c", 37, 56)}
