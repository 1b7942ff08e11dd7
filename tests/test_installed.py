import json

from corvid.plans import review
from corvid.plans import scan as plans
from corvid.sources import installed
from tests.test_scan import put


def test_entries_by_manifest():
    e = installed.entry_of
    assert e({}, ".") == "index.js" and e({"main": "a.js"}, ".") == "a.js" and e({"main": "a.js", "module": "m.js"}, ".") == "m.js" and e({"main": "a.js"}, "./x/y.js") == "x/y.js"
    exports = {".": {"types": "t.d.ts", "node": {"require": "r.cjs", "import": "n.js"}, "default": "d.js"}, "./sub": "./s.js", "./deep/*": {"default": "./src/*.js"}, "./closed": None}
    assert e({"exports": exports}, ".") == "n.js" and e({"exports": exports}, "./sub") == "./s.js" and e({"exports": exports}, "./deep/a/b") == "./src/a/b.js" and e({"exports": exports}, "./other") is None and e({"exports": exports}, "./closed") is None
    assert e({"exports": "./only.js"}, ".") == "./only.js" and e({"exports": {"default": "./x.js"}}, ".") == "./x.js"
    assert installed.package_of("@a/b/c/d") == ("@a/b", "./c/d") and installed.package_of("a") == ("a", ".")


FILES = {
    "package.json": json.dumps({"dependencies": {"express": "4"}}), "src/app.js": "const express = require('express');\nconst { send } = require('lib');\nconst { far } = require('@s/pkg/util');\nconst app = express();\napp.get('/x', (req, res) => send(res, far(req)));\napp.listen(3000);\n",
    "node_modules/lib/package.json": json.dumps({"exports": {".": {"import": "./main.js"}}}), "node_modules/lib/main.js": "const inner = require('./inner');\nmodule.exports.send = function send(res, x) { return inner(res, x) }\n", "node_modules/lib/inner.js": "require('dep'); module.exports = 1",
    "node_modules/lib/node_modules/dep/package.json": "{}", "node_modules/lib/node_modules/dep/index.js": "require('../../../..//etc'); require('dep2')", "node_modules/dep/package.json": "{}", "node_modules/dep/index.js": "wrong",
    "node_modules/dep2/package.json": "{}", "node_modules/dep2/index.js": "require('dep3')", "node_modules/dep3/package.json": "{}", "node_modules/dep3/index.js": "too deep",
    "node_modules/@s/pkg/package.json": json.dumps({"exports": {"./*": "./lib/*.js"}}), "node_modules/@s/pkg/lib/util.js": "exports.far = (x) => x", "node_modules/evil/package.json": json.dumps({"main": "../../src/app.js"}),
}


def test_packages_are_followed_from_a_scan(spark, tmp_path):
    put(tmp_path / "one", FILES)
    put(tmp_path / "two", {"a.js": "require('lib')"})
    missing = spark.createDataFrame([("one", "src/app.js", n) for n in ("express", "lib", "@s/pkg/util", "evil", "node:fs", "../x")] + [("two", "a.js", "lib")], "project string, path string, name string")
    files, edges = installed.installed_sources(missing, str(tmp_path), projects=True)
    got = {(r.path, r.target) for r in edges.collect()}
    base = "node_modules/lib"
    assert got == {("src/app.js", f"{base}/main.js"), ("src/app.js", "node_modules/@s/pkg/lib/util.js"), (f"{base}/main.js", f"{base}/inner.js"), (f"{base}/inner.js", f"{base}/node_modules/dep/index.js"), (f"{base}/node_modules/dep/index.js", "node_modules/dep2/index.js")}
    assert {(r.project, r.path): r.content for r in files.collect()} == {("one", t): FILES[t] for _, t in got}
    assert installed.installed_sources(missing, str(tmp_path), projects=True, most_files=2)[0].count() == 2 and installed.installed_sources(missing.limit(0), str(tmp_path))[0].count() == 0
    found = plans.scan_project(spark, str(tmp_path), projects=True)
    shown = {r.route: {f.path for f in r.files} for r in found.contexts(installed=True).collect()}
    assert {"src/app.js", f"{base}/main.js", "node_modules/@s/pkg/lib/util.js"} <= shown["GET /x"]


def test_questions_come_in_batches_and_name_other_components():
    candidate = lambda k: {"method": "get", "full_path": f"/{k}", "gaps": ["response-unknown"], "parameters": [], "responses": [], "request_body": None, "confidence": "low"}
    told, asked = [], []
    components = {"Big": {"type": "object", "properties": {f"p{k}": {} for k in range(60)} | {"__proto__": {}}}}
    out, failures = review.fill_gaps([candidate(k) for k in range(6)], components, lambda q: asked.append(q) or "{}", on_progress=lambda *x: told.append(x))
    assert len(out) == 6 and not failures and len(asked) == 6
    assert told == [("review-start", '{"total": 6}'), ("review-batch", '{"done": 4, "total": 6}'), ("review-batch", '{"done": 6, "total": 6}')]
    assert '"p39"' in asked[0] and '"p40"' not in asked[0]
