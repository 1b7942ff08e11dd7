import json

import pytest

from corvid.plans import openapi
from corvid.plans import scan as plans
from corvid.operators.diff import snapshot_diff
from corvid.sources import manifests
from corvid.sources.scan import BudgetExceeded, ignored, index_files
from corvid.streaming import rescan
from tests.test_packs import PROJECTS


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


def test_index(spark, tmp_path):
    root = put(tmp_path, {
        "a.py": "x = 1\n", "b.ts": "\ufefflet a".encode("utf-16-le"), "bad.py": b"\x00\x01", "big.go": "x" * 3000, "node_modules/m/i.js": "x", ".hidden/h.py": "x", "tests/t.py": "x", "x.test.ts": "x",
        "target/k.java": "x", "sub/target/Out.java": "x", "sub/pom.xml": "<project/>", "dist/d.js": "x", "env/e.py": "x", "venv/pyvenv.cfg": "x", "venv/v.py": "x", ".gitignore": "skip/\n*.gen.py\n!keep.gen.py\n", "skip/s.py": "x",
        "a.gen.py": "x", "keep.gen.py": "y", "deep/.gitignore": "/only.py\n", "deep/only.py": "x", "deep/er/only.py": "z", "config/r.yaml": "a: 1", "other/r.yaml": "x", "mine/m.py": "x",
    })
    files, skipped = index_files(spark, root, ignore=["mine/"], max_file_bytes=2000)
    got = {r.path: r for r in files.collect()}
    assert set(got) == {"a.py", "b.ts", "target/k.java", "dist/d.js", "env/e.py", "keep.gen.py", "deep/er/only.py", "config/r.yaml"}
    assert got["b.ts"].content == "let a" and got["config/r.yaml"].language == "yaml" and len(got["a.py"].hash) == 64
    assert {r.file for r in skipped.collect()} == {"bad.py", "big.go"}
    assert "tests/t.py" in {r.path for r in index_files(spark, root, include_tests=True)[0].collect()}
    with pytest.raises(BudgetExceeded):
        index_files(spark, root, max_files=3)
    with pytest.raises(ValueError):
        index_files(spark, root, max_files=0)
    assert ignored("a/b/c.py", [("", "a/**/c.py")]) and not ignored("a/c.py", [("b", "*.py")]) and ignored("build/x", [("", "build")])


def test_manifests(spark, tmp_path):
    root = put(tmp_path, {
        "package.json": json.dumps({"name": "top", "version": "2.1.0", "dependencies": {"express": "^4"}, "devDependencies": {"express": "x", "Vite": "5"}}), "requirements.txt": "Flask==2.0 # web\n-r more.txt\n\nuvicorn\n",
        "pyproject.toml": '[project]\nname = "p"\ndependencies = [\n  "fastapi>=0.1",\n]\n', "go.mod": "module example.com/x/svc\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.0\n)\n", "Cargo.toml": '[dependencies]\naxum = "0.7"\n', "composer.json": json.dumps({"require": {"Slim/Slim": "4"}}),
        "pom.xml": "<dependencies><dependency><groupId>io.micronaut</groupId><artifactId>micronaut-http-server-netty</artifactId></dependency></dependencies>", "build.gradle": "implementation 'org.springframework.boot:spring-boot-starter-web:3.1'", "a/b.csproj": '<PackageReference Include="FastEndpoints" Version="5" />',
    })
    texts = manifests.manifest_texts(spark, root)
    got = {r.package: r.version for r in manifests.packages(texts).collect()}
    assert got["express"] == "^4" and got["flask"] == "==2.0" and "uvicorn" in got and got["github.com/gin-gonic/gin"] == "v1.9.0" and "Vite" in got
    assert {"fastapi", "axum", "slim/slim", "io.micronaut:micronaut-http-server-netty", "org.springframework.boot:spring-boot-starter-web", "fastendpoints"} <= set(got)
    meta = manifests.project_meta(texts, texts).first()
    assert (meta.title, meta.version) == ("top", "2.1.0")


def test_scan_of_many_projects(spark, tmp_path):
    for name in ("fastapi", "flask", "gin", "spring", "express", "laravel"):
        put(tmp_path / name, PROJECTS[name][0])
    put(tmp_path / "broken", {"a.py": "from flask import Flask\ndef (\n"})
    found = plans.scan_project(spark, str(tmp_path), projects=True)
    got = {(r.project, r.method, r.path): r for r in found.operations.collect()}
    for name in ("fastapi", "flask", "gin", "spring", "express", "laravel"):
        assert {(m, p) for project, m, p in got if project == name} == PROJECTS[name][1], name
    remarks = {(r.project, r.reason) for r in found.unresolved.collect()}
    assert {("fastapi", "unreachable-router"), ("flask", "unreachable-blueprint"), ("broken", "analysis-failed"), ("broken", "handler-unresolved")} <= remarks
    report = found.report().first()
    assert report.routes == len(got) and report.high + report.not_high == report.routes
    docs = {r.project: json.loads(r.document) for r in plans.documents(found).collect()}
    assert openapi.invalid(plans.documents(found)).collect() == []
    one = docs["fastapi"]["paths"]["/api/v1/things/{thing_id}"]["get"]
    assert docs["fastapi"]["openapi"] == "3.2.0" and one["security"] == [{"HTTPBearer": []}] and "Thing" in docs["fastapi"]["components"]["schemas"] and docs["express"]["servers"] == [{"url": "http://localhost:4000"}]
    plans.write_documents(found, str(tmp_path / "out"))
    before = plans.routes_snapshot(found).cache()
    own = before.filter("project = 'flask'")
    assert snapshot_diff(own, own, "key", "fingerprint").count() == 0 and own.count() == 3
    put(tmp_path / "flask", {"app.py": PROJECTS["flask"][0]["app.py"].replace("jsonify([1])", "jsonify([2.5])")})
    after = plans.routes_snapshot(plans.scan_project(spark, str(tmp_path / "flask")))
    assert {r.kind for r in snapshot_diff(before.filter("project = 'flask'"), after, "key", "fingerprint").collect()} == {"changed"}


def test_workspace_leaves(spark, tmp_path):
    for leaf in ("apps/web", "packages/server"):
        put(tmp_path / leaf, {**PROJECTS["express"][0], "package.json": json.dumps({"dependencies": {"express": "4"}})})
    put(tmp_path, {"pnpm-workspace.yaml": "packages: ['packages/*']", "apps/docs/readme.md": "x"})
    assert plans.workspace_leaves(spark, str(tmp_path)) == ["apps/web", "packages/server"]
    assert plans.workspace_leaves(spark, str(tmp_path), most=1) == ["apps/web"]
    operations, scans = plans.scan_workspace(spark, str(tmp_path), frameworks=["koa"])
    assert operations.count() == 0 and len(scans) == 2
    operations, _ = plans.scan_workspace(spark, str(tmp_path / "apps"))
    assert {(r.method, r.path) for r in operations.collect()} == PROJECTS["express"][1]


def test_rescan_stream(spark, tmp_path):
    root, seen = tmp_path / "src", []
    put(root, {"a.py": "1", "b.py": "2"})

    def go():
        rescan.watch(rescan.file_stream(spark, str(root), "*.py"), str(tmp_path / "known"), str(tmp_path / "state"), lambda d: seen.append({(r.path.rsplit("/", 1)[1], r.kind) for r in d.collect()})).awaitTermination()

    go()
    assert seen == [{("a.py", "added"), ("b.py", "added")}]
    put(root, {"c.py": "3"})
    go()
    assert seen[1] == {("c.py", "added")}
