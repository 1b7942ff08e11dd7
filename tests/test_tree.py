import pytest
from pyarrow import fs

from corvid.sources import rules, scan, tree
from tests.test_scan import put

FILES = {
    "a.py": "x", "pkg/__init__.py": "", "pkg/_own.py": "y", "node_modules/deep/er/i.js": "x", ".git/h.py": "x", "skip/much/s.py": "x", "kept/k.py": "x", ".gitignore": "skip/\n*.gen.py\n", "a.gen.py": "x", "kept/b.gen.py": "x",
    "dist/assets/d.js": "x", "dist/d.js": "x", "package.json": "{}", "target/t.java": "x", "env/bin/x": "x", "env/lib/e.py": "x", "venv/v.py": "x", "sub/pom.xml": "<p/>", "sub/target/deep/Out.java": "x", "other/.gitignore": "only.py\n", "other/only.py": "x", "other/in/only.py": "x",
    "other/in/yes.go": "x", "tests/t.py": "x", "mine/m.py": "x", "config/a.yml": "a: 1", "prisma/x.prisma": "model A {}",
}
STAY = {"a.py", "pkg/__init__.py", "pkg/_own.py", "kept/k.py", "target/t.java", "venv/v.py", "other/in/yes.go", "config/a.yml", "prisma/x.prisma"}


def test_what_is_left_out_is_never_opened(tmp_path):
    root, opened = put(tmp_path, FILES), []
    walker = tree.Walker(fs.LocalFileSystem(), ["mine/"], listed=lambda p: opened.append(p[len(root) + 1 :]))
    assert {p for p, _ in walker.files(tree.Folder("p", root))} == STAY
    assert len(opened) == len(set(opened)) + 2  # target and venv are opened to look for marks, and then as sources
    assert not [p for p in opened if p.startswith(("node_modules", ".git", "skip", "mine", "dist/", "env/", "sub/target"))]
    (tmp_path / "loop").symlink_to(tmp_path)
    assert {p for p, _ in walker.files(tree.Folder("p", root))} == STAY
    (tmp_path / ".gitignore").write_text("skip/\n*.gen.py\n!skip/much/s.py\n")  # a rule takes back, so the folder is opened
    assert {p for p, _ in walker.files(tree.Folder("p", root))} == STAY | {"skip/much/s.py"}


@pytest.mark.parametrize("parts", [1, 32])
def test_every_partitioning_finds_the_same(spark, tmp_path, monkeypatch, parts):
    root = put(tmp_path, FILES)
    monkeypatch.setattr(tree, "PARTS", parts)
    reader = tree.TreeReader({"path": root, "projects": "false", "ignore": '["mine/"]', "tests": "false", "max_file_bytes": "100", "max_total_bytes": "1000"})
    made = reader.partitions()
    rows = [r for p in made for b in reader.read(p) for r in b.to_pylist()]
    assert len(made) >= min(parts, 2) and len(rows) == len(STAY) and {r["path"] for r in rows} == STAY
    assert {r["path"]: bytes(r["content"]).decode() for r in rows} == {p: FILES[p] for p in STAY}


def test_index_of_a_tree_and_of_a_listing(spark, tmp_path):
    root = put(tmp_path / "one", FILES)
    put(tmp_path / "two", {"big.py": "x" * 300, "b.py": "x"})
    files, skipped = scan.index_files(spark, str(tmp_path), projects=True, ignore=["mine/"], max_file_bytes=200)
    assert {(r.project, r.path) for r in files.collect()} == {("one", p) for p in STAY} | {("two", "b.py")} and [(r.project, r.file) for r in skipped.collect()] == [("two", "big.py")]
    listed = scan._listed(spark, root, False, ["mine/"], False, 200, 100, 10_000)
    assert {r.path for r in listed.collect()} == {p for p in STAY if "/_" not in p}
    assert not tree.readable("nosuch://x/y") and tree.readable(root) and tree.readable("file://" + root) and not tree.readable(root + "/a.py")
    with pytest.raises(scan.BudgetExceeded):
        scan.index_files(spark, root, max_total_bytes=3)


def test_languages_by_path_are_those_of_columns(spark):
    paths = ["a.py", "b.TSX", "config/r.yaml", "x/config/y/r.yml", "r.yaml", "schema.prisma", "src/prisma/a.prisma", "x.prisma", "c.PyI", "noext", "d.7z", ".js", "e.rs"]
    got = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.l for r in got.select("path", scan.language(got.path).alias("l")).collect()} == {p: rules.language_of(p) for p in paths}
