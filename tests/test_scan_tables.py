import json
import threading

import pytest
from pyspark.sql import functions as F

from corvid.operators import diff, score, variants
from corvid.plans import progress, review
from corvid.plans import scan as plans
from corvid.sources.scan import index_files
from tests.test_packs import PROJECTS
from tests.test_scan import put


def test_files_in_locale_order(spark, tmp_path):
    names = ["_z.py", "b.py", "B.py", "a.py", "A.py", "é.py", "f.py", "e.py", "a-1.py", "A1.py", "10.py"]
    files, _ = index_files(spark, put(tmp_path, {n: "x" for n in names}))
    assert [r.path for r in files.orderBy("ordinal").collect()] == ["_z.py", "10.py", "a-1.py", "a.py", "A.py", "A1.py", "b.py", "B.py", "e.py", "é.py", "f.py"]


def test_scan_tells_contexts_components_and_snapshots(spark, tmp_path):
    for name in ("fastapi", "express"):
        put(tmp_path / "src" / name, PROJECTS[name][0])
    told = []
    found = plans.scan_project(spark, str(tmp_path / "src"), projects=True, on_progress=lambda phase, detail: told.append((phase, detail)))
    assert [p for p, _ in told if p != "routes-discovered"] == ["index", "extract", "done"] and found.unresolved.filter("reason = 'extraction-failed'").count() == 0
    routes = [json.loads(d) for p, d in told if p == "routes-discovered"]
    assert {r["framework"] for r in routes} == {"fastapi", "express"} and sum(r["routes"] for r in routes) >= found.operations.count()
    assert {r.project: r.frameworks for r in found.frameworks().collect()} == {"fastapi": ["fastapi"], "express": ["express"]}
    assert {"Thing"} <= {r.name for r in found.unknown_components().collect()}
    contexts = {(r.project, r.route): r.asDict(True) for r in found.contexts().collect()}
    gaps = found.operations.filter(F.size("gaps") > 0).collect()
    assert set(contexts) == {(r.project, f"{r.method.upper()} {r.path}") for r in gaps} and all(c["files"] for c in contexts.values())
    one = json.loads(gaps[0].candidate)
    asked = review.gap_reviews([one], {}, contexts={k[1]: v for k, v in contexts.items() if k[0] == gaps[0].project})
    assert asked[0]["sources"][0]["source"] in PROJECTS[gaps[0].project][0][asked[0]["sources"][0]["path"]] and asked[0]["sources"][0]["path"] in review.prompt(asked[0])
    assert review.gap_reviews([{**one, "gaps": []}], {}) == [] and len(review.gap_reviews([{**one, "gaps": []}], {}, routes=[f"{one['method']} {one['full_path']}"])) == 1
    plans.write_snapshot(found, str(tmp_path / "snapshot"))
    files, kept = plans.read_snapshot(spark, str(tmp_path / "snapshot"))
    assert files.count() == found.files.count() and diff.snapshot_diff(*(x.filter("project = 'fastapi'") for x in (kept, plans.routes_snapshot(found))), "key", "fingerprint").count() == 0
    folder = found.files.inputFiles()[0]
    found.close()
    assert not spark._jvm.java.io.File(folder.replace("file://", "")).exists()


def test_events_come_while_a_job_runs(spark):
    told, first = [], threading.Event()

    def tell(phase, detail):
        told.append((phase, json.loads(detail) if detail.startswith("{") else detail))
        first.set()

    with progress.Progress(spark, tell) as p:
        counts = p.counts

        def run(batches):
            import time

            for batch in batches:
                for k in batch.column(0).to_pylist():
                    time.sleep(0.01 if k < 4 else 2)
                    counts.add({"x": 30} if k < 4 else {"!y": 1})
                yield batch

        job = threading.Thread(target=lambda: spark.range(8).repartition(8).mapInArrow(run, "id long").collect())
        job.start()
        assert first.wait(60) and job.is_alive()
        job.join()
    assert [d for p, d in told if p == "pack-failed"] == ["y"] * 4 and sum(d["routes"] for p, d in told if p == "routes-discovered") == 120
    assert all(d["routes"] <= 40 for p, d in told if p == "routes-discovered")
    with pytest.raises(ZeroDivisionError), progress.Progress(spark, lambda *_: 1 / 0) as p:
        p.counts.add({"x": 41})
        import time

        time.sleep(0.5)


def test_audit_counts_every_axis(spark):
    schema = "k int, facet string, at string, value string"
    wanted = [(k, "route", None, None) for k in range(10)] + [(k, "request", "a", "string") for k in range(4)] + [(k, "response", "b", "int") for k in range(4)] + [(1, "constraint", "a/min", "3")]
    found = [(k, "route", None, None) for k in range(9)] + [(20, "route", None, None)] + [(0, "request", "a", "string"), (1, "request", "a", "int"), (2, "request", "a", None)] + [(k, "response", "b", "int") for k in range(4)] + [(5, "response", "z", "x")]
    r = score.audit(spark.createDataFrame(found, schema), spark.createDataFrame(wanted, schema), ["k"]).first()
    assert (r.routes, r.matched, r.scanned, r.recall, r.precision) == (10, 9, 10, 0.9, 0.9)
    assert (r.request_completeness, r.response_completeness, r.parameter_completeness, r.constraint_accuracy, r.unresolved, r.overall, r.accepted) == (0.25, 1.0, 0.0, 0.0, 0.25, 0.25, False)
    own = spark.createDataFrame(wanted, schema)
    assert score.audit(own, own, ["k"]).first().accepted and not score.audit(own.limit(0), own.limit(0), ["k"]).first().accepted


def test_rows_of_tables_without_schema(spark):
    writes = spark.createDataFrame([("t", "a", '{"type":"string"}', False), ("t", "a", '{"type":"string"}', False), ("t", 'b"q', '{"type":"string"}', False), ("t", 'b"q', None, False), ("u", "c", '{"type":"integer"}', False), ("u", None, None, True), ("v", None, None, False)], "table string, column string, type string, whole boolean")
    got = {r.table: json.loads(r.schema) for r in variants.table_rows(writes).collect()}
    assert got == {"t": {"type": "object", "properties": {"a": {"type": "string"}, 'b"q': {}}}, "u": {"type": "object", "properties": {"c": {"type": "integer"}}, "additionalProperties": {}}, "v": {"type": "object", "additionalProperties": {}}}


def test_sets_of_snapshots(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,), (2,)], "k int")
    assert [r.k for r in diff.shared(a, b, "k").collect()] == [2]
    changes = spark.createDataFrame([("b", "added"), ("B", "added"), ("a", "removed")], "k string, kind string")
    assert {r.kind: r["keys"] for r in diff.listed(changes, "k").collect()} == {"added": ["B", "b"], "removed": ["a"]}
