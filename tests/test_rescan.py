from corvid.streaming import rescan
from tests.test_scan import put


def test_state_of_many_batches_stays_small(spark, tmp_path):
    root, seen = tmp_path / "src", []

    def go():
        rescan.watch(rescan.file_stream(spark, str(root), "*.py"), str(tmp_path / "known"), str(tmp_path / "state"), lambda d: seen.append({(r.path.rsplit("/", 1)[1], r.kind) for r in d.collect()}), compacted=2).awaitTermination()

    for k in range(7):
        put(root, {f"a{k}.py": str(k), f"b{k}.py": "x"})
        go()
    assert seen == [{(f"a{k}.py", "added"), (f"b{k}.py", "added")} for k in range(7)]
    held = {p.name for p in (tmp_path / "known").iterdir()}
    assert len(held) <= 6 and any(n.startswith("base=") for n in held)
    latest, batches, _ = rescan._state(spark, str(tmp_path / "known"), 7)
    assert latest.count() == 14 and batches <= 3
