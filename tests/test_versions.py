"""Versions of tables by path: edits, removals, failures, runs that break, two writers, the stream of notices."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusgraph.sources import elements, manifest, parse, versions
from corpusgraph.streaming import refresh


def names(spark, cache):
    return sorted(r["name"] for r in elements.read_current(spark, cache).collect())


def test_cache_forgets_edited_and_removed_elements(spark, tmp_path):
    src, cache = tmp_path / "src", str(tmp_path / "cache")
    src.mkdir()
    (src / "a.py").write_text("def f(): pass\ndef g(): pass\n")
    (src / "b.py").write_text("def h(): pass\n")
    assert elements.read_current(spark, cache).count() == 0
    assert elements.analyse(spark, str(src), cache)["elements"] == 3
    (src / "a.py").write_text("def f(): return 1\n")
    (src / "b.py").unlink()
    (src / "c.py").write_text("def bad(:\n")
    assert elements.analyse(spark, str(src), cache) == {"files": 2, "failed": 1, "elements": 1}
    got = elements.read_current(spark, cache).collect()
    assert [(r["name"], "return 1" in r["code"]) for r in got] == [("a.f", True)]
    assert {(r["key"], r["state"]) for r in elements.read_progress(spark, cache).collect()} == {("a.py", "done"), ("b.py", "removed"), ("c.py", "failed")}
    (src / "b.py").write_text("def h(): pass\n")
    elements.analyse(spark, str(src), cache)
    assert names(spark, cache) == ["a.f", "b.h"]


@pytest.mark.parametrize("step", ["rows", "log", "commit"])
def test_a_run_that_breaks_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    src, cache = tmp_path / "src", str(tmp_path / "cache")
    src.mkdir()
    (src / "a.py").write_text("def f(): pass\n")
    elements.analyse(spark, str(src), cache)
    (src / "a.py").write_text("def g(): pass\n")

    def broken(*a, **k):
        if step == "commit":  # half a commit file
            Path(cache, "commits", f"{2:012d}.json").write_text('{"batch": "000000000002-')
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(*{"rows": (elements, "write_cache"), "log": (versions, "commit"), "commit": (versions, "put")}[step], broken)
        with pytest.raises(OSError, match="lost"):
            elements.analyse(spark, str(src), cache)
    assert names(spark, cache) == ["a.f"]
    assert elements.analyse(spark, str(src), cache)["elements"] == 1
    assert names(spark, cache) == ["a.g"] and elements.analyse(spark, str(src), cache)["files"] == 0


def test_manifest_survives_a_broken_write(spark, tmp_path):
    at = str(tmp_path / "m")
    one = manifest.Manifest(spark.createDataFrame([("a", 1, "x")], "path string, mtime long, sha256 string"), 1, "8:cosine")
    manifest.write(spark, at, one)
    Path(at, "commits", f"{2:012d}.json").write_text("")
    assert manifest.read(spark, at).signature == "8:cosine" and manifest.read(spark, at).files.count() == 1
    manifest.write(spark, at, manifest.Manifest(one.files.limit(0), 1, "9:cosine"))
    assert manifest.read(spark, at).signature == "9:cosine" and manifest.read(spark, at).files.count() == 0


def test_two_writers(spark, tmp_path):
    versions.put(spark, str(tmp_path), 1, {"batch": "x"})
    with pytest.raises(versions.Conflict):
        versions.put(spark, str(tmp_path), 1, {"batch": "y"})
    commits, top = versions.history(spark, str(tmp_path))
    assert [c.body for c in commits] == [{"batch": "x"}] and top == 1


def table_of(spark, rows):
    return spark.createDataFrame(rows, "path string, sha256 string, value int")


def test_rows_by_version(spark, tmp_path):
    root = str(tmp_path / "t")

    def build(todo):
        v = F.col("value")
        return todo.select("path", F.explode(F.array(v, v + 100)).alias("value"), F.when(v < 0, "negative").alias("error"))

    steps = [[("a", "1", 1), ("b", "1", 2), ("c", "1", -3)], [("a", "2", 5), ("c", "1", -3), ("d", "1", 7)], [("a", "2", 5), ("c", "9", 4), ("d", "2", -8)]]
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, root)
    for rows in steps:
        assert versions.refresh(spark, root, table_of(spark, rows), build) is not None
    last = [r for r in steps[-1] if r[2] >= 0]
    assert versions.refresh(spark, root, table_of(spark, last), build) is not None  # the failed one is removed
    assert versions.refresh(spark, root, table_of(spark, last), build) is None
    state = lambda n=None: sorted((r["path"], r["value"]) for r in versions.read(spark, root, n).collect())
    want = [sorted((p, v + k) for p, _, v in rows if v >= 0 for k in (0, 100)) for rows in steps]
    assert [state(1), state(2), state(3), state()] == [*want, want[2]]
    assert versions.errors(spark, root).count() == 0
    assert versions.compact(spark, root).number == 5 and state() == want[2]
    assert len(versions.history(spark, root)[0]) == 1
    assert versions.refresh(spark, root, table_of(spark, last), build) is None
    versions.refresh(spark, root, table_of(spark, [("a", "3", -1)]), build)
    assert state() == [] and [r["path"] for r in versions.errors(spark, root).collect()] == ["a"]


def test_stream_of_notices(spark, tmp_path):
    src, cache, told = tmp_path / "src", str(tmp_path / "cache"), tmp_path / "notices"
    (src / "pkg").mkdir(parents=True)
    told.mkdir()
    turn = iter(range(100))

    def run(*paths):
        if paths:
            (told / f"{next(turn)}.json").write_text("\n".join(json.dumps({"path": p} if p else {}) for p in paths))
        refresh.follow(spark, str(src), cache, str(told), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)

    (src / "pkg" / "a.py").write_text("def f(): pass\n")
    (src / "b.py").write_text("def g(): pass\n")
    run(None)
    assert names(spark, cache) == ["b.g", "pkg.a.f"]
    ids = {r["id"] for r in parse.parse_files(elements.scan_tree(spark, str(src))).collect()}
    assert {r["id"] for r in elements.read_current(spark, cache).collect()} == ids
    (src / "pkg" / "a.py").write_text("def f2(): pass\n")  # an edit, which a file stream would never see
    (src / "c.py").write_text("def not_told(): pass\n")
    run("pkg/a.py")
    assert names(spark, cache) == ["b.g", "pkg.a.f2"]
    (src / "b.py").unlink()
    (src / "pkg" / "a.py").write_text("def f2(:\n")
    run("b.py", "pkg/a.py", "never/was.py")
    assert names(spark, cache) == []
    assert {(r["key"], r["state"]) for r in elements.read_progress(spark, cache).collect()} == {("b.py", "removed"), ("pkg/a.py", "failed")}
    before = versions.history(spark, cache)[1]
    run()  # a restart without notices
    assert versions.history(spark, cache)[1] == before
    (src / "pkg" / "a.py").write_text("def f3(): pass\n")
    run(None)
    assert names(spark, cache) == ["c.not_told", "pkg.a.f3"]


def test_watch_keeps_names_and_errors(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "a.py").write_text("def f(): pass\n")
    (src / "b.py").write_text("def g(:\n")
    refresh.watch(spark, str(src), out, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["name"], r["file_path"]) for r in spark.read.parquet(out).collect()] == [("a.f", "a.py")]
    assert [r["file_path"] for r in spark.read.parquet(out + "-errors").collect()] == ["b.py"]
