"""Findings of larger runs: a tree is walked, read and written by tasks, with the results of Spark's reader."""

import os

import pytest

from corpusmill.sources import readers


def found(files):
    return sorted((r.path, r.language, r.hash, r.mtime, r.length, r.text) for r in files.collect())


def test_a_tree_of_many_folders_is_walked_when_it_is_read(spark, tmp_path):
    """Spark's listing takes a task for each folder before anything is read, and holds every file on the driver."""
    for n in range(60):
        (tmp_path / f"d{n % 40}" / f"e{n}").mkdir(parents=True)
        (tmp_path / f"d{n % 40}" / f"e{n}" / "x.md").write_text(f"# {n}\n")
    spark.sparkContext.setJobGroup("walk", "walk")
    files = readers.read_tree(spark, str(tmp_path))
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("walk")) == []
    assert sorted(r.path for r in files.collect()) == sorted(f"d{n % 40}/e{n}/x.md" for n in range(60))


def test_walk_finds_what_sparks_reader_finds(spark, tmp_path, monkeypatch):
    names = ["a.md", "sp ace/b c.txt", "pl+us.md", "per%41cent.md", "ü/é.md", "q?u[o]te's.md", ".hidden.md", ".h/x.md", "_x.md", "_d/x.md", "_k=1/x.md", "k=_1/_y=2.md", "_metadata/x.md", "_metadata.md", "x._COPYING_", "empty.md", "b/c/d/e/f/g.py", "no/README", "n.bin", "out/e.md", "b/out/f.md"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty.md" else f"{name}\n")
    for n in range(70):
        (tmp_path / f"w{n % 35}").mkdir(exist_ok=True)
        (tmp_path / f"w{n % 35}" / f"{n}.md").write_text("x" * (n + 1))
    (tmp_path / "w0" / "nul.md").write_bytes(b"a\0b")
    os.symlink(tmp_path / "b", tmp_path / "linked")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken.md")
    rules = spark.createDataFrame([("", "out/", 0), ("b", "!out/", 1), ("", "w1*/", 2), ("", "!w1*/1*.md", 3)], "dir string, line string, at long")
    for rule in (None, rules):
        with monkeypatch.context() as m:
            m.setattr(readers, "local_folder", lambda *_: None)
            want = found(readers.read_tree(spark, str(tmp_path), rules=rule))
        assert len(want) > 40
        for walks, widest in ((32, 10_000), (1, 10_000), (1000, 10_000), (32, 3)):
            monkeypatch.setattr(readers, "WALKS", walks)
            monkeypatch.setattr(readers, "WIDEST", widest)
            assert found(readers.read_tree(spark, str(tmp_path), rules=rule)) == want
            assert found(readers.read_tree(spark, f"file://{tmp_path}/", rules=rule)) == want


def test_walk_of_nothing_and_of_a_circle(spark, tmp_path):
    assert readers.read_tree(spark, str(tmp_path)).collect() == []
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("x")
    os.symlink(tmp_path / "a", tmp_path / "a" / "again")
    paths = [r.path for r in readers.read_tree(spark, str(tmp_path)).collect()]
    assert "a/x.md" in paths and set(paths) == {"a/" + "again/" * n + "x.md" for n in range(len(paths))}


def test_names_that_are_not_utf8_are_read(spark, tmp_path, monkeypatch):
    """Spark's reader leaves them out."""
    folder = os.path.join(os.fsencode(tmp_path), b"d\xff")
    os.mkdir(folder)
    for name in (b"x.md", b"\xe9.md"):
        with open(os.path.join(folder, name), "wb") as file:
            file.write(b"text")
    for walks in (1, 32):
        monkeypatch.setattr(readers, "WALKS", walks)
        assert sorted((r.path, r.length) for r in readers.read_tree(spark, str(tmp_path)).collect()) == [("d\ufffd/x.md", 4), ("d\ufffd/\ufffd.md", 4)]


def test_long_files_are_read_in_short_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "HELD_BYTES", 10)
    monkeypatch.setattr(readers, "HELD_ROWS", 2)
    for n in range(20):
        (tmp_path / f"{n}.md").write_text("y" * n)
    assert {(r.path, r.length, r.text) for r in readers.read_tree(spark, str(tmp_path)).collect()} == {(f"{n}.md", n, "y" * n) for n in range(1, 20)}


def test_write_tree(spark, tmp_path):
    rows = {"a/b=1/x.md": "# T\r\n\nü", "y.md": "y", "a/z.md": "z"}
    files = spark.createDataFrame(list(rows.items()), "path string, text string")
    for _ in range(2):
        assert readers.write_tree(files, f"{tmp_path}/t") == 3
        assert {os.path.relpath(os.path.join(d, f), tmp_path / "t") for d, _, names in os.walk(tmp_path / "t") for f in names} == set(rows)
    assert {r.path: r.text for r in readers.read_tree(spark, f"{tmp_path}/t").collect()} == rows
    assert readers.write_tree(files.limit(0), f"{tmp_path}/none") == 0
    for path in ("../x.md", "a/../../x.md", "/x.md", ""):
        with pytest.raises(Exception, match="not below the folder"):
            readers.write_tree(spark.createDataFrame([(path, "x")], "path string, text string"), f"{tmp_path}/t")
