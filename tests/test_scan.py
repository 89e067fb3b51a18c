"""The scan opens only what it has to, and reports all that it refuses."""

import json
import os

import pytest

from tracery.sources import files, scan


@pytest.fixture()
def tree(tmp_path):
    for path in ("src/a.rs", "src/deep/er/b.rs", "src/node_modules/x/y/z.js", "node_modules/p/q/r.js", ".git/objects/aa/bb", "docs/g.md", "docs/gen/deep/x.md", "target/debug/t", "top.txt", "srcs/c.rs"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(path)
    return tmp_path


def walked(tmp_path, filters=(), monkeypatch=None, **options):
    """(paths, opened folders) of a scan in this process."""
    opened, real = [], os.scandir
    monkeypatch.setattr(scan.os, "scandir", lambda p: opened.append(os.path.relpath(p, tmp_path)) or real(p))
    reader = scan.PushedScanReader({"path": str(tmp_path)} | {k: json.dumps(v) if isinstance(v, list) else v for k, v in options.items()})
    list(reader.pushFilters(list(filters)))
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    return sorted(r[0] for r in rows if r[4] is None), sorted(opened)


@pytest.mark.parametrize("parts", [1, 2, 256])
def test_pruned_folders_are_never_opened(tree, monkeypatch, parts):
    monkeypatch.setattr(scan, "PARTS", parts)
    paths, opened = walked(tree, monkeypatch=monkeypatch, excludes=["docs/gen/**", "*.txt"])
    assert paths == ["docs/g.md", "src/a.rs", "src/deep/er/b.rs", "srcs/c.rs"]
    assert opened == [".", "docs", "src", "src/deep", "src/deep/er", "srcs"]


def test_roots_and_filters_open_only_what_they_need(tree, monkeypatch):
    from pyspark.sql.datasource import EqualTo, In, StringStartsWith

    assert walked(tree, monkeypatch=monkeypatch, roots=["src/deep", "src/deep/er", "top.txt"]) == (["src/deep/er/b.rs", "top.txt"], ["src/deep", "src/deep/er"])
    assert walked(tree, [StringStartsWith(("path",), "src/d")], monkeypatch) == (["src/deep/er/b.rs"], [".", "src", "src/deep", "src/deep/er"])
    assert walked(tree, [EqualTo(("path",), "docs/g.md")], monkeypatch) == (["docs/g.md"], [".", "docs"])
    assert walked(tree, [In(("path",), ("docs/g.md", "src/a.rs")), StringStartsWith(("path",), "src/")], monkeypatch)[0] == ["src/a.rs"]


def test_links_and_unreadable_files_are_errors_all_at_once(spark, tree):
    os.symlink(tree / "docs", tree / "linked")
    os.symlink(tree / "top.txt", tree / "src/link.rs")
    os.symlink("nowhere", tree / "node_modules/gone")
    found = scan.scan(spark, str(tree))
    with pytest.raises(files.ScanError) as e:
        scan.without_errors(found)
    assert str(e.value).splitlines() == ["linked: links are refused", "src/link.rs: links are refused"]
    good = scan.without_errors(scan.scan(spark, f"file://{tree}", roots=["docs", "src/deep"]))
    assert sorted((r.path, r.length, r.content.decode()) for r in good.collect()) == [(p, len(p), p) for p in ("docs/g.md", "docs/gen/deep/x.md", "src/deep/er/b.rs")]
    assert [r.content for r in scan.scan(spark, str(tree), roots=["docs/g.md"], contents=False).collect()] == [None]


def test_filters_on_paths_are_pushed(spark, tree):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        found = scan.scan(spark, str(tree)).where("path like 'src/%' and error is null").select("path")
        assert sorted(r.path for r in found.collect()) == ["src/a.rs", "src/deep/er/b.rs"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_selected_files(spark, tree):
    rows = {r.path: (r.content and r.content.decode(), r.error) for r in scan.selected(spark, str(tree), ["src/a.rs", "top.txt", "src/none.rs"]).collect()}
    assert rows == {"src/a.rs": ("src/a.rs", None), "top.txt": ("top.txt", None), "src/none.rs": (None, "No such file or directory")}


def test_an_empty_folder(spark, tmp_path):
    assert scan.without_errors(scan.scan(spark, str(tmp_path))).count() == 0
