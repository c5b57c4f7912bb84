"""The status of every entry of a mounted tree; links and unreadable files become findings."""

import hashlib
import os

import pytest

from loamstack.model import MAX_SOURCE_BYTES
from loamstack.operators import lint
from loamstack.sources import tree
from loamstack.sources import workspace as W


def source(root, name, content=b"text", manifest=None):
    folder = root / "raw" / name
    folder.mkdir(parents=True)
    (folder / "source").write_bytes(content)
    found = hashlib.sha256(content).hexdigest()
    (folder / "manifest.yaml").write_text(manifest or f"scope: s\nadapter: a\nid: {name}\nversion: '1'\ndigest: {found}\nmedia_type: text/plain\n")
    return folder


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "tree"
    source(root, "ok")
    link = source(root, "linked")
    (link / "source").unlink()
    (link / "source").symlink_to(root / "raw" / "ok" / "source")
    pipe = source(root, "pipe")
    (pipe / "source").unlink()
    os.mkfifo(pipe / "source")
    blocked = source(root, "blocked")
    (blocked / "manifest.yaml").unlink()
    os.mkfifo(blocked / "manifest.yaml")
    with open(source(root, "large") / "source", "wb") as file:
        file.truncate(MAX_SOURCE_BYTES + 1)
    (root / "raw" / "outside").symlink_to("/")
    (root / "raw" / "lost").symlink_to(root / "nowhere")
    (root / "raw" / "deep" / "er").mkdir(parents=True)
    (root / "raw" / "deep" / "er" / "note.md").write_text("x")
    return root


def test_every_entry_has_a_status(spark, root):
    want = {
        "raw/ok/source": "read", "raw/ok/manifest.yaml": "read", "raw/linked/source": "symlink", "raw/linked/manifest.yaml": "read", "raw/pipe/source": "special", "raw/pipe/manifest.yaml": "read",
        "raw/blocked/source": "read", "raw/blocked/manifest.yaml": "special", "raw/large/source": "too_large", "raw/large/manifest.yaml": "read", "raw/outside": "symlink", "raw/lost": "symlink", "raw/deep/er/note.md": "read",
    }
    for tasks in (1, 3, 1000):  # one task for all, some folders opened, a task for each folder
        rows = tree.entries(spark, str(root), "raw", tasks=tasks).collect()
        assert len(rows) == len(want) and {r.path: r.status for r in rows} == want
        own = {r.path: r for r in rows}
        assert bytes(own["raw/ok/source"].content) == b"text" and own["raw/ok/source"].length == 4 and own["raw/ok/source"].modified
        assert own["raw/large/source"].content is None and own["raw/large/source"].length == MAX_SOURCE_BYTES + 1
    assert tree.entries(spark, str(root), "none").count() == 0
    assert [tuple(r)[:2] for r in tree.entries(spark, str(root), "raw/outside").collect()] == [("raw/outside", "symlink")]


def test_raw_findings_of_a_tree(spark, root):
    records = W.raw_records(spark, str(root), "s", tree.entries(spark, str(root), "raw"))
    assert {r.path.removeprefix("raw/"): r.error_class for r in records.collect()} == {
        "ok": None, "linked": "symlink", "pipe": "source_unreadable", "blocked": "manifest_unreadable", "large": "source_too_large", "outside": "symlink", "lost": "symlink",
    }
    codes = sorted(r.code for r in lint.raw_findings(records).collect())
    assert codes == ["raw.manifest_unreadable", "raw.source_too_large", "raw.source_unreadable", "raw.symlink", "raw.symlink", "raw.symlink"]


def test_a_read_that_fails_is_a_row(root, monkeypatch):
    options = {"path": str(root), "folder": "raw/ok", "max_bytes": "1000"}
    reader = tree._source(4)(options).reader(None)

    def refuse(path, *_):
        raise PermissionError(path)

    real = os.open
    monkeypatch.setattr(os, "open", lambda path, flags: real(path, flags) if flags & os.O_DIRECTORY else refuse(path))
    assert [r for b in reader.read(reader.partitions()[0]) for r in b.column("status").to_pylist()] == ["unreadable", "unreadable"]
    monkeypatch.setattr(os, "open", refuse)
    assert [r for p in reader.partitions() for b in reader.read(p) for r in b.column("path").to_pylist()] == ["raw/ok"]
