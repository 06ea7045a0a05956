"""Hints of a folder tree: what is entered, which folder is named, and that edits are seen as a scan sees them."""

import os
import random

from quarry.sources import localtree, watch


def _age(root):
    """Times long ago, as those of folders that nothing is at work in."""
    for at, _, _ in os.walk(root):
        os.utime(at, ns=(10**18, 10**18))


def _tree(root):
    for f in ("top.md", "a/one.go", "a/deep/two.go", "a/deep/er/three.go", "b/four.go", "b/gen/five.go", "node_modules/no.js"):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("x")
    _age(root)


def _step(w, at):
    before = w.entered
    rows, after = w.read(at)
    return [r[1] for r in rows], after, w.entered - before


def test_only_folders_that_moved_are_entered(tmp_path):
    _tree(tmp_path)
    w = watch.Watcher({"path": str(tmp_path)})
    found, at, entered = _step(w, w.initialOffset())
    assert found == [""] and entered == 6  # all but what is never entered
    assert _step(w, at) == ([], at, 0)
    (tmp_path / "a/deep/er/three.go").write_text("longer")  # in place: no folder's time moves
    found, at, entered = _step(w, at)
    assert found == ["a/deep/er"] and entered == 0
    (tmp_path / "a/deep/new.go").write_text("x")
    os.utime(tmp_path / "a/deep", ns=(10**18 + 1, 10**18 + 1))
    found, at, entered = _step(w, at)
    assert found == ["a/deep"] and entered == 1
    (tmp_path / "b/gen/deeper").mkdir()
    (tmp_path / "b/gen/deeper/six.go").write_text("x")
    for name in ("b/gen", "b/gen/deeper"):
        os.utime(tmp_path / name, ns=(10**18 + 2, 10**18 + 2))
    found, at, entered = _step(w, at)
    assert found == ["b/gen"] and entered == 2
    assert _step(w, at) == ([], at, 0)
    (tmp_path / "a/one.go").write_text("two")
    (tmp_path / "b/four.go").write_text("two")
    assert _step(w, at)[0] == [""]  # one hint for both, at the folder above them


def test_a_nested_ignore_file_gives_one_hint_and_enters_what_it_rules(tmp_path):
    _tree(tmp_path)
    w = watch.Watcher({"path": str(tmp_path)})
    _, at, _ = _step(w, w.initialOffset())
    (tmp_path / "b/.gitignore").write_text("gen/\n")
    found, at, entered = _step(w, at)
    assert found == ["b"] and entered == 1 and "gen" not in w.seen.below["b"].below
    _age(tmp_path)
    _, at, _ = _step(w, at)
    (tmp_path / "b/gen/five.go").write_text("unseen")
    assert _step(w, at)[0] == []
    (tmp_path / "b/.gitignore").write_text("# nothing\n")
    found, at, entered = _step(w, at)
    assert found == ["b"] and entered == 2 and _step(w, at)[0] == []


def test_a_root_that_goes_and_returns(tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    _tree(root)
    w = watch.Watcher({"path": str(root)})
    _, at, _ = _step(w, w.initialOffset())
    os.rename(root, tmp_path / "away")
    rows, gone = w.read(at)
    assert list(rows) == [(str(root), "", watch.GONE)] and list(w.read(gone)[0]) == []
    os.rename(tmp_path / "away", root)
    found, back, _ = _step(w, gone)
    assert found == [""] and back["digest"] == at["digest"]
    assert list(watch.Watcher({"path": str(root)}).read(back)[0]) == []  # a restart that finds what its offset says


def test_random_edits_give_a_hint_where_a_scan_differs(tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    _tree(root)
    dice, folders = random.Random(5), ["", "a", "a/deep", "b", "b/gen", "node_modules", ".hidden"]
    (root / ".hidden").mkdir()
    w = watch.Watcher({"path": str(root)})

    def scanned():
        reader = localtree.LocalTreeReader({"path": str(root), "now": "0"})
        return {(r[0], r[3]) for p in reader.partitions() for r in reader.read(p)}

    _, at, _ = _step(w, w.initialOffset())
    before = scanned()
    for n in range(60):
        f = root / dice.choice(folders) / dice.choice(["p.go", "q.md", "r.png"])
        if f.exists() and dice.random() < 0.4:
            f.unlink()
        else:
            f.write_text("x" * n)
        found, at, _ = _step(w, at)
        now = scanned()
        moved = {u for u, _ in now ^ before}
        assert bool(found) == bool(moved), (n, f)
        assert all(u.startswith(str(root / found[0])) for u in moved)
        before = now
