"""The walk in rounds against the walk of the data source: same rows for any number of entries, lopsided trees over many tasks."""

import os
import random
import time

import pytest

from quarry.sources import frontier, localtree


def tree(root, seed, folders=60):
    rng = random.Random(seed)
    made = [root]
    for k in range(folders):
        at = rng.choice(made[-3:] if k % 2 else made) / rng.choice([f"d{k}", f"d{k}", f"e {k}", ".hidden", "vendor", "ärger"])
        at.mkdir(exist_ok=True)
        made.append(at)
        for name in rng.sample(["a.go", "b.md", "c.bin", "_d.py", "log.txt", ".e.rs"], 3):
            (at / name).write_text(f"{k} {name}")
        if rng.random() < 0.3:
            (at / ".gitignore").write_text(rng.choice(["*.md\n", "d*/\n", "log.txt\n!a.go\n", "/b.md\n"]))
    old = time.time() - 3600
    for folder, _, names in os.walk(root):
        for name in names:
            os.utime(os.path.join(folder, name), (old, old))
    return str(root)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("seed", "entries"), [(1, 1), (2, 9), (3, 100_000)])
def test_same_rows_as_the_data_source(spark, tmp_path, seed, entries):
    path = tree(tmp_path, seed, folders=12 if entries == 1 else 60)
    got = frontier.walk(spark, path, entries=entries)
    assert rows(got) == rows(localtree.scan(spark, path)) and got.schema == localtree.scan(spark, path).schema
    assert rows(frontier.walk(spark, path, ["e 3", "d1,d2"], entries=100_000)) == rows(localtree.scan(spark, path, [" e 3 ", "d1,d2"]))


def test_a_lopsided_tree_spreads_over_tasks(spark, tmp_path, monkeypatch):
    deep = tmp_path / "one"
    for k in range(120):
        (deep / f"f{k}").mkdir(parents=True)
        (deep / f"f{k}" / "a.md").write_text("x")
    seen = []
    real = frontier.written
    monkeypatch.setattr(frontier, "written", lambda df, what: seen.append(real(df.withColumn("task", frontier.F.spark_partition_id()), what)) or seen[-1].drop("task"))
    assert frontier.walk(spark, str(tmp_path), entries=20).count() == 120
    shares = [r["count"] for r in seen[1].where("folder IS NULL").groupBy("task").count().collect()]
    assert len(shares) >= 30 and max(shares) <= 10  # one folder above the root's holds them all, and yet no task lists more than a few


def test_roots_that_are_no_folders_and_empty_ones(spark, tmp_path):
    assert frontier.walk(spark, str(tmp_path)).collect() == []
    with pytest.raises(FileNotFoundError):
        frontier.walk(spark, str(tmp_path / "none"))
