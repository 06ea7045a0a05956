"""Scans into an index: new, touched, changed, vanished and failing documents."""

import os

import pytest

from quarry.jobs import ingest, store
from quarry.operators import search


def test_index_follows_the_folder(spark, tmp_path):
    root, index = tmp_path / "src", f"file://{tmp_path}/index"
    root.mkdir()
    old = (10**18, 10**18)

    def put(name, body, at=old):
        (root / name).write_text(body)
        os.utime(root / name, ns=at)

    put("a.md", "---\nt: 1\n---\nalpha beta gamma")
    put("b.txt", "delta " * 500)
    put("c.txt", "")
    assert ingest.ingest(spark, str(root), index, "s1") == {"ingested": 3, "unchanged": 0, "removed": 0, "failed": 0}
    chunks = store.read_parts(spark, f"{index}/chunks", ingest.CHUNKS)
    assert {(r["uri"][-5:], r["chunk_index"], r["start_line"]) for r in chunks.collect()} == {("/a.md", 0, 4), ("b.txt", 0, 1), ("b.txt", 1, 1), ("b.txt", 2, 1)}
    assert ingest.ingest(spark, str(root), index, "s1") == {"ingested": 0, "unchanged": 3, "removed": 0, "failed": 0}
    put("a.md", "---\nt: 1\n---\nalpha beta gamma", (2 * 10**18 // 2 + 5, 10**18 + 5))  # touched, same bytes
    put("b.txt", "delta epsilon", (10**18 + 9, 10**18 + 9))
    (root / "c.txt").unlink()
    assert ingest.ingest(spark, str(root), index, "s1") == {"ingested": 1, "unchanged": 1, "removed": 1, "failed": 0}
    chunks = store.read_parts(spark, f"{index}/chunks", ingest.CHUNKS)
    assert chunks.count() == 2
    asked = chunks.where("uri LIKE '%b.txt'").first()
    best = search.search(chunks, list(asked["embedding"]), 1, 1, document="document_id", tie="point_id").first()
    assert best["point_id"] == asked["point_id"]
    assert tuple(ingest.stats(spark, index).first()) == (1, 2, 2, 0)
    put("d.txt", "too large", (10**18 + 1, 10**18 + 1))
    for attempt in (1, 2):
        assert ingest.ingest(spark, str(root), index, "s1", most_bytes=5)["failed"] == 1
        assert [r["attempts"] for r in store.read_parts(spark, f"{index}/failures", ingest.FAILURES).collect()] == [attempt]
    with pytest.raises(ValueError):
        store.check_manifest(spark, index, "other", 384)


def test_uncommitted_generations_are_not_read(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    store.publish(spark.createDataFrame([(1,)], "n int"), table)
    (tmp_path / "t/gen=00000002").mkdir()
    assert store.current(spark, table, "n int").count() == 1
    assert store.publish(spark.createDataFrame([(2,), (3,)], "n int"), table) == 2
    assert store.current(spark, table, "n int").count() == 2


def test_only_touched_parts_are_written(spark, tmp_path):
    root, index = tmp_path / "src", f"file://{tmp_path}/index"
    root.mkdir()
    for n in range(12):
        (root / f"f{n}.md").write_text(f"# One\n\nword{n}\n")
        os.utime(root / f"f{n}.md", ns=(10**18, 10**18))
    ingest.ingest(spark, str(root), index, "s1")
    ingest.ingest(spark, str(root), index, "s 2/x")
    generations = lambda: {n: sorted(p.name for p in (tmp_path / "index" / n).glob("gen=*") if (p / "_COMMITTED").exists()) for n in ("chunks", "documents")}
    before = generations()
    assert ingest.ingest(spark, str(root), index, "s1")["unchanged"] == 12 and generations() == before
    (root / "f3.md").write_text("changed words\n")
    os.utime(root / "f3.md", ns=(10**18 + 1, 10**18 + 1))
    assert ingest.ingest(spark, str(root), index, "s1")["ingested"] == 1
    newest = tmp_path / "index/chunks" / generations()["chunks"][-1]
    assert len(list(newest.glob("source_id=*/bucket=*"))) == 1
    chunks = store.read_parts(spark, f"{index}/chunks", ingest.CHUNKS)
    assert chunks.count() == 24 and chunks.where("text LIKE '%changed%'").count() == 1
    assert all("source_id=s1" in f for f in store.read_parts(spark, f"{index}/chunks", ingest.CHUNKS, "s1").inputFiles())
    got = ingest.ingest(spark, str(root), index, "s1", most_chunks=0)
    assert got == {"ingested": 0, "unchanged": 12, "removed": 0, "failed": 0}  # nothing was read
    (root / "f3.md").write_text("changed again\n")
    os.utime(root / "f3.md", ns=(10**18 + 2, 10**18 + 2))
    assert ingest.ingest(spark, str(root), index, "s1", most_chunks=0)["failed"] == 1
    failure = store.read_parts(spark, f"{index}/failures", ingest.FAILURES).first()
    assert failure["stage"] == "RESOURCE_LIMIT" and chunks.where("text LIKE '%changed words%'").count() == 1  # what was there stays
    (root / "f3.md").unlink()
    ingest.ingest(spark, str(root), index, "s1")
    assert store.read_parts(spark, f"{index}/failures", ingest.FAILURES).count() == 0
    ingest.delete_source(spark, index, "s 2/x")
    assert tuple(ingest.stats(spark, index).first()) == (1, 11, 11, 0)
    assert {r["source_id"] for r in store.read_parts(spark, f"{index}/chunks", ingest.CHUNKS).select("source_id").distinct().collect()} == {"s1"}


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    store.publish(spark.createDataFrame([(1,)], "n int"), table)
    store._claim(spark, store._folder(table, 2))
    with pytest.raises(RuntimeError):
        store.publish(spark.createDataFrame([(2,)], "n int"), table)
    assert store.current(spark, table, "n int").first()["n"] == 1


def _put(root, name, body, ns=10**18):
    (root / name).write_text(body)
    os.utime(root / name, ns=(ns, ns))


def test_documents_whose_chunks_cannot_be_stored_are_failures(spark, tmp_path, monkeypatch):
    root, index = tmp_path / "src", f"file://{tmp_path}/index"
    root.mkdir()
    _put(root, "a.md", "alpha")
    _put(root, "b.txt", "beta")
    assert ingest.ingest(spark, str(root), index, "s1")["ingested"] == 2
    _put(root, "a.md", "alpha two", 10**18 + 1)
    (root / "b.txt").unlink()
    whole = store._write_generation

    def breaks(df, folder, touched):
        if "/chunks/" in folder:
            raise OSError("disk full\nmore")
        whole(df, folder, touched)

    monkeypatch.setattr(store, "_write_generation", breaks)
    for attempt in (1, 2):
        assert ingest.ingest(spark, str(root), index, "s1") == {"ingested": 0, "unchanged": 0, "removed": 0, "failed": 1}
        failure = store.read_parts(spark, f"{index}/failures", ingest.FAILURES).first()
        assert (failure["stage"], failure["error"], failure["attempts"]) == ("STORE", "disk full", attempt)
    held = lambda n, s: sorted(r["uri"][-5:] for r in store.read_parts(spark, f"{index}/{n}", s).collect())
    assert held("documents", ingest.DOCUMENTS) == held("chunks", ingest.CHUNKS) == ["/a.md", "b.txt"]
    monkeypatch.setattr(store, "_write_generation", whole)
    assert ingest.ingest(spark, str(root), index, "s1") == {"ingested": 1, "unchanged": 0, "removed": 1, "failed": 0}
    assert held("failures", ingest.FAILURES) == [] and held("documents", ingest.DOCUMENTS) == ["/a.md"]


@pytest.mark.parametrize("table", ["documents", "failures"])
def test_a_run_that_breaks_is_made_good_by_the_next(spark, tmp_path, monkeypatch, table):
    root, index = tmp_path / "src", f"file://{tmp_path}/index"
    root.mkdir()
    _put(root, "a.md", "alpha")
    _put(root, "c.txt", "far too long")
    whole = store._write_generation

    def breaks(df, folder, touched):
        if f"/{table}/" in folder:
            raise OSError("gone")
        whole(df, folder, touched)

    monkeypatch.setattr(store, "_write_generation", breaks)
    with pytest.raises(OSError):
        ingest.ingest(spark, str(root), index, "s1", most_bytes=6)
    assert list((tmp_path / "index/incoming").iterdir()) == []
    (tmp_path / "index/incoming/old").mkdir()
    os.utime(tmp_path / "index/incoming/old", (1, 1))
    monkeypatch.setattr(store, "_write_generation", whole)
    got = ingest.ingest(spark, str(root), index, "s1", most_bytes=6)
    assert got["failed"] == 1 and got["ingested"] + got["unchanged"] == 1
    assert store.read_parts(spark, f"{index}/chunks", ingest.CHUNKS).count() == store.read_parts(spark, f"{index}/documents", ingest.DOCUMENTS).count() == 1
    assert store.read_parts(spark, f"{index}/failures", ingest.FAILURES).count() == 1 and list((tmp_path / "index/incoming").iterdir()) == []


def test_parsers_and_chunkers_are_extension_points(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from quarry.functions import text
    from quarry.operators import table_functions

    root, index = tmp_path / "src", f"file://{tmp_path}/index"
    root.mkdir()
    _put(root, "a.yaml", "one\ntwo")
    monkeypatch.setitem(text.PARSERS, "text/yaml", lambda c: (F.upper(c.cast("string")), F.lit(7)))
    monkeypatch.setitem(table_functions.CHUNKERS, "lines", lambda body, language, line: (table_functions.Chunk(t, line + n, line + n) for n, t in enumerate(body.split("\n"))))
    assert ingest.ingest(spark, str(root), index, "s1", chunker="lines")["ingested"] == 1
    rows = store.read_parts(spark, f"{index}/chunks", ingest.CHUNKS).orderBy("chunk_index").collect()
    assert [(r["text"], r["start_line"]) for r in rows] == [("ONE", 7), ("TWO", 8)]


def test_errors_say_whose_fault_it_is(spark, tmp_path):
    from quarry import errors

    index = f"file://{tmp_path}/index"
    with pytest.raises(errors.InvalidArgument):
        search.check_request(0, 2)
    with pytest.raises(errors.NotFound):
        ingest.ingest(spark, str(tmp_path), index, "s1", model="none")
    store._claim(spark, store._folder(f"{index}/t", 1))
    with pytest.raises(errors.Conflict):
        store.publish(spark.range(1), f"{index}/t")
    assert issubclass(errors.Conflict, RuntimeError) and issubclass(errors.NotFound, LookupError)
