"""Golden cases of paths, headers, requests, models, sources, watching and the catalog."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import catalog, embedding, events, reconcile, search
from quarry.sources import localtree, watch


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(("path", "want"), [("/a//b/", "/a/b"), ("/", "/"), ("//", "/"), ("/a/./b/../c", "/a/c"), ("/../a", "/a"), ("a/..", "."), ("../a/b", "../a/b"), ("a/../../b", "../b"), ("", "."), ("/repo/", "/repo")])
def test_clean_path(spark, path, want):
    assert one(spark, path, text.clean_path) == want == os.path.normpath(path).replace("//", "/")


def test_nesting_with_the_root_and_trailing_slashes(spark):
    rows = [(1, "/"), (2, "/repo"), (3, "/repo/x"), (4, "/repo/"), (5, "/repo/xy"), (6, "/")]
    got = {r["id"]: (r["other"], r["relation"]) for r in reconcile.nesting(spark.createDataFrame(rows, "id int, uri string")).collect()}
    assert got == {2: (1, "inside"), 3: (1, "inside"), 4: (1, "inside"), 5: (1, "inside"), 6: (1, "equal")}


def test_conflicts_take_the_first_registered(spark):
    registered = spark.createDataFrame([("a", "/work/repo", 1), ("b", "/work/other/", 2), ("c", "/work/repo/sub", 3), ("d", "s3://x", 0)], "id string, uri string, created_at int")
    asked = spark.createDataFrame([("/work/repo",), ("/work/repo/",), ("/work/repo/sub/deep",), ("/work",), ("/work/rep",), ("/work/other",), ("/work/repo/sub",), ("s3://x/y",), ("/",)], "uri string")
    got = {r["uri"]: (r["id"], r["relation"]) for r in reconcile.conflicts(asked, registered).collect()}
    assert got == {"/work/repo/sub/deep": ("a", "inside"), "/work": ("a", "contains"), "/work/repo/sub": ("a", "inside"), "/": ("a", "contains")}


def test_headers_of_any_length(spark):
    long, body = "---\n" + "key: value\n" * 20_000, lambda c: text.front_matter(c)[0]
    assert one(spark, long + "---\nrest", body) == "rest"
    assert one(spark, long + "rest", body) == long + "rest"
    assert one(spark, "---\na\n---  \nrest", body) == "rest"
    assert one(spark, "---\na\n--- x\n---", body) == ""


def test_zero_vectors_score_zero(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 2.0]), (4, None)], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], round(r["score"], 6)) for r in search.nearest(v.where("vec_id < 4"), [1.0, 0.0], 3).collect()] == [(2, 1.0), (3, 0.707107), (1, 0.0)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in search.nearest_each(v, v, 2).collect())
    assert got == [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (2, 1, 2, 1.0), (2, 2, 3, 0.707107), (3, 1, 3, 1.0), (3, 2, 2, 0.707107)]
    assert search.nearest_each(v, v.limit(0), 2).count() == 0


def test_nearest_each_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (700, 4)).astype(float)  # many ties
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    for most in (2048, 9):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in search.nearest_each(v, v.where("vec_id % 50 = 0"), 6, most_queries=most).collect()}
        for q in range(0, 700, 50):
            scores = unit @ unit[q]
            assert np.allclose([got[q, k + 1][1] for k in range(6)], np.sort(scores)[::-1][:6])


def test_requests():
    assert search.parse_request({"q": "x"}) == {"query": "x", "limit": 10, "per_file": 2, "source": None, "exclude_tests": False}
    assert search.parse_request({"q": "x", "limit": "100", "per_file": "0", "source": "s", "exclude_tests": "true"})["exclude_tests"]
    assert not search.parse_request({"q": "x", "exclude_tests": "True"})["exclude_tests"]
    for bad in ({}, {"q": " \n"}, {"q": "x", "limit": "0"}, {"q": "x", "limit": "101"}, {"q": "x", "limit": "a"}, {"q": "x", "per_file": "-1"}):
        with pytest.raises(ValueError):
            search.parse_request(bad)


def test_models_prefix_batch_and_count(spark):
    seen = []
    model = embedding.Model("m", 2, lambda ts: seen.append(list(ts)) or [np.ones(2)] * len(ts), "passage: ", "query: ", 2)
    assert len(model.vectors(["a", "b", "c"], model.passage)) == 3 and seen == [["passage: a", "passage: b"], ["passage: c"]]
    assert embedding.query_vector(model, "x") == [1.0, 1.0] and seen[-1] == ["query: x"]
    for broken in (lambda ts: [np.ones(2)], lambda ts: [np.ones(3)] * len(ts)):
        with pytest.raises(ValueError):
            embedding.Model("b", 2, broken).vectors(["a", "b"], "")
    with pytest.raises(ValueError):
        embedding.query_vector(model, " ")
    with pytest.raises(ValueError):
        embedding.register(embedding.Model("hashed-words", 3, lambda ts: []))
    plain, prefixed = (embedding.MODELS[n] for n in ("hashed-words", "hashed-words-prefixed"))
    rows = spark.createDataFrame([("alpha beta",), (None,)], "t string").select(embedding.passages(plain)("t").alias("a"), embedding.passages(prefixed)("t").alias("b")).collect()
    assert len(rows[0]["a"]) == embedding.DIMENSION and rows[0]["a"] != rows[0]["b"] and not any(rows[1]["a"])


def test_small_texts(spark):
    row = spark.range(1).select(
        text.plural(F.lit(1), "scan").alias("a"), text.plural(F.lit(0), "scan").alias("b"), text.activity_line(F.lit("/f"), F.lit(""), F.lit(1), F.lit(0)).alias("c"), text.activity_line(F.lit(""), F.lit(""), F.lit(0), F.lit(0)).alias("d"),
        text.scan_summary(F.lit(0), F.lit(0), F.lit(0), F.lit(9), F.lit(749)).alias("e"), text.scan_summary(F.lit(0), F.lit(0), F.lit(0), F.lit(9), F.lit(750)).alias("f"), text.scan_summary(F.lit(3), F.lit(0), F.lit(1), F.lit(9), F.lit(10)).alias("g"),
    ).first()
    assert tuple(row) == ("1 scan", "0 scans", "working on /f, 1 document queued", "", None, "9 unchanged in 0.8s", "3 indexed, 1 failed in 0.0s")


def test_links_unreadable_folders_and_division(spark, tmp_path):
    for n in range(6):
        (tmp_path / f"src/deep/d{n}").mkdir(parents=True)
        (tmp_path / f"src/deep/d{n}/f.go").write_text("x")
    (tmp_path / "src/top.md").write_text("y")
    os.symlink(tmp_path / "src/top.md", tmp_path / "src/link.md")
    os.symlink(tmp_path / "src", tmp_path / "loop")
    got = sorted(r["display_path"] for r in localtree.scan(spark, str(tmp_path)).collect())
    assert got == sorted([f"src/deep/d{n}/f.go" for n in range(6)] + ["src/link.md", "src/top.md"])
    parts = localtree.LocalTreeReader({"path": str(tmp_path)}).partitions()
    assert len(parts) >= 8 and sorted(r[4] for p in parts for r in localtree.LocalTreeReader({"path": str(tmp_path)}).read(p)) == got
    assert localtree.from_catalog(spark, "local_dir", str(tmp_path)).count() == len(got)
    with pytest.raises(ValueError):
        localtree.from_catalog(spark, "s3", "x")


def test_hints_of_changes(spark, tmp_path):
    root = tmp_path / "w"
    root.mkdir()
    (root / "a.md").write_text("x")
    w = watch.Watcher({"path": str(root)})
    rows, at = w.read(w.initialOffset())
    assert len(list(rows)) == 1  # the first scan is due
    assert list(w.read(at)[0]) == []
    (root / "b.png").write_text("x")
    assert list(w.read(at)[0]) == []  # nothing that a scan would see
    (root / "sub").mkdir()
    (root / "sub/b.go").write_text("x")
    (root / "c.go").write_text("x")
    rows, after = w.read(at)
    assert [r[0] for r in rows] == [str(root)] and list(w.readBetweenOffsets(at, after)) == [(str(root), "", after["digest"])]
    os.rename(root, tmp_path / "gone")
    rows, gone = w.read(after)
    assert list(rows) == [(str(root), "", watch.GONE)] and list(w.read(gone)[0]) == []
    os.rename(tmp_path / "gone", root)
    seen = []
    q = watch.on_hints(watch.hints(spark, str(root)), seen.append, str(tmp_path / "cp"), "1 second")
    until = time.time() + 60
    while not seen and time.time() < until and q.isActive:
        time.sleep(0.5)
    q.stop()
    assert seen == [str(root)]


def test_sources_of_the_catalog(spark, tmp_path):
    rows = [("b", "local_dir", "/x/y/", 2), ("a", "local_dir", "/x/z", 1)]
    sources = spark.createDataFrame(rows, "id string, type string, uri string, t int").select("id", "type", "uri", F.timestamp_seconds("t").alias("created_at"))
    assert [r["id"] for r in catalog.in_order(sources).collect()] == ["a", "b"]
    assert catalog.resolve(sources, "b") == "b" and catalog.resolve(sources, "/x/y") == "b" and catalog.resolve(sources, "/x/q/../z/") == "a"
    with pytest.raises(LookupError, match="/x/z, /x/y/"):
        catalog.resolve(sources, "/nowhere")
    with pytest.raises(LookupError, match="no sources"):
        catalog.resolve(sources.limit(0), "b")
    assert catalog.added(sources, sources).count() == 2 and catalog.by_id(sources, "a").count() == catalog.by_uri(sources, "/x/z").count() == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|CANNOT_PARSE"):
        spark.createDataFrame([("yesterday",)], "t string").select(catalog.strict_time(F.col("t"))).collect()


def test_rates_wait_for_the_first_seconds(spark):
    log = spark.createDataFrame([(3,), (4,)], "n int")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    assert events.rates(log, ["n"], at(0), at(4)).first()[0] is None
    assert events.rates(log, ["n"], at(0), at(6)).first()[0] == pytest.approx(70)


def test_display_seeds_from_snapshots(spark):
    kinds = [("snapshot", 5), ("document_deleted", 0), ("snapshot", 2), ("document_queued", 0), ("snapshot", 9), ("document_reading", 0), ("document_ingested", 0), ("document_failed", 0), ("document_failed", 0), ("document_failed", 0)]
    rows = [("k", n, kind, f"/f{n}", 2, "e", n * 10, "", "", "s", p, "/seed", "reading", "ready") for n, (kind, p) in enumerate(kinds)]
    log = spark.createDataFrame(rows, "viewer string, seq int, kind string, uri string, chunk_count int, error string, took_ms int, transport string, method string, source_id string, pending_documents int, active_document string, active_stage string, worker_state string")
    got = events.display(log, "viewer", ["seq"]).orderBy("seq").collect()
    assert [r["pending"] for r in got] == [5, 4, 2, 3, 3, 3, 2, 1, 0, 0]
    assert [r["active_document"] for r in got] == ["/seed"] * 5 + ["/f5"] * 3 + ["", ""]
    assert (got[-1]["ingested_total"], got[-1]["chunks_total"], got[-1]["failed_total"], got[-1]["last_error"], got[-1]["state"]) == (1, 2, 3, "/f9: e", "ready")
