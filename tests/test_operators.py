"""Golden cases of retrieval policy, reconciliation, parsing, chunking, ids, sources and streams."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.functions import ids, text
from quarry.operators import chunking, events, reconcile, search
from quarry.sources import ignore, localtree
from quarry.streaming import events as streams


def hits(spark, documents):
    return spark.createDataFrame([(i, d, 1.0 - i / 100) for i, d in enumerate(documents)], "vec_id int, label string, score double")


@pytest.mark.parametrize(
    ("documents", "per_file", "limit", "want"),
    [("aaabcd", 2, 5, "aabcd"), ("abacad", 1, 4, "abcd"), ("abcde", 2, 3, "abc"), ("aaaa", 0, 2, "aa"), ("aaabbb", 2, 10, "aabb")],
)
def test_collapse(spark, documents, per_file, limit, want):
    rows = search.collapse(hits(spark, documents), "label", per_file, limit).orderBy(F.desc("score")).collect()
    assert "".join(r["label"] for r in rows) == want


def test_fetch_limit():
    assert [search.fetch_limit(*x) for x in ((10, 0), (10, 2), (100, 2), (500, 2))] == [10, 40, 400, 500]
    for limit, per_file in ((0, 2), (101, 2), (10, -1), (10, 101)):
        with pytest.raises(ValueError):
            search.check_request(limit, per_file)


def test_unchanged_truth_table(spark):
    rows = [("h", "", "h", "x", True), ("h", "x", "g", "x", False), ("", "x", "h", "x", True), ("", "x", "h", "y", False), ("", "", "h", "", False)]
    frame = spark.createDataFrame(rows, "sh string, sp string, h string, p string, want boolean")
    assert frame.where(reconcile.unchanged(F.col("sh"), F.col("sp"), F.col("h"), F.col("p")) != F.col("want")).count() == 0


def test_nesting(spark):
    frame = spark.createDataFrame([(1, "/repo/bar"), (2, "/repo/ba"), (3, "/repo/bar/x"), (4, "/repo"), (5, "/repo/bar"), (6, "/other")], "id int, uri string")
    got = {r["id"]: (r["other"], r["relation"]) for r in reconcile.nesting(frame).collect()}
    assert got == {3: (1, "inside"), 4: (1, "contains"), 5: (1, "equal")}


def test_uuid5_equals_the_standard_library(spark):
    names = ["", "a", "é/ü", "x" * 300]
    for space in (ids.DOCUMENT_SPACE, ids.POINT_SPACE):
        got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(ids.uuid5(space, F.col("n"))).collect()]
        assert got == [str(uuid.uuid5(uuid.UUID(space), n)) for n in names]


@pytest.mark.parametrize(
    ("source", "body", "line"),
    [("---\na: b\n---\nbody", "body", 4), ("---\r\na: b\r\n---\r\nbody", "body", 4), ("---\nopen\nbody", "---\nopen\nbody", 1), ("---\n---", "", 2), ("x\n---\n---\n", "x\n---\n---\n", 1), ("", "", 1)],
)
def test_front_matter(spark, source, body, line):
    r = spark.createDataFrame([(source,)], "t string").select(*[c.alias(n) for c, n in zip(text.front_matter(F.col("t")), ("body", "line"), strict=True)]).first()
    assert (r["body"], r["line"]) == (body, line)


def test_word_windows(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g h"), (2, " \n "), (3, None)], "doc_id int, text string")
    rows = chunking.word_windows(frame, window=4, overlap=2).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == ["a b c d", "c d e f", "e f g h"]
    lined = spark.createDataFrame([(1, "a b\nc\n\nd e\nf", 7)], "doc_id int, text string, starting int")
    rows = chunking.word_windows(lined, line_col="starting", window=3, overlap=1).orderBy("chunk_index").collect()
    assert [(r["start_line"], r["end_line"]) for r in rows] == [(7, 8), (8, 10), (10, 11)]


def test_snippet_cuts_between_characters(spark):
    got = [r[0] for r in spark.createDataFrame([("é" * 10,), ("a  b\n c",), ("abc",)], "t string").select(text.snippet(F.col("t"), 5)).collect()]
    assert got == ["éé…", "a b c", "abc"]


def test_labels_and_paths(spark):
    frame = spark.createDataFrame([("", "one"), ("", "a/b/c"), ("shown", "a/b/c")], "d string, u string")
    assert [r[0] for r in frame.select(text.label(F.col("d"), F.col("u"))).collect()] == ["one", "b/c", "shown"]
    paths = spark.createDataFrame([("file:///a%20b+c",), ("http://x/y",), ("rel/p",), ("/abs",)], "u string")
    assert [r[0] for r in paths.select(text.result_path(F.col("u"), "/root")).collect()] == ["/a b+c", None, "/root/rel/p", "/abs"]


def test_gauge_never_falls_under_zero(spark):
    steps = [1, -1, -1, 1, 1, -1, -1, -1, 1]
    frame = spark.createDataFrame([(1, i, s) for i, s in enumerate(steps)], "k int, i int, s int")
    level, want = 0, []
    for s in steps:
        level = max(0, level + s)
        want.append(level)
    assert [r["level"] for r in events.gauge(frame, "k", F.col("s"), ["i"]).orderBy("i").collect()] == want


def test_local_tree(spark, tmp_path):
    files = {"a.go": "x", "__init__.py": "x", ".eslintrc.json": "x", "image.png": "x", "_priv/b.PY": "x", ".hidden/c.go": "x", "node_modules/d.js": "x", "src/vendor/e.go": "x", "src/f.ts": "x", "logs/g.txt": "x", "src/keep.log.md": "x", "src/skip.md": "x"}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
        os.utime(tmp_path / name, ns=(10**18 + 7, 10**18 + 7))
    (tmp_path / ".gitignore").write_text("logs/\n*.md\n")
    (tmp_path / "src/.gitignore").write_text("!keep*.md\n")
    rows = localtree.scan(spark, str(tmp_path)).collect()
    assert sorted(r["display_path"] for r in rows) == [".eslintrc.json", "__init__.py", "_priv/b.PY", "a.go", "src/f.ts", "src/keep.log.md"]
    assert all(r["content_hash"] == "" and r["fingerprint"] == f"1:{10**18 + 7}" for r in rows)
    (tmp_path / "a.go").write_text("now")
    fresh = {r["display_path"]: r["content_hash"] for r in localtree.scan(spark, str(tmp_path), exclude=[]).collect()}
    assert len(fresh["a.go"]) == 64 and "node_modules/d.js" in fresh and "src/vendor/e.go" in fresh
    with pytest.raises(FileNotFoundError):
        localtree.canonical(str(tmp_path / "none"))
    with pytest.raises(NotImplementedError):
        localtree.canonical("https://example.com")


def test_ignore_patterns():
    rules = [("", ignore.parse("# c\n*.log\n/top\ndir/\na/**/z\n!important.log\n")), ("sub", ignore.parse("*.txt\n"))]
    yes = ["x.log", "d/x.log", "top", "a/z", "a/b/c/z", "sub/n.txt"]
    no = ["important.log", "d/top", "dir", "n.txt", "b/a/z"]
    assert [ignore.ignored(rules, p, False) for p in yes] == [True] * len(yes)
    assert [ignore.ignored(rules, p, False) for p in no] == [False] * len(no)
    assert ignore.ignored(rules, "x/dir", True)


def test_streams_agree_with_batches(spark, tmp_path):
    log = spark.createDataFrame([(i, f"2024-01-01 00:00:{s:02d}", u, k, 0.0, "") for i, (s, u, k) in enumerate([(0, 1, "up"), (1, 1, "down"), (5, 1, "down"), (6, 2, "up"), (7, 1, "up"), (59, 2, "up")])], "event_id long, t string, user_id long, event_type string, value double, props string")
    log.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "log"))
    step = F.when(F.col("event_type") == "up", 1).otherwise(-1)
    for name, stream, mode in (("gauge", streams.gauge(streams.follow(spark, str(tmp_path / "log")), step), "update"), ("runs", streams.debounced(streams.follow(spark, str(tmp_path / "log"), ["up", "down"]), quiet="2 seconds", late="0 seconds"), "append")):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r["key"]: r["level"] for r in spark.table("gauge").collect()} == {1: 1, 2: 2}
    assert sorted((r["user_id"], r["hints"]) for r in spark.table("runs").collect()) == [(1, 2), (1, 2), (2, 1)]


def test_many_queries_run_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), float(i % 3)]) for i in range(40)], "vec_id long, embedding array<float>")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    asked = v.where("vec_id % 2 = 0")
    got = rows(search.nearest_each(v, asked, 3, most_queries=6))
    assert len(got) == 60 and got == rows(search.nearest_each(v, asked, 3))
