"""Registered queries against their SQL, and the pipeline against a brute-force version, on the smallest tables."""

import hashlib
import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import decontaminate, language, pieces, queries, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables are not there")


def views():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    r = views().execute(queries.SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(x) for x in got.select(*columns).collect()))) == sorted(map(str, r.fetchall()))


def test_pipeline(spark):
    docs = views().execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    bench = views().execute("SELECT text FROM benchmark").fetchall()
    kept = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    shingles = {i: frozenset(zip(*[t.encode().lower().split()[k:] for k in range(5)])) or frozenset([tuple(t.encode().lower().split())]) for i, t in kept}
    root = {i: i for i, _ in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, _) in enumerate(kept):
        for j, _ in kept[n + 1 :]:
            if 100 * len(shingles[i] & shingles[j]) >= 80 * len(shingles[i] | shingles[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = [(i, t) for i, t in kept if find(i) == i]
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [plain(t) for (t,) in bench]
    kept = [(i, t) for i, t in kept if not any(x in plain(t) for x in items)]
    library = pieces.codec(pieces.default_model()).library
    want = {}
    for i, t in kept:
        out, at = "", 0
        for start, end in sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, t) if len(m.group(r.group)) >= r.least):
            if start >= at:
                out += t[at:start] + "[secret]"
            at = max(at, end)
        ids = library.encode(out + t[at:])
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


ROWS = [
    (1, "Das ist ein Text über den Rhein und seine Städte", "de"), (2, "The river and its towns are described here once more", "en"), (None, "The river and its towns are described here once more", "en"), (None, "A text without an id of its own", "en"),
    (3, None, "en"), (4, "", None), (5, "123 !!", None), (6, "Ein Text", "de"), (6, "Ein Text", "de"), (6, "Another text under the same id", "en"), (7, "What is the secret? token=abcdef123456 and no more", "en"), (None, "token=abcdef123456 stands here too", None), (9, "word " * 40_000, "en"),
]


def clashing(spark, rows):
    """documents among columns that stages could take for their own."""
    return spark.createDataFrame([(*r, 0.5, "xx", "k", 7) for r in rows], "doc_id long, text string, lang string, score double, lang_pred string, item_id string, component_id long")


@pytest.mark.parametrize("labelled", [True, False])
def test_stages_with_nulls_repeats_and_clashing_columns(spark, tmp_path, labelled):
    docs = clashing(spark, [r if labelled else (*r[:2], None) for r in ROWS])
    spark.createDataFrame([(1, "A text without an id of its own"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda r: (r["doc_id"], (r["text"] or "")[:60])
    left = [(i, (t or "")[:60]) for i, t, _ in ROWS]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.collect()
        assert all((r["score"], r["lang_pred"], r["item_id"], r["component_id"]) == (0.5, "xx", "k", 7) for r in rows)
        if name == "language":
            left = [x for x in left if re.search(r"[^\W\d_]", x[1])]
        elif name == "near_duplicates":
            left = [x for n, x in enumerate(left) if x not in left[:n] and x != (None, ROWS[2][1])]
        elif name == "decontamination":
            left = [x for x in left if x != (None, "A text without an id of its own")]
        else:
            left = [(i, t.replace("token=abcdef123456", "[secret]")) for i, t in left]
        assert sorted(map(key, rows), key=str) == sorted(left, key=str), name
        docs = out
    assert len(corpus_pipeline.encode_pieces(spark, docs, SF).collect()) == len(left)


def test_held_out_languages_are_recognised(spark):
    got = queries.op8_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert language.UNKNOWN == "und" and decontaminate.COVERAGE == 0.8


def test_near_duplicates_of_the_pipeline_match_brute_force(spark):
    words = [f"w{k}" for k in range(120)]
    texts = {1: words, 2: words[:100], 3: words[:90], 4: [*words, *[f"x{k}" for k in range(20)]], 5: [f"y{k}" for k in range(60)], 6: ["short", "text"], 7: ["Short", "text"], 8: []}
    for k in range(9, 15):  # words changed apart from each other
        texts[k] = [f"z{k}" if n in range(7, 7 + 15 * (k - 8), 15) else w for n, w in enumerate(words)]
    sets = {i: {tuple(w.lower() for w in t[k : k + 5]) for k in range(max(1, len(t) - 4))} if t else set() for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SF).collect())
    assert kept == [i for i in sets if find(i) == i]
    assert 2 not in kept and 4 not in kept and 5 in kept
