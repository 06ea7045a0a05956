"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quarry.jobs import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables are not there")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    r = duck.execute(registry.SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(got.columns)
    line = lambda row: tuple(round(x, 6) if isinstance(x, float) else str(x) for x in row)
    assert sorted(map(line, got.select(*columns).collect()), key=str) == sorted(map(line, r.fetchall()), key=str)


@pytest.mark.parametrize(("name", "key", "source"), [("markdown_chunks", "doc_id", lambda s: registry.registry_more._markdown(s, SF).select("doc_id", "text")), ("code_chunks", "page_id", lambda s: s.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id", "html AS text"))])
def test_chunks_hold_whole_texts(spark, name, key, source):
    """Queries without SQL: the chunks of each text, put together, are its words in order, and their lines go up."""
    texts = {r[key]: r["text"] or "" for r in source(spark).collect()}
    rows = registry.QUERIES[name](spark, SF).orderBy(key, "chunk_index").collect()
    own = {k: [r for r in rows if r[key] == k] for k in texts}
    for k, t in texts.items():
        assert "".join("".join(r["text"] for r in own[k]).split()) == "".join(t.split())
        assert [r["chunk_index"] for r in own[k]] == list(range(len(own[k])))
        assert all(a["start_line"] <= a["end_line"] <= b["end_line"] for a, b in zip(own[k], own[k][1:]))
        assert all(len(r["text"].encode()) <= 1200 for r in own[k])


def test_entry_imports_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'search_collapse' in q and not any(n.startswith('op') for n in q) and set(s) <= set(q); print(len(q))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0, out.stderr
