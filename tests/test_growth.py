"""Work and memory of queries that grow with whole texts: what their plans hold, and results on odd texts and repeated keys."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.jobs import registry
from quarry.operators import chunking, embedding

SPACES = "\t\n\x0b\x0c\r \x85\xa0       　"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(1, "Red fox red"), (2, " \n "), (3, None), (4, ""), (5, f"{SPACES}a{SPACES}b\x1cc​d 😀{SPACES}"), (6, "red"), (6, "fox hen"), (7, "hen"), (None, "fox"), (None, "red fox")]
    return spark.createDataFrame(odd, "doc_id int, text string")


def test_hash_search_keeps_a_text_in_its_row(spark, docs):
    """a task held all buckets of all its texts in one aggregation; now only texts whose key is repeated are exploded."""
    once = docs.where("doc_id IN (1, 5, 7)")
    assert "Generate" not in plan(embedding.nearest_by_hash(once, once.where("doc_id = 1"), "doc_id", 9))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], Counter()).update(int(b) for b in (embedding.hashlib.md5(w.encode()).hexdigest()[:7] for w in embedding.WORD.findall((r["text"] or "").lower())) for b in [int(b, 16) % embedding.DIMENSION])
    asked = texts[1]
    norm = lambda c: math.sqrt(sum(n * n for n in c.values()))
    want = {k: round(sum(n * asked[b] for b, n in c.items()) / norm(c) / norm(asked), 6) for k, c in texts.items() if any(b in asked for b in c)}
    got = embedding.nearest_by_hash(docs, docs.where("doc_id = 1"), "doc_id", 9).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want) and None in want and 6 in want
    assert embedding.nearest_by_hash(docs, docs.where("doc_id = 2"), "doc_id", 9).collect() == []


def test_windows_take_words_apart_once(docs):
    """words were extracted once more for a filter, and all words of a text were copied for each of its windows."""
    p = plan(chunking.word_windows(docs))
    assert p.count("array_remove(split") == 1 and "regexp_extract_all" not in p and "Filter (size" not in p
    assert [(r["text"], r["start_line"], r["end_line"]) for r in chunking.word_windows(docs.where("doc_id = 5")).collect()] == [("a b\x1cc​d 😀", 2, 3)]


@pytest.mark.parametrize("name", ["point_ids", "chunk_limits"])
def test_indexes_and_limits_count_words(spark, name):
    """the words of each line were made into structs and put together, for their number alone."""
    p = plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "flatten" not in p and "regexp_extract_all" not in p


@pytest.mark.parametrize("n", [0, 1, 220, 221, 400, 401, 1000])
def test_indexes_are_those_of_windows(spark, n):
    own = spark.createDataFrame([(1, "w\n " * n)], "doc_id int, text string")
    cut = sorted(r["chunk_index"] for r in chunking.word_windows(own).collect())
    assert sorted(r["chunk_index"] for r in chunking.window_indexes(own).collect()) == cut
    assert [r["chunks"] for r in chunking.texts_over_limit(own, "doc_id", most=0).collect()] == [r["chunks"] for r in chunking.over_limit(chunking.word_windows(own), "doc_id", 0).collect()]
