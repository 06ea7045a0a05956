"""Circulant MinHash against brute force, and operators on rows that repeat an id with another text or payload."""

import hashlib
import random

import numpy as np
import pytest

from quarry.llm import jaccard, minhash, suffixes, warc

CLASH = "text string, doc_id long, lang string, score double, start int, id long, key string, a long, kept int"


def docs_of(spark, rows):
    return spark.createDataFrame([(t, i, "en", 0.5, 1, 7, "x", 1, 0) for i, t in rows], CLASH)


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_groups(rows, words, hundredths):
    """(id, size, component) of each row; ids that repeat are one document."""
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, words)) for i, t in rows]
    some = [(i, s) for i, s in dict.fromkeys(sets) if s and i is not None]
    for n, (a, x) in enumerate(some):
        for b, y in some[n + 1 :]:
            if 100 * len(x & y) >= hundredths * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i) if i is not None else None) for i, s in sets)


def near_copies(seed, families=4, each=14, sure=False):
    """Texts of 40 to 160 words with edits of their own, some of them just too far."""
    rng, rows = random.Random(seed), []
    for family in range(families):
        base = [f"v{rng.randrange(400)}" for _ in range(40 + 40 * family)]
        for k in range(each):
            w = list(base)
            for _ in range(rng.randint(0, 1 if sure else 2 + k // 3)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
            rows.append((100 * family + k + 20, " ".join(w)))
    return rows


LITTLE = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one  two"), (7, "two one"), (8, "a b c d e")]


@pytest.mark.parametrize(("family", "hot", "block", "rounds"), [(8 << 20, 1024, 512, 3), (1, 1024, 512, 0), (3000, 2, 4, 2)])
def test_minhash_matches_brute_force(spark, monkeypatch, family, hot, block, rounds):
    for name, value in (("FAMILY_BYTES", family), ("PART_BYTES", family), ("HOT", hot), ("BLOCK", block), ("ROUNDS", rounds)):
        monkeypatch.setattr(jaccard, name, value)
    rows = [*LITTLE, *near_copies(4), (900, " ".join(f"l{k % 5000}" for k in range(40_000))), (901, " ".join(f"l{k % 5000}" for k in range(40_000)) + " end")]
    rows += rows[12:16]
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs_of(spark, rows)).collect())
    assert got == [(i, n, c, i == c) for i, n, c in brute_groups(rows, 4, 80)]


def test_signatures_are_circulant_and_estimate_similarity():
    rng = np.random.default_rng(1)
    both = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for shared in (500, 1000, 2000):
        x, y = both[: 1000 + shared // 2], both[1000 - shared // 2 : 2000]
        a, b = minhash.signatures_of([x, y], 400)
        want = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((a == b).mean() - want) < 0.08
    # the next coordinate is the first one of a set moved on by one
    tokens = np.unique(both >> np.uint64(32))
    spare = np.empty(len(tokens), dtype=np.uint32)
    moved = minhash._permuted(tokens.astype(np.uint32), minhash._FIRST, np.empty_like(spare), spare) + np.uint32(1)
    assert minhash.signatures_of([tokens << np.uint64(32)], 2)[0, 1] == minhash._permuted(moved, minhash._SECOND, np.empty_like(spare), spare).min()
    for factors in (minhash._FIRST, minhash._SECOND):  # permutations: no two numbers meet
        some = np.arange(1 << 20, dtype=np.uint32) * np.uint32(4096 + 1)
        assert len(np.unique(minhash._permuted(some, factors, np.empty_like(some), np.empty_like(some)))) == len(np.unique(some))


def test_recall_at_the_threshold():
    """Pairs of similarity just above 0.8 share a band: all of them but three in a million are expected to."""
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(3000):
        base = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        sets += [np.unique(base[:162]), np.unique(base[18:])]  # 144 of 180
    keys = minhash.bands_of(sets)
    assert (keys[::2] == keys[1::2]).any(axis=1).all()


def test_minhash_of_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY_BYTES", 200_000)
    monkeypatch.setattr(jaccard, "PART_BYTES", 100_000)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = [(n, " ".join(f"x{n}" if k == at else w for k, w in enumerate(base))) for n in range(1500) for at in [rng.randrange(5, 110)]]
    rows += [(5000 + n, " ".join(f"y{n}-{k}" for k in range(30))) for n in range(50)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(spark, rows)).collect()}
    assert {got[n] for n in range(1500)} == {0} and all(got[n] == n for n in range(5000, 5050))


def test_minhash_of_little(spark):
    assert minhash.near_duplicates(docs_of(spark, []).limit(0)).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(docs_of(spark, [(None, "a b c"), (None, None)])).orderBy("n_shingles").collect()] == [(None, 0, None, True), (None, 1, None, True)]


W, W2 = " ".join(f"p{k}" for k in range(60)), " ".join(f"q{k}" for k in range(60))


def test_documents_of_several_texts_are_linked_through_each(spark):
    rows = [(2, W), (2, W2), (3, W2 + " end"), (1, W), (4, "alone here with nobody else"), (4, None), (5, W2), (5, W), (None, W), *near_copies(8, 2), (20, W2), (121, "another text of this id"), (6, "q"), (6, "q"), (-3, W2 + " last")]
    for got, words, hundredths in ((jaccard.jaccard_groups(docs_of(spark, rows)), 3, 90), (minhash.near_duplicates(docs_of(spark, rows)).drop("kept"), 4, 80)):
        key = lambda r: (r[0] is not None, *(x or 0 for x in r))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_groups_of(rows, words, hundredths), key=key)


def brute_groups_of(rows, words, hundredths):
    """brute_groups where some ids are null."""
    known = brute_groups([r for r in rows if r[0] is not None], words, hundredths)
    return known + [(None, len(shingles(t, words)), None) for i, t in rows if i is None]


def brute_dedup(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_of_ids_with_several_texts(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(n))
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(1, a), (2, a + b), (2, "short"), (2, b), (2, None), (3, b[30:200] + c), (3, c), (3, c), (7, c + a[:90]), (-4, c[100:180]), (5, prose(5)), (5, b[:70] + prose(3) + a[20:90])]
    rows += [(9, prose(4) + a[k : k + 80 + k]) for k in range(12)]
    got = sorted(tuple(r) for r in suffixes.deduplicate(docs_of(spark, rows)).drop("kept").collect())
    assert got == brute_dedup(rows)
    assert suffixes.deduplicate(docs_of(spark, [(None, a), (None, a), (4, a)])).where("n_removed > 0").count() == 0
    with pytest.raises(ValueError, match="too large"):
        suffixes.deduplicate(docs_of(spark, [(1 << 62, a), (1 << 62, b), (1 << 62, c)]))


def test_warc_of_ids_with_several_payloads(spark):
    a, b, c = ("<p>" + x * 1500 for x in "abc")
    rows = [(1, a), (1, b), (5, a), (6, b), (6, c), (None, c), (1, b), (2, "small"), (2, a), (5, a)]
    pages = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string")
    got = warc.archive_pages(pages).collect()
    largest = {h: max(i for i, x in rows if x == h and i is not None) for _, h in rows}
    want = sorted(((i, hashlib.sha1(h.encode()).hexdigest(), *(("revisit", largest[h]) if len(h) >= 1000 and i != largest[h] else ("response", None))) for i, h in rows), key=str)
    assert sorted(((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want
    assert {r["payload_digest"] for r in got if r["record_type"] == "response"} == {hashlib.sha1(h.encode()).hexdigest() for _, h in rows}
