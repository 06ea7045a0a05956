"""Every operator against a brute-force version on a small fixture: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import decontaminate, jaccard, language, pieces, recurrent, secrets, suffixes, topk, url_rules, warc

CLASH = "text string, doc_id long, lang string, score double, start int, id long, token string, a long"


def docs_of(spark, rows):
    """doc_id and text among columns whose names operators use themselves."""
    return spark.createDataFrame([(t, i, "en", 0.5, 1, 7, "x", 1) for i, t in rows], CLASH)


def prose(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéfgß") for _ in range(rng.randint(1, 7))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# --- 1: secrets --------------------------------------------------------------------------------


def brute_secrets(text):
    out = []
    for rank, rule in enumerate(secrets.RULES):
        out += [(m.start(), rank, rule.kind, m.end()) for m in re.finditer(rule.pattern, text or "") if len(m.group(rule.group)) >= rule.least]
    return sorted(out)


SECRET_TEXTS = [
    None, "", "nothing", 'é password = "hunter22" token=ab token: abcdef', "API_KEY:'" + "x" * 9 + "' apikey=zzzzzz9 TOKEN==abcdef passwd=token:abcdef",
    "AKIA" + "Z9" * 8 + " AKIAAKIA" + "0" * 16 + " AKIAshort", "0123456789abcdef" * 3 + "g" + "ab" * 11, "ghp_" + "a" * 40 + " xoxb-1234567890-x https://u:pass@h/ eyJab.eyJcd." + "q" * 40,
    "-----BEGIN RSA PRIVATE KEY-----\nsecret=abc123", "ſecret=abcdefg toKen=abcdefg", "x " * 30_000 + "secret : 'a1b2c3d4'" + " y" * 30_000,
]


def test_secrets_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(SECRET_TEXTS)] * 2
    got = sorted((r["doc_id"], [tuple(s) for s in r["found"]]) for r in secrets.scan(docs_of(spark, rows)).collect())
    assert got == sorted((i, brute_secrets(t)) for i, t in rows)
    assert secrets.scan(docs_of(spark, []).limit(0)).count() == 0
    assert len(secrets.digests(secrets.scan(docs_of(spark, rows))).collect()) == len(rows)


def test_trigram_queries_are_necessary_conditions():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for text in filter(None, SECRET_TEXTS):
            for m in re.finditer(rule.pattern, text):
                low = m.group().lower()
                assert not query or any(all(t in low for t in c) for c in query), (rule, m.group())
    assert not secrets.trigram_query("[0-9a-f]+") and secrets.trigram_query("abc(de|fg)h") == frozenset({frozenset({"abc", "bcd", "cde", "deh"}), frozenset({"abc", "bcf", "cfg", "fgh"})})


def test_redaction_takes_every_span(spark):
    rows = [(i, t) for i, t in enumerate(SECRET_TEXTS)]
    frame = docs_of(spark, rows)
    out = secrets.redact(frame)
    assert out.columns == frame.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for i, t in rows:
        if t is None:
            assert got[i] is None
            continue
        want, at = "", 0
        for start, _, _, end in brute_secrets(t):
            if start >= at:
                want += t[at:start] + "[secret]"
            at = max(at, end)
        assert got[i] == want + t[at:]


# --- 2: suffix arrays --------------------------------------------------------------------------


def test_suffix_order_on_random_strings():
    rng = random.Random(5)
    for _ in range(1500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))]
        s = (s * rng.choice([1, 1, 4])) + [0]
        assert suffixes.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


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
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_matches_brute_force(spark):
    shared, line = prose(1, 60), "All of this is licensed under the terms of the licence that comes with it. "
    rows = [(3, None), (4, ""), (5, shared), (9, prose(2, 30) + shared + prose(3, 20)), (7, shared[:120] + "#" + shared[60:260]), (8, shared), (20, "a" * 300), (21, "a" * 400), (22, line * 5), (23, line * 3 + prose(4, 20)), (24, "x" + line + "y" + line[5:60]), (30, prose(6, 4000)), (31, prose(6, 4000)[5000:9000])]
    rows += [(40 + i, prose(1, 40)[i : 150 + 2 * i] + prose(50 + i, 10) + line[i : i + 52]) for i in range(12)]
    got = sorted(tuple(r) for r in suffixes.deduplicate(docs_of(spark, rows)).drop("kept").collect())
    assert got == brute_dedup(rows)
    assert suffixes.deduplicate(docs_of(spark, []).limit(0)).count() == 0
    assert suffixes.deduplicate(docs_of(spark, [(None, "q" * 90), (1, "q" * 90)])).where("n_removed > 0").count() == 0


@pytest.mark.parametrize("divided", [1 << 17, 0])
def test_one_common_line_in_most_documents(spark, monkeypatch, divided):
    monkeypatch.setattr(suffixes, "DIVIDED", divided)
    monkeypatch.setattr(suffixes, "GATHERED", 2000)
    line = "All rights to this page are reserved by those who wrote it, as far as the law has it. "
    rows = [(i, prose(i % 90, 12) + line[i % 7 :] * (i % 3) + prose(i % 40 + 100, 12) + line[: 50 + i % 30]) for i in range(600)]
    got = sorted(tuple(r) for r in suffixes.deduplicate(docs_of(spark, rows).repartition(6)).drop("kept").collect())
    assert got == brute_dedup(rows)


def test_long_texts_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 2000)
    import pyarrow as pa

    text = prose(8, 1500).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text[100:]], pa.binary())], names=["doc", "text"])
    starts = sorted(int(ids[r]) * 10**6 + int(base[r]) + int(s) + k for ids, base, data, rows in suffixes._pieces(iter([batch])) for r, s, n in zip(*suffixes.stretches(data, rows, np.zeros(suffixes.COUNTERS, dtype=np.uint8))[:3]) for k in range(n))
    assert starts == [10**6 + k for k in range(len(text) - 49)] + [2 * 10**6 + k for k in range(len(text) - 149)]


# --- 3: Jaccard --------------------------------------------------------------------------------


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in keys)


def jaccard_rows():
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one  two"), (7, "two one")]
    for family in range(4):
        base = prose(100 + family, 60 + 40 * family, 500).split()
        for k in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 3 + k // 3)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
            rows.append((50 + 20 * family + k, " ".join(w)))
    return rows + [(200, prose(11, 3000, 900)), (201, prose(11, 3000, 900) + " end")]


@pytest.mark.parametrize(("family", "hot", "block", "rounds"), [(8 << 20, 1024, 512, 3), (1, 1024, 512, 0), (2000, 3, 4, 1), (3000, 2, 512, 2)])
def test_jaccard_groups_match_brute_force(spark, monkeypatch, family, hot, block, rounds):
    for name, value in (("FAMILY_BYTES", family), ("PART_BYTES", family), ("HOT", hot), ("BLOCK", block), ("ROUNDS", rounds)):
        monkeypatch.setattr(jaccard, name, value)
    rows = jaccard_rows()
    got = sorted(tuple(r) for r in jaccard.jaccard_groups(docs_of(spark, rows + rows[10:14])).distinct().collect())
    assert got == brute_jaccard(rows)


def test_thousands_of_near_copies_and_one_token_in_all(spark, monkeypatch):
    """Copies of one text with edits of their own, and copies that are just too far; all begin alike."""
    monkeypatch.setattr(jaccard, "FAMILY_BYTES", 400_000)
    monkeypatch.setattr(jaccard, "PART_BYTES", 200_000)
    rng = random.Random(21)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for n in range(3000):
        words = list(base)
        for at in rng.sample(range(8, 100), 1 if n % 10 else 4):  # one edit: 3 of 101 shingles; four: up to 12
            words[at] = f"x{n}-{at}"
        rows.append((n, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(docs_of(spark, rows)).collect()}
    sets = {i: frozenset(zip(w, w[1:], w[2:])) for i, t in rows for w in [t.split()]}
    ids = sorted(sets)
    index = {x: n for n, x in enumerate(sorted(set().union(*sets.values())))}
    held = np.zeros((len(ids), len(index)), dtype=np.float32)
    for k, i in enumerate(ids):
        held[k, [index[x] for x in sets[i]]] = 1
    both = held @ held.T
    size = held.sum(axis=1)
    linked = 100 * both >= 90 * (size[:, None] + size[None, :] - both) - 1e-3
    label = np.arange(len(ids))
    while True:
        new = np.array([label[row].min() for row in linked])
        new = new[new]
        if (new == label).all():
            break
        label = new
    assert [got[i] for i in ids] == [ids[k] for k in label] and len(set(label.tolist())) > 20


@pytest.mark.parametrize("hundredths", [80, 90])
def test_sketches_tell_unlike_sets_apart(hundredths):
    """At 0.8 sets may differ in twice as many tokens, so sketches have more bits; those of linked sets never exclude."""
    rng = np.random.default_rng(8)
    for n in (400, 900, 2000, 4000, 8000):
        x, y = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2))
        moved = (n * (100 - hundredths)) // (100 + hundredths)  # with so many others, similarity is the threshold or just above
        near = np.concatenate([x[moved:], y[:moved]])
        sketches = jaccard._sketches([jaccard._parity(s, hundredths) for s in (x, y, near)])
        allowed = 2 * n - 2 * -(-2 * n * hundredths // (100 + hundredths))
        unlike, like = jaccard._apart(sketches, np.array([0, 0]), np.array([1, 2])).tolist()
        assert like <= allowed < unlike, n


def test_unlike_documents_of_a_large_family_are_sent_once(spark, monkeypatch):
    """One token makes a family of documents that hardly any link holds together: further rounds don't send them again, and the few near copies are found."""
    for name, value in (("FAMILY_BYTES", 1), ("PART_BYTES", 4000), ("HOT", 3), ("FIRST", 1)):
        monkeypatch.setattr(jaccard, name, value)
    sent, within = [], jaccard._within
    monkeypatch.setattr(jaccard, "_within", lambda texts, members, *rest: (sent.append(members.count()), within(texts, members, *rest))[1])
    rows = [(n, " ".join(["all", "begin", "so"] + [f"w{n}-{k}" for k in range(25)])) for n in range(40)]
    rows += [(100 + n, rows[n][1] + " end") for n in range(4)]
    got = sorted(tuple(r) for r in jaccard.jaccard_groups(docs_of(spark, rows)).collect())
    assert got == brute_jaccard(rows) and len({c for _, _, c in got}) == 40
    assert sum(sent) <= 44 + 8  # all of them in the first round, then those that are no longer alone


def test_jaccard_of_little(spark):
    assert jaccard.jaccard_groups(docs_of(spark, []).limit(0)).count() == 0
    assert [tuple(r) for r in jaccard.jaccard_groups(docs_of(spark, [(None, "a b c")])).collect()] == [(None, 1, None)]


def test_prefixes_lose_no_pair():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 5, jaccard.COUNTERS).astype(np.uint8)
    for n in (1, 2, 9, 10, 11, 57):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for d in range(len(x) // 10 + 1):
            y = np.unique(np.concatenate([x[: len(x) - d], rng.integers(0, 2**63, d, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 90 * (len(x) + len(y) - both):
                for order in range(jaccard.ORDERS):
                    assert len(np.intersect1d(jaccard.prefix(x, classes, order, 90), jaccard.prefix(y, classes, order, 90)))


# --- 4: pieces ---------------------------------------------------------------------------------


def test_pieces_agree_with_the_library(spark):
    library = pieces.codec(pieces.default_model()).library
    texts = [None, "", " ", "  two  blanks ", "\n", "a\n\nb \n c", "▁mark ▁ x", "😀 日本 \x00\t", "é" * 200, "x" * 3000, "<s> </s> <0x0A> <unk>", prose(4, 500), "hello world " * 40 + " " * 40]
    rows = list(enumerate(texts)) * 2
    got = pieces.encode_decode(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "")
        assert (r["ids"], r["decoded"], r["agrees"]) == (ids, library.decode(ids), True)
    for r in pieces.digests(docs_of(spark, rows)).collect():
        ids = library.encode(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert pieces.digests(docs_of(spark, []).limit(0)).count() == 0


def test_both_agendas_merge_alike(monkeypatch):
    own = pieces.codec(pieces.default_model())
    words = ["▁" + w for w in prose(12, 300).split()] + ["▁▁▁▁the", "aaaaaaaaaaaaaaa", "▁internationalisation"]
    assert own.encode_many(words) == [[x for s in own._heap(w) for x in own._fallen(s)] for w in words]


# --- 5: decontamination ------------------------------------------------------------------------


ITEM = "A train leaves Paris with 120 passengers and travels 300 km in 3 hours before Marie counts the remaining 95 seats in the last wagon."


def test_contaminated_documents(spark):
    changed = ITEM.replace("120", "77").replace("300 km", "250 miles").replace("Paris", "Berlin").replace("Marie", "Otto")
    mixed = ITEM.replace("Marie", "Paris").replace("120", "95").replace("300 km", "95 km")  # one value now stands for several
    rows = [(1, prose(1, 80) + " " + ITEM + " " + prose(2, 80)), (2, changed), (3, prose(3, 900)), (4, ITEM.upper()), (5, None), (6, ""), (7, " ".join(ITEM.split()[:8])), (8, ITEM.replace("remaining", "other")), (9, "Tiny text!"), (10, mixed.replace("leaves", "quits").replace("travels", "goes"))]
    bench = spark.createDataFrame([(1, ITEM, 0), (2, None, 0), (3, "", 0), (4, prose(70, 30), 0), (5, "tiny text", 0)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.contaminated(docs_of(spark, rows * 2), bench).collect()}
    assert got == {(1, 1): False, (2, 1): True, (4, 1): False, (8, 1): False, (9, 5): False}
    in_parts = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, rows), bench, pass_windows=40).collect()}
    assert in_parts == set(got)
    assert decontaminate.contaminated(docs_of(spark, []).limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs_of(spark, rows), bench.limit(0)).count() == 0


def test_short_and_number_dense_items_in_longer_documents(spark):
    items = ["What is 12 + 35?", "Solve 3 + 4", "Solve 3 + 4 + 5 + 6 + 7 + 8", "tiny text", "Add 1.5 to 2.25"]
    bench = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    rows = [(10 + n, prose(n, 40) + ". " + t + " " + prose(20 + n, 40)) for n, t in enumerate(items, 1)]
    rows += [(20, prose(31, 30) + " What is 12 + 36? Add 1.7 to 2.25 Solve 4 + 3 tiny texts " + prose(32, 30)), (21, "What is 13 + 36?"), (22, items[1]), (23, "7"), (24, "solve 3 + 4 tiny"), (25, None)]
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_windows"], r["reparameterised"]) for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect()}
    assert set(got) == {(11, 1), (12, 2), (13, 3), (13, 2), (14, 4), (15, 5), (21, 1), (22, 2), (24, 2)}
    assert got[11, 1] == got[22, 2] == (1.0, 1, False) and got[21, 1] == (1.0, 1, True)


FIRST, LAST = "Anna Ben Clara David Emma Felix Grace Hugo".split(), "Otto Karl Lena Mia Nora Paul Rosa Tom".split()
STORIES = [
    "{0} has {a} apples. {0} gives {1} {b} apples. {1} eats {c} of them. How many apples does {0} have left?",
    "A shop sells pens at {a} cents each. {0} buys {b} pens and {1} buys {c} more than that. What do they pay together?",
    "{0} walks {a} km on Monday. On Tuesday {0} walks {b} km with {1}. How far must they still go to reach {c} km?",
    "There are {a} birds on a fence near the house of {0}. Then {b} fly off. {1} counts {c} new ones. How many birds are there now?",
    "{0} reads {a} pages a day. {1} reads {b} pages a day. After {c} days who of the two has read more pages and by how many?",
]


def stories(rng, names):
    return [s.format(*rng.sample(names, 2), a=rng.randint(11, 40), b=rng.randint(41, 70), c=rng.randint(71, 99)) for s in STORIES]


def test_recall_of_reparameterised_questions(spark):
    rng = random.Random(3)
    items = [(k, t) for k, t in enumerate(stories(rng, FIRST))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for n in range(12):
        for k, t in enumerate(stories(rng, LAST)):
            rows.append((10 * n + k, prose(5 * n + k, 40) + ". " + t + " " + prose(5 * n + k + 500, 40)))
            want.add((10 * n + k, k))
    rows += [(1000 + n, prose(900 + n, 120) + f". {LAST[n % 8]} has {n} pears. How many are there?") for n in range(40)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect()}
    assert len(got & want) >= 0.9 * len(want) and got <= want


def brute_templates(text):
    """(word, kind, opens a sentence with a capital) of a text of ASCII and Latin-1."""
    out, last = [], None
    for m in re.finditer(r"[A-Za-z\x80-\uffff]+|[0-9]+", text or ""):
        w, low = m.group(), m.group().lower()
        numeric = w[0].isdigit() or low in decontaminate.NUMBERS
        before = out and out[-1][1] == decontaminate.NUMBER
        opens = last is None or bool(re.search(r'[.!?\n\r:;|"(]', text[last.start() : m.start()]))
        if numeric and before:
            gap, digits = text[last.end() : m.start()], (last.group()[0].isdigit(), w[0].isdigit())
            if gap in (",", ".") if all(digits) else (not gap.strip() or gap == "-"):
                out[-1] = (out[-1][0] + (low,), out[-1][1], False)
                last = m
                continue
        kind = decontaminate.NUMBER if numeric else decontaminate.UNIT if before and low in decontaminate.UNITS else decontaminate.NAME if w[0].isupper() and not opens else decontaminate.WORD
        out.append(((low,), kind, kind == decontaminate.WORD and w[0].isupper() and opens))
        last = m
    return out


def brute_windows(t, items, widths):
    size, found = decontaminate.WINDOW, []
    for i in range(len(t)):
        width = min(size, len(t) - i)
        own = t[i : i + width]
        word = lambda x: x[1] == decontaminate.WORD
        name = lambda x: x[1] == decontaminate.NAME
        if width == size or i == 0:
            for shape, literal, needed in (
                (lambda x: x[0] if word(x) or name(x) else x[1], lambda x: word(x) or name(x), lambda x: True),
                (lambda x: x[0] if word(x) else x[1], word, name),
                (lambda x: decontaminate.NAME if x[2] else x[0] if word(x) else x[1], lambda x: word(x) and not x[2], lambda x: x[2]),
            ):
                if sum(map(literal, own)) >= min(2, width) and any(map(needed, own)):
                    found.append((i, tuple(map(shape, own))))
        for width in {size, *widths}:
            own = t[i : i + width]
            literal = sum(word(x) or name(x) for x in own)
            whole = i == 0 and len(t) == width
            use = literal < 2 if width == size else whole if items else not (whole and literal >= min(2, width))
            if len(own) == width and use and (literal or width > 1):
                found.append((i, ("exact", *[x[0] for x in own])))
    return found


def brute_contaminated(rows, items):
    size = decontaminate.WINDOW
    items = {k: brute_templates(t) for k, t in items if t}
    widths = {len(t) for t in items.values() if 0 < len(t) < size}
    out = set()
    for doc, text in rows:
        t = brute_templates(text)
        probes = brute_windows(t, False, widths)
        for k, own in items.items():
            index = collections.defaultdict(list)
            for i, w in brute_windows(own, True, widths):
                index[w].append(i)
            hits = sorted({(d, i) for d, w in probes for i in index[w]})
            for start, _ in hits:
                there, back, seen = {}, {}, set()
                for d, i in hits:
                    if not start <= d < start + 2 * len(own):
                        continue
                    pairs = [(a[0], b[0]) for a, b in zip(own[i : i + size], t[d : d + size]) if a[1] != decontaminate.WORD or (a[2] and a[0] != b[0])]
                    if all(there.get(x, y) == y and back.get(y, x) == x for x, y in pairs):
                        there.update(pairs)
                        back.update((y, x) for x, y in pairs)
                        seen |= set(range(i, min(i + size, len(own))))
                if len(seen) >= decontaminate.COVERAGE * len(own):
                    out.add((doc, k))
    return out


def test_contaminated_matches_brute_force(spark):
    rng = random.Random(11)
    items = list(enumerate([*stories(rng, FIRST), ITEM, "What is 12 + 35?", "3 4 5 6 7 8 9 10 11", "tiny text", "7", "Élan vital für Österreich ist zwei Tage alt.", "", None]))
    rows = []
    for n in range(120):
        t = rng.choice([*stories(rng, LAST), *[x for _, x in items if x]])
        words = t.split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(["other", "19", "Zoe", "kg", words[0]])
        rows.append((n, " ".join([prose(n, rng.randint(0, 12)) + rng.choice(["", ".", ","]), *words, prose(n + 300, rng.randint(0, 12))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs_of(spark, rows), bench).collect()}
    assert got == brute_contaminated(rows, items) and len(got) > 60


def test_numbers_go_on_only_across_commas_and_points():
    import pyarrow as pa

    kinds = lambda text: decontaminate.template(pa.array([text])).kinds.tolist()
    assert kinds("is 12 + 35") == kinds("is 12-35") == kinds("is 12 35") == [0, 1, 1]
    assert kinds("is 3,500.2") == kinds("is twenty-five") == kinds("is 5 million") == [0, 1]
    a, b, c = (decontaminate.template(pa.array([t])).words for t in ("is 3.5", "is 3.7", "is 3.5"))
    assert a[1] != b[1] and a[1] == c[1]


def test_templates():
    import pyarrow as pa

    t = decontaminate.template(pa.array(["In Paris, Bob has 3,500.2 kg; 5km on, twenty feet.", None, ""]))
    assert t.kinds.tolist() == [0, 3, 3, 0, 1, 2, 1, 2, 0, 1, 2] and t.rows.tolist() == [0, 11, 11, 11]


# --- 6: language model -------------------------------------------------------------------------


@pytest.mark.parametrize("head", [250_000, 20])
def test_scores(spark, monkeypatch, head):
    monkeypatch.setattr(recurrent, "HEAD", head)
    rows = [(i, prose(i % 3, 40, 80)) for i in range(60)] + [(100, None), (101, ""), (102, "unseenword é ZZ zz"), (103, prose(1, 2500, 80)), (5, prose(2, 40, 80))]
    frame = docs_of(spark, rows)
    model, counts = recurrent.fit(frame.where(~recurrent.held_out()))
    got = recurrent.score(frame, model, counts).withColumn("held", recurrent.held_out()).collect()
    assert len(got) == len(rows)
    seen = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            seen.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(seen.values()), len(seen)
    want = collections.defaultdict(list)
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b""]
        want[i].append((len(w), sum(seen[x] > 0 for x in w), n, round(sum(math.log10((seen[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
    have = collections.defaultdict(list)
    for r in got:
        have[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)))
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) and r["score"] < 0
    assert {k: sorted(x) for k, x in have.items()} == {k: sorted(x) for k, x in want.items()}
    assert recurrent.score(frame.limit(0), model, counts).count() == 0


@pytest.mark.parametrize("shard", [1_500_000, 800])
def test_network_learns_from_every_training_document(spark, monkeypatch, shard):
    monkeypatch.setattr(recurrent, "SHARD", shard)
    rows = [(i, f"a{i} b{i} " * 300 + f"end{i}") for i in range(30)]
    frame = docs_of(spark, rows).coalesce(1)
    model, _ = recurrent.fit(frame.where(~recurrent.held_out()))
    moved = (model.network.parts["embed"] != recurrent.Network.fresh().parts["embed"]).any(axis=1)  # only inputs that were learned from move
    for i, _ in rows:
        if zlib.crc32(str(i).encode()) % 10:
            assert all(moved[model.numbers[w.encode()]] for w in (f"a{i}", f"b{i}", f"end{i}"))
    again, _ = recurrent.fit(frame.repartition(5).where(~recurrent.held_out()))
    assert (again.network.vector == model.network.vector).all()  # rows may lie in any partitions
    net, end = recurrent.Network.fresh(), np.zeros(recurrent.WINDOW * 3 + 2, dtype=np.int64)
    assert net.train([(end, end)]) == len(end)


def test_network_gains_over_the_counts_on_held_out_documents(spark):
    rng = random.Random(2)
    follows = {f"w{k}": [f"w{rng.randrange(40)}" for _ in range(2)] for k in range(40)}

    def text():
        words = [f"w{rng.randrange(40)}"]
        while len(words) < 200:
            words.append(rng.choice(follows[words[-1]]))
        return " ".join(words)

    frame = docs_of(spark, [(i, text()) for i in range(600)])
    model, counts = recurrent.fit(frame.where(~recurrent.held_out()))
    r = recurrent.score(frame, model, counts).where(recurrent.held_out()).groupBy().sum("score", "base_score").first()
    assert r[0] > 0.6 * r[1]  # half of the bits or more would be gained by knowing both followers of each word


@pytest.mark.parametrize("head", [250_000, 20])
def test_texts_taken_apart_once_score_as_by_fit_and_score(spark, monkeypatch, head):
    monkeypatch.setattr(recurrent, "HEAD", head)
    frame = docs_of(spark, [(i, prose(i % 7, 60, 80)) for i in range(50)] + [(90, None), (91, ""), (92, "unseenword é ZZ zz zz"), (3, prose(1, 1700, 80))])
    model, counts = recurrent.fit(frame.where(~recurrent.held_out()))
    want = recurrent.score(frame, model, counts)
    got = recurrent.fit_and_score(frame, ~recurrent.held_out())
    assert got.columns == want.columns
    rows = [sorted(map(tuple, x.collect())) for x in (got, want)]
    assert [r[:4] for r in rows[0]] == [r[:4] for r in rows[1]]
    assert np.allclose([r[4:] for r in rows[0]], [r[4:] for r in rows[1]], rtol=1e-6)


def test_stretches_are_summed_and_high_scores_are_cut():
    rng = np.random.default_rng(4)
    values = np.sort(np.concatenate([rng.integers(0, 60, 300), np.full(90, 7), [61]]))
    rows, order = rng.normal(size=(3, len(values), 5)), rng.permutation(len(values))
    heads, n = recurrent._stretches(values)
    assert n.sum() == len(values) and n[0] > recurrent.MANY > n[-1]
    for k, v in enumerate(values[heads]):
        assert np.allclose(recurrent._sums(rows, heads, n, order)[:, k], rows[:, order[values == v]].sum(axis=1))
    net = recurrent.Network(recurrent.Network.fresh(6).vector.astype(np.float64))
    net.parts["class_w"] *= 40
    net.parts["word_w"] *= 40
    p, states, y = net.parts, rng.uniform(-1, 1, (50, recurrent.HIDDEN)), rng.integers(0, recurrent.VOCABULARY, 50)
    want = []
    for h, t in zip(states, y, strict=True):
        c, k = divmod(int(t), recurrent.PER_CLASS)
        for e, own in ((h @ p["class_w"] + p["class_b"], c), (h @ p["word_w"][c] + p["word_b"][c], k)):
            e = np.minimum(e, recurrent.HIGHEST)
            want.append(e[own] - np.log(np.exp(e).sum()))
    assert np.allclose(net.log_probs(states, y)[0], np.reshape(want, (-1, 2)).sum(axis=1))


def test_nothing_to_learn_from(spark):
    frame = docs_of(spark, [(1, "a b")])
    model, counts = recurrent.fit(frame.limit(0))
    r = recurrent.score(frame, model, counts).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and abs(r["base_score"]) < 1e-9


def test_probabilities_sum_to_one_and_state_is_carried():
    net = recurrent.Network.fresh(3)
    states, _ = net.forward(np.array([[2], [5]]), np.zeros((1, recurrent.HIDDEN), dtype=np.float32))
    every = np.arange(recurrent.VOCABULARY)
    ln, _ = net.log_probs(np.repeat(states[1], recurrent.VOCABULARY, axis=0), every)
    assert abs(np.exp(ln.astype(np.float64)).sum() - 1) < 1e-4
    rng = np.random.default_rng(0)
    xs = [rng.integers(0, 900, n) for n in (150, 3, 60)]
    together = recurrent._window_scores(net, xs, xs)
    alone = np.concatenate([net.log_probs(net.forward(x[:, None], np.zeros((1, recurrent.HIDDEN), dtype=np.float32))[0][:, 0], x)[0] for x in xs])
    assert np.allclose(together, alone, atol=1e-4)


def test_gradients_equal_finite_differences():
    net = recurrent.Network(recurrent.Network.fresh(2).vector.astype(np.float64))
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 900, (7, 5)), rng.integers(0, 900, (7, 5))
    keep = np.ones((7, 5))
    keep[0], keep[3, 1], keep[5, 4] = 0, 0, 0
    start = rng.normal(size=(5, recurrent.HIDDEN))
    loss = lambda: net.gradients(x, y, start, keep, np.zeros_like(net.vector))[0]
    flat = np.zeros_like(net.vector)
    net.gradients(x, y, start, keep, flat)
    names, at = recurrent.Network.split(np.arange(len(flat))), []
    for name, places in names.items():
        used = np.flatnonzero(flat[places.ravel()])
        assert len(used), name
        at += places.ravel()[rng.choice(used, 8)].tolist()
    for k in at:
        was = net.vector[k]
        net.vector[k] = was + 1e-5
        up = loss()
        net.vector[k] = was - 1e-5
        down = loss()
        net.vector[k] = was
        assert abs((up - down) / 2e-5 - flat[k]) < 1e-5 + 1e-4 * abs(flat[k])


def test_state_starts_anew_with_each_document():
    net = recurrent.Network.fresh(5)
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 900, 9), rng.integers(0, 900, 11)
    keep = np.ones((20, 1), dtype=np.float32)
    keep[[0, 9]] = 0
    zero = np.zeros((1, recurrent.HIDDEN), dtype=np.float32)
    together = net.forward(np.concatenate([a, b])[:, None], zero, None, keep)[0].copy()
    assert np.allclose(together[9:], net.forward(b[:, None], zero)[0], atol=1e-6)


# --- 7: archives -------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    import pyarrow.fs
    import struct

    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a/\r\nb", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "u", None), (6, "u", ""), (9, "u", big), (9, "u", big), (None, "n", big)] + [(100 + i, f"http://x/{i}", prose(i, 300)) for i in range(60)]
    pages = spark.createDataFrame([(u, i, h, 0) for i, u, h in rows], "url string, page_id long, html string, refers_to long")
    got = warc.archive_pages(pages, f"file://{tmp_path}/w").collect()
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        again = len(body) >= 1000 and h == big and i != 9
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    store, path = pyarrow.fs.FileSystem.from_uri(got[0]["archive"])
    head = store.open_input_stream(path).read(8)
    assert struct.unpack("<II", head)[0] == warc.DICTIONARY_MAGIC
    assert warc.archive_pages(pages.limit(0)).count() == 0


# --- 8: languages ------------------------------------------------------------------------------


def test_languages(spark):
    rng = random.Random(1)
    words = {"xx": "the and of with that from this have".split(), "yy": "der und mit nicht eine ist auch für".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(["xx", "yy"] * 60)]
    frame = spark.createDataFrame([(t, i, k, 9.0) for i, t, k in rows] + [(None, 900, "xx", 1.0), ("123 !!", 901, "xx", 1.0), ("", 902, None, 1.0), ("und mit der " * 9000, 903, None, 1.0)], "text string, doc_id long, lang string, score double")
    model = language.fit(frame.where(~language.held_out()))
    got = {r["doc_id"]: r for r in language.predict(frame, model).collect()}
    assert all(got[i]["lang_pred"] == k and 0 <= got[i]["score"] <= 1 for i, _, k in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "yy"]
    assert language.predict(frame.limit(0), model).count() == 0
    assert language.predict(frame, language.fit(frame.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_languages_match_brute_force(spark):
    """The kernels, the ridge regression and the predictions once more, by sets and by the whole kernel matrix of landmarks."""
    rng = random.Random(7)
    words = {"aa": "alpha étude Ωmega свет 日本".split(), "bb": "Betta ÉCOLE ωmikron СВЕТ 中文".split(), "cc": "gamma delta épée тень 語".split()}
    rows = [(i, " ".join(rng.choice(words[k]) + rng.choice(["", "!", " 12", "😀"]) for _ in range(rng.randint(1, 40))), k) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    frame = spark.createDataFrame([(t, i, k) for i, t, k in rows], "text string, doc_id long, lang string").repartition(5)
    train = frame.where(~language.held_out())
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(frame, language.fit(train)).collect()}

    def grams(text):
        low = [c if ord(c) < 0x10000 or not 0x1F000 <= ord(c) < 0x20000 else " " for c in text]
        low = [c.lower()[0] if language.unicodedata.category(c)[0] in "LM" else " " for c in low] + [" "]
        out = set()
        for n in (1, 2, 3):
            for k in range(len(low) - n + 1):
                key = 0
                for c in low[k : k + n]:
                    key = (key * 0x110000 + ord(c)) % 2**64
                out.add(((key * int(language.MIX_1) + n) % 2**64 * 0x9E3779B97F4A7C15 % 2**64) >> 50)
        return out

    order = {r["doc_id"]: r["at"] for r in frame.selectExpr("doc_id", "xxhash64(doc_id) AS at").collect()}
    fit_on = sorted((k, order[i], grams(t)) for i, t, k in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    names = sorted(words)
    marks = [g for k in names for g in sorted((g for n, _, g in fit_on if n == k), key=lambda g: -len(g))[: language.LANDMARKS]]
    kernel = lambda g, h: len(g & h) / math.sqrt(len(g) * len(h))
    k_nm = np.array([[kernel(g, m) for m in marks] for _, _, g in fit_on])
    k_mm = np.array([[kernel(g, m) for m in marks] for g in marks])
    y = np.array([[1.0 if k == n else -1.0 for n in names] for k, _, _ in fit_on])
    each = np.array([1 / sum(k == n for n, _, _ in fit_on) for k, _, _ in fit_on])[:, None]
    weights = np.linalg.lstsq(k_nm.T @ (k_nm * each) + language.RIDGE * k_mm + 1e-9 * np.eye(len(marks)), k_nm.T @ (y * each), rcond=None)[0]
    for i, t, _ in rows:
        f = np.array([kernel(grams(t), m) for m in marks]) @ weights
        best = int(f.argmax())
        assert got[i][0] == names[best] or np.sort(f)[-1] - np.sort(f)[-2] < 1e-3
        assert abs(got[i][1] - min(max((f[best] + 1) / 2, 0), 1)) < 5e-3


# --- 9: top-k ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("block", "share"), [(1 << 20, 1 << 20), (600, 4000)])
def test_topk(spark, block, share):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)]
    vectors += [(i, vectors[0][1]) for i in (450, 451)] + [(500, None), (501, [1.0] * 15 + [float("nan")]), (502, [1.0] * 15 + [None]), (503, []), (600, []), (650, []), (550, [1.0, 2.0]), (551, [3.0, 1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(0, v, i) for i, v in vectors], "rank int, embedding array<float>, vec_id long")
    got = sorted(tuple(r) for r in topk.top_k(frame, frame.where("vec_id % 50 = 0"), block_bytes=block, share_bytes=share).collect())
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in fine:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q and len(y) == len(x))[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


# --- 10: URLs ----------------------------------------------------------------------------------


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.org", "/fr/x", "block"), ("a.b.org", "/", "allow"), ("", "/", "block")]
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://net", "http://x.net?q", "https://www.Example.net/en/1?x#y", "http://badexample.net/en/", "http://example.com/de/", "http://m.example.com/dex/", "http://a.b.org/fr/xy", "http://c.a.b.org/fr/", "http://z.org/fr/", "http://org/fr/#/", "ftp://.net/x", "http://net./"]
    pages = spark.createDataFrame([(u, i, "h") for i, u in enumerate(urls * 40)], "url string, page_id long, host string")
    frame = spark.createDataFrame(rules, "host string, prefix string, verdict string")

    def judge(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.filter_urls(pages, frame, rows_a_range=50).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls * 40)}
    assert url_rules.filter_urls(pages.limit(0), frame).count() == 0
    assert url_rules.filter_urls(pages, frame.limit(0)).where("verdict <> 'allow' OR rule IS NOT NULL").count() == 0
