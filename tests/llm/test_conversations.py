"""Conversation operators against brute force: nulls, empty texts, ties, repeated rows, empty tables, long conversations, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quarry.llm import repair, trie

CLASH = "turn long, text string, conv_id long, role string, depth int, place string, k1 double, kind string, audit int"
SPACE = r"[\x20\x09-\x0D]"


def frame(spark, rows):
    """(conv_id, turn, role, text) among columns whose names operators use themselves."""
    return spark.createDataFrame([(t, x, c, r, 1, "p", 0.5, "k", 3) for c, t, r, x in rows], CLASH)


def made(seed, conversations=60, most=9):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Is it so?", "a b  c", "", None, "  ", "cut off", "Long answer. With two.\t", "über alles.", "x" * 3000 + "."]
    for c in range(conversations):
        opening = rng.random() < 0.4
        for t in range(rng.randint(0, most)):
            role = "ua"[t % 2] if rng.random() < 0.85 else rng.choice(["system", "user", "assistant", "tool", "", None, "System"])
            role = {"u": "user", "a": "assistant"}.get(role, role)
            turn = t if rng.random() < 0.9 else rng.choice([None, t + 5, t - 1])
            rows.append((c, turn, role, "Hello there." if opening and t < 2 else rng.choice(texts)))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    for t in range(4):  # equal conversations, an opening of others, and of one turn
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for c in (100, 101, 102, 121, 122, 140) if t < (2 if c == 140 else 4)]
    rows += [(-7, 0, "user", "negative"), (-20, 0, "system", "base of it"), (1001, 0, "user", "its block has no first")]
    return rows


def least(rows):
    return [(c, t, r, x) for c, t, r, x in sorted(rows, key=lambda y: (y[1] is not None, y[1] or 0, y[2], y[3]))]


# --- 12: prefix trie -----------------------------------------------------------------------------


def brute_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((c, t, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in least(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        full[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, s in full.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = lambda q: sum(len(z) == len(q) + 1 and z[: len(q)] == q for z in nodes)
        saved = sum((len(nodes[q]) - 1) * len(re.findall(rf"[^{SPACE[1:]}+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(p))))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children(p), sum(not children(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_brute_force(spark, seed):
    rows = [*made(seed), (None, 0, "user", "of none"), (200, 3, "user", "a tie"), (200, 3, "user", "A tie"), (200, 3, "assistant", "a tie")]
    got = trie.trie(trie.rebuilt(trie.signed(trie.ordered(frame(spark, rows))))).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_trie(rows)


def test_trie_of_nothing_and_of_a_long_conversation(spark):
    empty = frame(spark, []).limit(0)
    assert trie.trie(trie.rebuilt(trie.signed(trie.ordered(empty)))).count() == 0
    rows = [(60, t, "user", f"word {t}") for t in range(700)] + [(c, 0, "user", "same") for c in range(2001, 2400)]
    got = {(r["conv_id"], r["depth"]): r for r in trie.trie(trie.rebuilt(trie.signed(trie.ordered(frame(spark, rows))))).collect()}
    assert got[60, 700]["n_leaves"] == 1 and got[60, 350]["n_convs"] == 1 and got[60, 0]["n_convs"] == 400
    assert len(got) == 702 and got[60, 0]["ends_sha256"] != hashlib.sha256(b"").hexdigest()  # some lose their only turn


def test_nodes_have_their_turns(spark):
    rows = made(3, 20)
    turns = trie.rebuilt(trie.ordered(frame(spark, rows)))
    nodes = trie.trie(trie.rebuilt(trie.signed(trie.ordered(frame(spark, rows)))))
    found = trie.node_turns(nodes, turns).collect()
    assert len(found) == nodes.count() and all((r["text"] is None) == (r["depth"] == 0) for r in found)


def test_ends_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "PART", 50)
    ends = spark.createDataFrame([(1, 5, 6, c) for c in range(-40, 900)] + [(2, 5, 6, 3), (1, 5, 7, 9)], "depth long, k1 long, k2 long, conv_id long")
    got = {(r["depth"], r["k2"]): r["ends_sha256"] for r in trie.end_digests(ends).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 6): sha(range(-40, 900)), (2, 6): sha([3]), (1, 7): sha([9])}


# --- 13: structure repair ------------------------------------------------------------------------


def every_edit(turns):
    """The cheapest, then least audit over all edit strings."""
    best = [(3 * len(turns), "D" * len(turns))]

    def go(i, out, audit, cost):
        if cost > best[0][0]:
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", out):
            best[0] = min(best[0], (cost, audit))
        if i < len(turns):
            go(i + 1, out, audit + "D", cost + 3)
            if turns[i] != "x":
                low, cut = turns[i].lower(), turns[i] != turns[i].lower()
                go(i + 1, out + low, audit + "K", cost + cut)
                for r in "ua":
                    go(i + 1, out + r, audit + "R", cost + 2 + cut)
        if len(out) < 2 * len(turns) + 3:
            for r in "ua":
                go(i, out + r, audit + "I", cost + 2)

    go(0, "", "", 0)
    return best[0]


def test_alignment_is_the_cheapest_and_least_of_all_edits():
    rng = random.Random(5)
    for turns in ["", "x", "s", "a", "u", "xsx", "ss", "oo", "Oxa", *["".join(rng.choice("suaoSUAOxuaua") for _ in range(rng.randint(1, 5))) for _ in range(250)]]:
        assert repair.align(turns) == every_edit(turns), turns


def test_wrapping_table_gives_what_lengths_give():
    rng = random.Random(6)
    for _ in range(1500):
        turns = "".join(rng.choice("suaoSUAOuauauaua") for _ in range(rng.randint(0, 40)))
        assert repair._by_lengths(turns) == repair._wrapped(turns), turns
    clean = "".join("ua"[k % 2] for k in range(4000) if k % 19)
    cost, audit = repair.align(clean)
    assert cost == repair._wrapped(clean)[0] and audit.count("K") + audit.count("R") + audit.count("D") == len(clean)


def brute_damage(rows):
    out = []
    for c, t, r, x in rows:
        key = ":".join(" " if v is None else str(v) for v in (c, t))
        r, x, n = " " if r is None else r, " " if x is None else x, zlib.crc32(key.encode()) % 20
        if n == 1:
            x = ""
        elif n == 2:
            x = re.sub("[.!?]", "", x)
        elif n == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if n == 0 else 2 if n == 3 else 1)
    return out


def brute_repair(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = least([r for r in brute_damage(rows) if r[0] == c])
        numbers = [t for _, t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        codes, seen, faults = "", set(), {"x": 0, "d": 0, "t": 0}
        for _, _, r, x in turns:
            end = re.sub(rf"{SPACE}+\Z", "", x)[-1:]
            code = r[:1] if r[:1] in ("s", "u", "a") else "o"
            if not end:
                faults["x"] += 1
                code = "x"
            elif (r, x) in seen:
                faults["d"] += 1
                code = "x"
            elif end not in ".!?":
                faults["t"] += 1
                code = code.upper()
            seen.add((r, x))
            codes += code
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = repair.align(codes)
        assert len(codes) > 4 or (cost, audit) == every_edit(codes)
        lines, left, last = [], iter(turns), ""
        for edit in audit:
            row = next(left) if edit != "I" else (c, 0, None, "")
            if edit != "D":
                role = row[2] if edit == "K" else "assistant" if last == "u" else "user"
                last = role[:1]
                lines.append(f"{role}:{row[3]}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines)) and next(left, None) is None
        out[c] = (gaps, faults["x"], faults["d"], faults["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(spark, rows):
    conversations = frame(spark, rows)
    turns = repair.damaged(conversations)
    return repair.repair_report(conversations, turns, repair.audits(turns))


def test_repair_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repair, "PART", 3)  # audits travel in parts
    rows = [*made(7), (None, None, None, None), (None, 1, "user", "of none."), (300, 1, "user", "tie."), (300, 1, "assistant", "tie."), (300, 1, "assistant", "another")]
    rows += [(400, t, "ua"[t % 2], f"turn {t}.") for t in range(300)] + [(c, 0, "user", "one turn") for c in range(500, 560)]  # some of these lose all turns
    got = {r["conv_id"]: tuple(r)[1:] for r in report(spark, rows).collect()}
    want = brute_repair(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and set(got) == set(want)
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in got.values())
    assert report(spark, rows).columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repaired_turns_alternate(spark):
    rows = made(8, 30)
    turns = repair.damaged(frame(spark, rows))
    out = {}
    for r in repair.repaired(turns, repair.audits(turns)).collect():
        out.setdefault(r["conv_id"], []).append((r["place"], r["role"]))
    for found in out.values():
        found = sorted(found)
        assert [p for p, _ in found] == (list(range(1, len(found) + 1)) if found != [(0, None)] else [0])
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r in found if r))
    empty = frame(spark, []).limit(0)
    assert repair.repair_report(empty, repair.damaged(empty), repair.audits(repair.damaged(empty))).count() == 0
