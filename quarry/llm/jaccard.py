"""N-gram Jaccard join: prefix filters under several token orders, then exact verification.

Two sets that are similar enough share a token among the first few of either, under any total
order of all tokens. Orders here go from rare to frequent classes of tokens (a sketch of fixed
size counts them over all documents) and by different hashes within a class. Candidates come
from the first order; size, position and parity-sketch bounds, none of which loses a pair,
thin them; a candidate must also share prefix tokens under each further order; what is left
is verified on the whole sets. Equal sets are one class from the start.

Only connections are asked for. Documents that candidates connect are a family; a token with
more than HOT holders makes them one family without looking at pairs. The sets of a family meet
in one task, if they have at most FAMILY_BYTES. Those of larger families are dealt to tasks of
that size by hash, anew in each of a few rounds, which connects nearly all that belongs together;
at the end, holders of one token that are still apart meet chunk by chunk, and each pair of them
that no bound excludes is verified. No task keeps all holders of a token, or a large family, in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import mix64, slices, staged, word_hashes
from quarry.llm.components import components

#: Words of a shingle; similarity in hundredths; counters of the frequency sketch; different token orders.
WORDS, HUNDREDTHS, COUNTERS, ORDERS = 3, 90, 1 << 20, 3
CHUNK = 1 << 16
#: Words (of 64 bits) of the parity sketch of sets of up to so many tokens at 0.9, fewer at lower similarities; larger ones have the last.
SKETCHES = ((900, 4), (4000, 16), (0, 64))
#: Ids that a broadcast join takes at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Holders of a token from which they are one family; holders that are compared at once, and that a chunk has about.
HOT, BLOCK = 1024, 512
#: Bytes of the sets of a family that meet as a whole at most, and of a part, families or a share of one, about; rounds in which larger families are dealt to parts.
FAMILY_BYTES, PART_BYTES, ROUNDS = 8 << 20, 2 << 20, 3
#: About how many documents of a component take part in the rounds after the first.
SENT = 64
#: Documents of a component that a new one is compared with first.
FEW = 64
#: Pairs of two components that are verified before all others of them.
FIRST = 4
#: From here on stand-ins for ids that are repeated with other texts.
STAND_IN = 1 << 62
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix64(np.arange(11, 11 + ORDERS, dtype=np.uint64))


def shingle_sets(values: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; fewer words are one shingle, no words none."""
    hashes, rows = word_hashes(values)
    n = len(hashes)
    length = np.diff(rows)
    row = np.repeat(np.arange(len(length)), length)
    width = np.minimum(rows[row + 1] - np.arange(n), words) if n else np.zeros(0, dtype=np.int64)
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        inside = np.flatnonzero(width > k)
        keys[inside] = (keys[inside] + hashes[inside + k]) * _STEP
    keys = mix64(keys ^ width.astype(np.uint64))
    keep = (width == words) | (np.arange(n) == rows[row]) if n else np.zeros(0, dtype=bool)
    keys, row = keys[keep], row[keep]
    ends = np.searchsorted(row, np.arange(len(length) + 1))
    return [np.unique(keys[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64) & (COUNTERS - 1)


def frequency_classes(texts: DataFrame, words: int) -> np.ndarray:
    """For every counter of the sketch, the binary logarithm of its count of (document, shingle) pairs, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, dtype=np.int64)
        for part in slices(batches, "text"):
            sets = [s for s in shingle_sets(part.column(part.schema.get_field_index("text")), words) if len(s)]
            if sets:
                seen += np.bincount(_slot(np.concatenate(sets)), minlength=COUNTERS)
        for n in range(COUNTERS // CHUNK):
            own = seen[n * CHUNK : (n + 1) * CHUNK]
            used = np.flatnonzero(own)
            if len(used):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([n], pa.int32()), "at": pa.array([used.astype(np.uint16).tobytes()], pa.binary()), "n": pa.array([own[used].astype(np.uint32).tobytes()], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, dtype=np.int64)
        for at, n in zip(rows.column("at"), rows.column("n"), strict=True):
            total[np.frombuffer(at.as_py(), dtype=np.uint16)] += np.frombuffer(n.as_py(), dtype=np.uint32)
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "classes": pa.array([np.frexp(total)[1].astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros(COUNTERS, dtype=np.uint8)
    for r in texts.mapInArrow(count, "chunk int, at binary, n binary").groupBy("chunk").applyInArrow(add, "chunk int, classes binary").collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["classes"]), dtype=np.uint8)
    return out


def prefix_size(n: int, hundredths: int = HUNDREDTHS) -> int:
    return n - -(-n * hundredths // 100) + 1


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, hundredths: int) -> np.ndarray:
    """The first tokens of a set under an order of all tokens: rare classes first, by a hash within a class."""
    rank = (classes[_slot(tokens)].astype(np.uint64) << np.uint64(56)) | (mix64(tokens ^ _SEEDS[order]) >> np.uint64(8))
    n = prefix_size(len(tokens), hundredths)
    first = np.argpartition(rank, n - 1)[:n] if n < len(tokens) else np.arange(len(tokens))
    return tokens[first[np.argsort(rank[first], kind="stable")]]


def _parity(tokens: np.ndarray, hundredths: int) -> bytes:
    """Bits that say whether an odd number of tokens falls on them: two sets differ in as many tokens at least as bits.

    At most half of the bits differ, and linked sets may differ in (100 - h) / (100 + h) of their tokens: lower similarities need more bits.
    """
    like = len(tokens) * (100 - hundredths) * 190 / ((100 + hundredths) * 10)
    bits = 64 * next(words for most, words in SKETCHES if like <= most or not most)
    odd = np.bincount(((tokens * _STEP) >> np.uint64(48)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sketches(parity: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each width, narrow to wide: (place of each set among those that have that width or more, or -1; their sketches folded to it)."""
    sizes = np.array([len(x) for x in parity])
    out = []
    for _, words in SKETCHES:
        place = np.full(len(parity), -1, dtype=np.int64)
        own = np.flatnonzero(sizes >= 8 * words)
        place[own] = np.arange(len(own))
        folded = np.zeros((len(own), words), dtype=np.uint64)
        for size in np.unique(sizes[own]).tolist():
            rows = np.flatnonzero(sizes[own] == size)
            folded[rows] = np.bitwise_xor.reduce(np.frombuffer(b"".join([parity[i] for i in own[rows].tolist()]), dtype=np.uint64).reshape(len(rows), size // (8 * words), words), axis=1)
        out.append((place, folded))
    return out


def _apart(sketches: list[tuple[np.ndarray, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Tokens in which sets differ at least, by the widest sketch that both have."""
    out = np.zeros(len(i), dtype=np.int64)
    for place, folded in sketches:
        both = np.flatnonzero((place[i] >= 0) & (place[j] >= 0))
        out[both] = np.maximum(out[both], np.bitwise_count(folded[place[i[both]]] ^ folded[place[j[both]]]).sum(axis=1, dtype=np.int64))
    return out


def signatures(texts: DataFrame, classes, words: int, hundredths: int) -> DataFrame:
    """(id, n_shingles, f1, f2, tokens, parity) of each text: size and fingerprint of its set, prefix under the first order, parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = classes.value
        for part in slices(batches, "text"):
            rows = []
            for s in shingle_sets(part.column(1), words):
                if len(s):
                    f1, f2 = (int(np.bitwise_xor.reduce(mix64(s * _STEP + seed)).astype(np.int64)) for seed in _SEEDS[:2])
                    rows.append((len(s), f1, f2, prefix(s, known, 0, hundredths).view(np.int64), _parity(s, hundredths)))
                else:
                    rows.append((0, 0, 0, np.zeros(0, dtype=np.int64), b""))
            n, f1, f2, tokens, parity = zip(*rows, strict=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)), pa.array(np.concatenate(tokens)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists, pa.array(parity, pa.binary())], names=["id", "n_shingles", "f1", "f2", "tokens", "parity"])

    return texts.mapInArrow(run, "id long, n_shingles long, f1 long, f2 long, tokens array<long>, parity binary")


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places i < j within consecutive groups of the given sizes."""
    starts = np.cumsum(sizes) - sizes
    end = np.repeat(starts + sizes, sizes)
    i = np.arange(int(sizes.sum()))
    n = end - i - 1
    left = np.repeat(i, n)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)


def _fits(e: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, hundredths: int) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs no bound excludes, differing parity bits of those)."""
    ni, nj, pi, pj = e["n"][i], e["n"][j], e["pos"][i], e["pos"][j]
    both = ni + nj
    need = -(-both * hundredths // (100 + hundredths))  # tokens that the two must share
    # seen from the first token that both prefixes have, all that is shared comes from there on
    fine = (np.minimum(ni, nj) * 100 >= np.maximum(ni, nj) * hundredths) & (np.minimum(ni - pi, nj - pj) >= need) & (e["comp"][i] != e["comp"][j])
    at = np.flatnonzero(fine)
    apart = _apart(e["parity"], i[at], j[at])
    close = apart <= (both - 2 * need)[at]
    return at[close], apart[close]


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (smallest places) after the places i and j are connected too."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _stars(e: dict[str, np.ndarray], groups: np.ndarray, hundredths: int) -> np.ndarray:
    """For every entry of token groups (runs of entries of the given sizes) the first one of its group that candidates connect it with."""
    label = np.arange(len(e["n"]))
    starts = np.cumsum(groups) - groups
    small = groups <= 64
    own = np.flatnonzero(np.repeat(small, groups))
    left, right = _pairs(groups[small])
    for at in range(0, len(left), 1 << 20):
        i, j = own[left[at : at + (1 << 20)]], own[right[at : at + (1 << 20)]]
        ok, _ = _fits(e, i, j, hundredths)
        label = _united(label, i[ok], j[ok])
    for start, size in zip(starts[~small].tolist(), groups[~small].tolist(), strict=True):
        order = start + np.argsort(e["n"][start : start + size], kind="stable")
        n = e["n"][order]
        for a in range(0, size, BLOCK):
            rows = order[a : a + BLOCK]
            reach = int(np.searchsorted(n, n[min(a + BLOCK, size) - 1] * 100 // hundredths + 1, side="right"))
            for b in range(a, reach, BLOCK):
                cols = order[b : min(b + BLOCK, reach)]
                i, j = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
                open_ = label[i] != label[j]
                i, j = i[open_], j[open_]
                ok, _ = _fits(e, i, j, hundredths)
                label = _united(label, i[ok], j[ok])
    return label


def _columns(table: pa.Table, *names: str) -> dict[str, np.ndarray]:
    out = {n: table.column(n).to_numpy() for n in names}
    return out | {"parity": _sketches(table.column("parity").to_pylist())}


def _grouped(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows that hold whole groups, from batches that come sorted by key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1] + 1) if keys[0] != keys[-1] else 0  # the last group may go on
        if cut:
            yield table.slice(0, cut)
        held, size = table.slice(cut).to_batches(), len(keys) - cut
    if size:
        yield pa.Table.from_batches(held)


def _candidates(entries: DataFrame, hundredths: int) -> DataFrame:
    """(a, b) connections between the holders of each token, from entries (token, id, pos, n, parity) of tokens with at most HOT holders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "token", 100_000):
            tokens = table.column("token").to_numpy()
            edges = np.flatnonzero(np.diff(tokens)) + 1
            e = _columns(table, "id", "n", "pos")
            e["comp"] = e["id"]
            label = _stars(e, np.diff(np.concatenate([[0], edges, [len(tokens)]])), hundredths)
            other = np.flatnonzero(label != np.arange(len(label)))
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(e["id"][label[other]]), pa.array(e["id"][other])], names=["a", "b"])

    return entries.repartition("token").sortWithinPartitions("token").mapInArrow(run, "a long, b long").distinct()


def _still_apart(entries: DataFrame, parity: DataFrame, labels: DataFrame, hundredths: int) -> DataFrame:
    """(a, b): pairs of holders of a token that are in different components so far and that no bound excludes.

    The component with most holders of a token is only met with the others: its chunks come first,
    those of the others follow, and each task has the two chunks (or the one) that meet in it.
    """
    own = entries.select("token", "id", F.col("pos").cast("long").alias("pos"), "n").join(labels.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    counts = own.groupBy("token", "comp").agg(F.count("*").alias("n"))
    tokens = counts.groupBy("token").agg(F.count("*").alias("comps"), F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("most")).where("comps > 1")
    chunks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    shaped = tokens.select("token", F.col("most.comp").alias("main"), chunks(F.col("most.n")).alias("g"), chunks(F.col("all") - F.col("most.n")).alias("h"))
    main = F.col("comp") == F.col("main")
    dealt = own.join(shaped, "token").join(parity, "id").withColumn("chunk", F.when(main, F.pmod(F.xxhash64("id"), F.col("g"))).otherwise(F.col("g") + F.pmod(F.xxhash64("id"), F.col("h"))).cast("int"))
    meets = F.explode(F.when(main, F.sequence(F.col("g"), F.col("g") + F.col("h") - 1)).otherwise(F.sequence(F.lit(0), F.col("g") + F.col("h") - 1)))
    met = dealt.withColumn("with", meets).withColumn("task", F.xxhash64("token", F.least("chunk", "with"), F.greatest("chunk", "with")))
    columns = ("task", "token", "chunk", "id", "n", "pos", "comp", "parity")
    together = met.select(*columns[:7], F.least("chunk", "with").alias("low"), "parity").repartition("task").sortWithinPartitions("task", "token", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "task", 50_000):
            e = _columns(table, "task", "token", "chunk", "low", "id", "n", "pos", "comp")
            edges = np.flatnonzero((np.diff(e["task"]) != 0) | (np.diff(e["token"]) != 0) | (np.diff(e["low"]) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(e["id"])], strict=True):
                first = np.flatnonzero(e["chunk"][a:b] == e["low"][a]) + a
                second = np.flatnonzero(e["chunk"][a:b] != e["low"][a]) + a
                second = second if len(second) else first
                for at in range(0, len(first), BLOCK):
                    rows = first[at : at + BLOCK]
                    for to in range(0, len(second), 2 * BLOCK):
                        cols = second[to : to + 2 * BLOCK]
                        i, j = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
                        ok, _ = _fits(e, i, j, hundredths)
                        x, y = e["id"][i[ok]], e["id"][j[ok]]
                        if len(x):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return together.mapInArrow(run, "a long, b long").distinct()


class Prefixes:
    """What makes sets candidates: a token among the first of both, under each order of tokens."""

    def __init__(self, classes, hundredths: int) -> None:
        self.classes, self.hundredths = classes, hundredths

    def keys(self, sets: list[np.ndarray]) -> list[list[int]]:
        """Of each set, the keys of which candidates share one."""
        return [prefix(s, self.classes.value, 0, self.hundredths).tolist() for s in sets]

    def others(self, tokens: np.ndarray) -> list[frozenset[int]]:
        """Further keys of a set; candidates share one in each place."""
        return [frozenset(prefix(tokens, self.classes.value, k, self.hundredths).tolist()) for k in range(1, ORDERS)]


def _verify(pairs: DataFrame, sets: DataFrame, met, hundredths: int) -> DataFrame:
    """(a, b, linked): the further filters are intersected, then whole sets are compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                both = not any(a.isdisjoint(b) for a, b in zip(met.others(x), met.others(y), strict=True))
                shared = len(np.intersect1d(x, y, assume_unique=True)) if both else 0
                linked.append(100 * shared >= hundredths * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    return with_a.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def _packed(texts: DataFrame, words: int, more: list[str]) -> DataFrame:
    """(id, more, tokens): whole sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array([s.tobytes() for s in shingle_sets(part.column(1), words)], pa.binary())], names=["id", *more, "tokens"])

    return texts.mapInArrow(run, ", ".join(["id long", *[f"{c} long" for c in more], "tokens binary"]))


def _sets_of(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Packed sets of the texts of the (written) ids, with whatever other columns (of longs) ids has."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    more = [c for c in ids.columns if c != "id"]
    return _packed(texts.join(ids, "id").select("id", "text", *more), words, more)


def _connected(ids: list[int], comps: list[int], sets: list[np.ndarray], met, hundredths: int) -> list[int]:
    """Components (smallest component so far) of the links among some documents; those of one component count as linked."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    sizes = np.array([len(sets[i]) for i in order])
    parity = _sketches([_parity(sets[i], hundredths) for i in order])
    keys = met.keys([sets[i] for i in order])
    others = [met.others(sets[i]) for i in order]
    parent = {c: c for c in comps}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    def near(j: int, some: list[int]) -> list[tuple[int, int]]:
        """(i, tokens to share) of those of some that no bound keeps apart from j, likely ones first."""
        i = np.array(some, dtype=np.int64)
        both = sizes[i] + sizes[j]
        need = -(-both * hundredths // (100 + hundredths))
        fits = np.flatnonzero(sizes[i] * 100 >= sizes[j] * hundredths)
        apart = _apart(parity, i[fits], np.full(len(fits), j))
        close = apart <= (both - 2 * need)[fits]
        fits = fits[close][np.argsort(apart[close], kind="stable")]
        return list(zip(i[fits].tolist(), need[fits].tolist(), strict=True))

    def linked(i: int, j: int, need: int) -> bool:
        return not any(x.isdisjoint(y) for x, y in zip(others[i], others[j], strict=True)) and len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True)) >= need

    def unite(x: int, y: int) -> None:
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)

    holders: dict[int, dict[int, list[int]]] = {}  # of each key, by component as it was then
    for j in range(len(order)):
        own = comps[order[j]]
        there: dict[int, list[list[int]]] = {}
        for t in keys[j]:
            for c, members in holders.get(t, {}).items():
                there.setdefault(c, []).append(members)
        left: set[int] = set()
        for c, lists in there.items():
            if root(c) == root(own):
                continue
            if len(lists[0]) > FEW:  # of near copies, the last few are enough
                some = lists[0][-FEW:]
                if any(linked(i, j, need) for i, need in near(j, some)):
                    unite(c, own)
                    continue
            left.update(*lists)
        if left:  # all others of all components at once
            for i, need in near(j, list(left)):
                if root(comps[order[i]]) != root(own) and linked(i, j, need):
                    unite(comps[order[i]], own)
        for t in keys[j]:
            holders.setdefault(t, {}).setdefault(root(own), []).append(j)
    return [root(c) for c in comps]


def _within(texts: DataFrame, members: DataFrame, met, words: int, hundredths: int) -> DataFrame:
    """(node, component) of members (node, part, component), written: the sets of a part meet in one task."""

    def run(table: pa.Table) -> pa.Table:
        ids, packed = table.column("id").to_pylist(), table.column("tokens")
        own = {i: k for k, i in enumerate(ids)}  # rows that repeat an id are one document
        comps = [table.column("component")[k].as_py() for k in own.values()]
        sets = [np.frombuffer(packed[k].as_buffer(), dtype=np.uint64) for k in own.values()]
        return pa.table({"node": pa.array(list(own), pa.int64()), "component": pa.array(_connected(list(own), comps, sets, met, hundredths), pa.int64())})

    sets = _sets_of(texts, members.select(F.col("node").alias("id"), "part", "component"), words)
    return sets.groupBy("part").applyInArrow(run, "node long, component long")


def _settled(entries: DataFrame, parity: DataFrame, far: DataFrame, texts: DataFrame, met, words: int, hundredths: int) -> DataFrame:
    """(node, component) of families of any size, far (node, family, bytes): rounds by hash, then what is still apart.

    In the first round all documents take part; in further ones, those of families that are still in
    several components, each of which sends about SENT. Where most documents of a family are still alone, they
    take no part again, since a further round would send nearly all sets to find little. What rounds miss is found
    at the end: a few pairs of every two components first, then all of components that are still apart.
    """
    labels = far.select("node", F.col("node").alias("component"))
    for n in range(ROUNDS):
        now = far.join(labels, "node")
        if n:
            sizes = now.groupBy("family", "component").agg(F.count("*").alias("size"))
            alone = F.count(F.when(F.col("size") == 1, 1))
            apart = sizes.groupBy("family").agg(F.count("*").alias("comps"), (2 * alone <= F.sum("size")).alias("all")).where("comps > 1").select("family", "all")
            sent = F.pmod(F.xxhash64("node", F.lit(-n)), F.ceil(F.col("size") / SENT)) == 0
            now = now.join(sizes.join(apart, "family"), ["family", "component"]).where(sent & (F.col("all") | (F.col("size") > 1))).drop("size", "all")
        now = staged(now, "sent")
        parts = now.groupBy("family").agg(F.ceil(F.sum("bytes") / PART_BYTES).cast("long").alias("parts"))
        part = F.xxhash64("family", F.pmod(F.xxhash64("node", F.lit(n)), F.col("parts")))
        members = staged(now.join(parts, "family").select("node", part.alias("part"), "component"), "members")
        if members.isEmpty():
            break
        found = staged(_within(texts, members, met, words, hundredths), "found")
        if not n:  # each document was a component and in one part
            labels = found
            continue
        # a part says which components belong together; components of those are the new ones
        moved = found.join(members.select("node", F.col("component").alias("was")), "node").where("component <> was").select(F.col("was").alias("a"), F.col("component").alias("b")).distinct()
        labels = _relabelled(labels, staged(moved, "moved"))
    pairs = staged(_still_apart(entries, parity, labels, hundredths), "apart")
    for most in (FIRST, None):
        if pairs.isEmpty():
            break
        now = _between(pairs, labels)
        if most:
            two = Window.partitionBy(F.least("ca", "cb"), F.greatest("ca", "cb")).orderBy(F.xxhash64("a", "b"), "a", "b")
            now = now.withColumn("rank", F.row_number().over(two)).where(F.col("rank") <= most)
        tried = staged(now.select("a", "b"), "tried")
        ids = tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id"))).distinct()
        sets = staged(_sets_of(texts, staged(ids, "ids"), words).dropDuplicates(["id"]), "sets")
        links = staged(_verify(tried, sets, met, hundredths).where("linked").select("a", "b"), "links")
        labels = _relabelled(labels, staged(_between(links, labels).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "moved"))
        if most:
            pairs = staged(_between(pairs.join(tried, ["a", "b"], "left_anti"), labels).select("a", "b"), "apart")
    return labels


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, ca, cb): pairs (a, b) of documents of different components ca and cb."""
    both = pairs.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    return both.select("a", "b", "ca", "cb").where("ca <> cb")


def _relabelled(labels: DataFrame, together: DataFrame) -> DataFrame:
    """labels after the components a and b of together are one."""
    if together.isEmpty():
        return labels
    new = components(together).select(F.col("node").alias("component"), F.col("component").alias("now"))
    return staged(labels.join(new, "component", "left").select("node", F.coalesce("now", "component").alias("component")), "labels")


def connected_classes(texts: DataFrame, groups: DataFrame, pairs: DataFrame, entries: Callable[[DataFrame], DataFrame], met, words: int, hundredths: int) -> DataFrame | None:
    """(node, component) of all classes, groups (rep, n_shingles, parity), that the (written) candidate pairs (a, b) connect; None without pairs.

    entries gives (token, id, pos, n, parity) for the classes of a DataFrame (id): by which keys they meet.
    """
    if pairs.isEmpty():
        return None
    families = components(pairs).select("node", F.col("component").alias("family"))  # all that candidates connect; links never leave a family
    sized = staged(families.join(groups.select(F.col("rep").alias("node"), (8 * F.col("n_shingles")).alias("bytes")), "node"), "families")
    total = sized.groupBy("family").agg(F.sum("bytes").alias("total"))
    large = staged(total.where(F.col("total") > FAMILY_BYTES).select("family"), "large")
    small = sized.join(large, "family", "left_anti")
    parts = max(texts.sparkSession.sparkContext.defaultParallelism * 4, -(-int(small.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // PART_BYTES))
    dealt = small.select("node", F.pmod(F.xxhash64("family"), F.lit(parts)).alias("part"), F.col("node").alias("component"))
    labels = _within(texts, staged(dealt, "small"), met, words, hundredths)
    if not large.isEmpty():
        far = staged(sized.join(large, "family").select("node", "family", "bytes"), "far")
        labels = labels.unionByName(_settled(entries(far.select(F.col("node").alias("id"))), groups.select(F.col("rep").alias("id"), "parity"), far, texts, met, words, hundredths))
    return staged(labels, "labels")


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, text in bytes) of all rows, and where rows repeat an id with another text, stand-ins for ids and (id, real) of those.

    A stand-in is above STAND_IN, and the same for rows that agree in id and text.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    hashed = F.xxhash64("text")
    repeated = staged(texts.where("id IS NOT NULL").groupBy("id").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b")).where("a <> b").select("id"), "repeated")
    if repeated.isEmpty():
        return texts, None
    stand_in = F.lit(STAND_IN) + F.pmod(F.xxhash64("id", "text"), F.lit(STAND_IN >> 1))
    marked = texts.join(repeated.withColumn("again", F.lit(True)), "id", "left")
    names = marked.where("again").select(stand_in.alias("id"), F.col("id").alias("real")).distinct()
    return marked.select(F.when(F.col("again"), stand_in).otherwise(F.col("id")).alias("id"), "text"), staged(names, "names")


def of_documents(signed: DataFrame, groups: DataFrame, labels: DataFrame | None, names: DataFrame | None, id_col: str) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row of signed; rows that share an id are one document, whatever their texts."""
    own = signed.where("n_shingles > 0 AND id IS NOT NULL")
    member = own.join(groups.select("f1", "f2", "n_shingles", "rep"), ["f1", "f2", "n_shingles"]).select("id", "rep").distinct()
    if labels is not None:
        member = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    found = signed.select("id", "n_shingles").join(member.select("id", F.col("rep").alias("component")), "id", "left").withColumn("component", F.coalesce("component", "id"))
    if names is not None:
        found = staged(found.join(names, "id", "left").select(F.coalesce("real", "id").alias("id"), "n_shingles", "component"), "named")
        classes = found.where("id IS NOT NULL").select("id", "component").distinct()
        least = staged(classes.groupBy("component").agg(F.min("id").alias("least")), "least")
        nodes = classes.join(least, "component").select("id", "least").distinct()
        several = nodes.groupBy("id").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a <> b").select("id", "a")
        together = staged(nodes.join(several, "id").select("a", F.col("least").alias("b")).where("a <> b").distinct(), "together")
        labelled = _relabelled(least.select(F.col("component").alias("node"), F.col("least").alias("component")), together)
        found = found.join(labelled.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").withColumn("component", F.coalesce("now", "component"))
    return found.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"))


def jaccard_groups(docs: DataFrame, words: int = WORDS, hundredths: int = HUNDREDTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: components of the links of similarity hundredths / 100 or more.

    Ids are integers below STAND_IN and name documents: rows that repeat an id are one document, which
    has the links of each of its texts; each row has the size of its own. Rows with a null
    id are sized but link with nothing and have a null component. A null, empty or wordless text
    has no shingles and links with nothing; an empty table gives an empty result; other columns
    are ignored whatever their names. Whole texts are read.
    """
    spark = docs.sparkSession
    texts, names = told_apart(docs, id_col, text_col)
    classes = spark.sparkContext.broadcast(frequency_classes(texts.select("text"), words))  # COUNTERS bytes
    signed = staged(signatures(texts, classes, words, hundredths), "signatures")
    own = signed.where("n_shingles > 0 AND id IS NOT NULL")
    groups = staged(own.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("rep"), F.first("tokens").alias("tokens"), F.first("parity").alias("parity")), "classes")
    # prefix tokens that two classes or more have; one shuffle, and a window that spills, since a join would shuffle all tokens twice
    listed = groups.select("rep", F.posexplode("tokens").alias("pos", "token"))
    same = Window.partitionBy("token")
    counted = listed.withColumns({"holders": F.count("*").over(same), "least": F.min("rep").over(same)}).where("holders > 1")
    shared = counted.select("token", F.col("rep").alias("id"), F.col("pos").cast("int").alias("pos"), F.when(F.col("holders") > HOT, F.col("least")).alias("least"))
    entries = staged(shared.join(groups.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "parity"), "id"), "entries")
    few = entries.where("least IS NULL")
    hot = entries.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    pairs = staged(_candidates(few.select("token", "id", F.col("pos").cast("long").alias("pos"), "n", "parity"), hundredths).unionByName(hot), "pairs")
    labels = connected_classes(texts, groups, pairs, lambda ids: entries.join(ids, "id", "left_semi"), Prefixes(classes, hundredths), words, hundredths)
    return of_documents(signed, groups, labels, names, id_col)
