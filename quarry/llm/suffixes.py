"""Exact removal of repeated strings with suffix arrays built by linear grouping.

A string of LENGTH bytes belongs to the rarest of its GRAM-byte pieces (a sketch of fixed size
counts them over all documents; a hash decides among pieces as rare), so equal strings belong
to equal pieces wherever they stand, and a frequent piece only has strings whose pieces are all
as frequent: those within a passage that many documents repeat, not those at its edges.
Neighbouring strings with the same piece make one stretch of text; stretches are dealt to
buckets by the hash of their piece, packed and without their bytes. Equal stretches are settled
there by their first document, by a hash of 64 bits beside 32 bits of the piece. Where one
piece has different stretches, the bytes of each different one are fetched once, and a suffix
array over them finds the strings that they share. It is built by grouping: suffixes with the
same Lyndon prefix form groups, which are refined in descending order by previous-smaller
pointers and then put out in order, without renaming and recursion. Where the stretches of one
piece are many, an array is built for those that agree in a block around the piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import mix64, slices, staged, text_bytes

LENGTH, GRAM = 50, 16
#: Bytes of text that are hashed at once, that fill a bucket about, and whose buckets make a task.
PIECE, BUCKET_BYTES, TASK_BYTES = 1 << 20, 4 << 20, 32 << 20
#: Stretches that a task gathers before it deals them.
GATHERED = 250_000
#: Counters of the frequency sketch, and of one row of it; counters that a task passes on are SEEN above twice its mean.
COUNTERS, CHUNK, SEEN = 1 << 24, 1 << 20, 4
#: Bytes of stretches that one suffix array holds, and from which those of one piece are divided by the blocks around it.
RUN, DIVIDED = 1 << 16, 1 << 17
#: Places of a piece in its string that one block stands for.
PLACES = 5

_ENTRY = np.dtype([("m", "<u4"), ("h", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("n", "u1"), ("off", "u1")])
_BASES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_KEYS = [mix64(np.arange(s, s + 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in (1, 5001)]
_FORTH: list[np.ndarray] = []
_BACK: list[np.ndarray] = []


def suffix_order(s: list[int]) -> list[int]:
    """Start places of the suffixes of s in lexicographic order; the last symbol must be smaller than all others."""
    n = len(s)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        own = first.get(c)
        if own is None:
            first[c] = [i]
        else:
            own.append(i)
    members = [first[c] for c in sorted(first)]
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    left = list(range(-1, n - 1))
    done = bytearray(n)
    smaller = [-1] * n
    # Groups in descending order: everything that is done starts with a greater or equal Lyndon prefix.
    g = len(members) - 1
    while g >= 0:
        if size[g] == 1:
            own = members[g]
            i = own[-1] if group[own[-1]] == g else next(x for x in own if group[x] == g)
            members[g] = [i]
            done[i] = 1
            p = left[i]
            while p >= 0 and done[p]:
                p = left[p]
            left[i] = smaller[i] = p
            if p >= 0:
                h = group[p]
                if size[h] > 1:  # p's prefix grows by this one: p goes above the rest of its group
                    size[h] -= 1
                    new = len(members)
                    members.append([p])
                    size.append(1)
                    group[p] = new
                    up = above[h]
                    below.append(h)
                    above.append(up)
                    above[h] = new
                    if up >= 0:
                        below[up] = new
            g = below[g]
            continue
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            p = left[i]
            while p >= 0 and done[p]:
                p = left[p]
            left[i] = smaller[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            split.setdefault((group[p], k), []).append(p)
        for (h, _), moved in sorted(split.items(), reverse=True) if len(split) > 1 else split.items():
            # more repeats stand higher: they come first here, and later ones go right above the old group
            if len(moved) == size[h]:
                continue
            size[h] -= len(moved)
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            for p in moved:
                group[p] = new
            up = above[h]
            below.append(h)
            above.append(up)
            above[h] = new
            if up >= 0:
                below[up] = new
        g = below[g]
    # Groups in ascending order: each suffix in turn puts those whose Lyndon prefix ends before it to the front of their groups.
    start = [0] * len(members)
    at = 0
    g = group[n - 1]
    while g >= 0:
        start[g] = at
        at += size[g]
        g = above[g]
    order = [0] * n
    order[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = smaller[j]
    return order


def _powers(n: int) -> None:
    if not _FORTH or len(_FORTH[0]) < n:
        _FORTH[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(n, b, dtype=np.uint64))) for b in _BASES]
        _BACK[:] = [np.multiply.accumulate(np.append(np.uint64(1), np.full(n, pow(b, -1, 1 << 64), dtype=np.uint64))) for b in _BASES]


def _sums(data: np.ndarray, k: int) -> np.ndarray:
    """Running sums of weighted bytes, from which the hash of any part is a difference."""
    _powers(max(len(data) + 1, PIECE + 65536))
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_KEYS[k][data] * _FORTH[k][: len(data)])])


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all pieces of GRAM bytes."""
    sums = _sums(data, 0)
    return mix64((sums[GRAM:] - sums[:-GRAM]) * _BACK[0][: max(len(data) - GRAM + 1, 0)])


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def piece_classes(texts: DataFrame) -> np.ndarray:
    """For every counter of the sketch, the binary logarithm of how often its pieces occur in all texts.

    A task passes on only what stands out among all that it has seen, so a count may be short by
    a few for each task. Counts only choose the piece that a string is filed under, never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, all_ = np.zeros(COUNTERS, dtype=np.uint32), 0
        for _, _, data, _ in _pieces(batches):
            if len(data) >= GRAM:
                np.add.at(seen, _slot(_grams(data)), np.uint32(1))
                all_ += len(data)
        least = SEEN + 2 * all_ // COUNTERS
        for n in range(COUNTERS // CHUNK):
            own = seen[n * CHUNK : (n + 1) * CHUNK]
            used = np.flatnonzero(own >= least)
            if len(used):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([n], pa.int32()), "at": pa.array([used.astype(np.uint32).tobytes()], pa.binary()), "n": pa.array([own[used].tobytes()], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, dtype=np.int64)
        for at, n in zip(rows.column("at"), rows.column("n"), strict=True):
            total[np.frombuffer(at.as_buffer(), dtype=np.uint32)] += np.frombuffer(n.as_buffer(), dtype=np.uint32)
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "classes": pa.array([np.frexp(total)[1].astype(np.uint8).tobytes()], pa.binary())})

    out = np.zeros(COUNTERS, dtype=np.uint8)
    numbered = texts.select(F.lit(0).cast("long").alias("doc"), "text").mapInArrow(count, "chunk int, at binary, n binary")
    for r in numbered.groupBy("chunk").applyInArrow(add, "chunk int, classes binary").toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["classes"]), dtype=np.uint8)
    return np.minimum(out, 63)


def stretches(data: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, strings, hash of the piece, hash of the bytes, place of the piece in them) of the stretches of texts that follow each other in data."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    grams = _grams(data)
    key = (classes[_slot(grams)].astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(38) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    span, width = LENGTH - GRAM + 1, 1
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = span - width
    key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
    piece = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the rarest piece, the leftmost of equals, of each string
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    fits = row[: n - LENGTH + 1] == row[LENGTH - 1 :]
    edge = fits.copy()
    edge[1:] &= (piece[1:] != piece[:-1]) | ~fits[:-1]
    start = np.flatnonzero(edge)
    last = fits.copy()
    last[:-1] &= (piece[1:] != piece[:-1]) | ~fits[1:]
    end = np.flatnonzero(last)
    stop = end + LENGTH
    sums = _sums(data, 1)
    whole = mix64((sums[stop] - sums[start]) * _BACK[1][start] ^ ((stop - start).astype(np.uint64) << np.uint64(32)))
    own = row[start]
    return own, start - rows[own], end - start + 1, grams[piece[start]], whole, piece[start] - start


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, offsets of the rows' first bytes in their texts, data, rows); texts beyond PIECE bytes come in overlapping parts."""
    for part in slices(batches, "text", PIECE):
        for at in range(0, part.num_rows, 60_000):
            some = part.slice(at, 60_000)
            data, rows = text_bytes(some.column(1))
            ids = some.column(0).to_numpy()
            if len(ids) == 1 and len(data) > PIECE:
                for a in range(0, len(data) - LENGTH + 1, PIECE):
                    own = data[a : a + PIECE + LENGTH - 1]
                    yield ids, np.array([a]), own, np.array([0, len(own)])
            else:
                yield ids, np.zeros(len(ids), dtype=np.int64), data, rows


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows, sorted, with those that overlap or touch made one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((end, start, row))
    row, start, end = row[order], start[order].astype(np.int64), end[order].astype(np.int64)
    turn = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))
    wide = int(end.max()) + 2
    shifted = np.maximum.accumulate(end + turn * wide) - turn * wide
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > shifted[:-1])
    first = np.flatnonzero(new)
    return row[first], start[first], np.maximum.reduceat(end, first)


def _lists(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.ListArray]]:
    """Distinct keys, and for each column the values of every key as a list. Keys must come sorted."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.append(first, len(keys)).astype(np.int32))
    return keys[first], [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]


_REPLY = "doc long, start array<int>, end array<int>, ask array<int>, strings array<int>, piece array<long>"


def _reply(doc: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray | None = None) -> pa.Table:
    """Removed spans, or, with piece, requests for the bytes of stretches (start, and, as end, number of strings + 64 * place of the piece), one row a document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int32), end[order].astype(np.int32)
    names = ["doc", "start", "end", "ask", "strings", "piece"]
    if piece is None:
        keys, (s, e) = _lists(doc, start, end)
        none = [pa.nulls(len(keys), pa.list_(t)) for t in (pa.int32(), pa.int32(), pa.int64())]
        return pa.Table.from_arrays([pa.array(keys.astype(np.int64)), s, e, *none], names=names)
    keys, (s, e, p) = _lists(doc, start, end, piece[order].view(np.int64))
    none = [pa.nulls(len(keys), pa.list_(pa.int32()))] * 2
    return pa.Table.from_arrays([pa.array(keys.astype(np.int64)), *none, s, e, p], names=names)


def _dealt(texts: DataFrame, buckets: int, classes, bits: int) -> DataFrame:
    """Stretches of all texts, packed by bucket; a stretch that an earlier document among those gathered has too is settled at once."""

    def pack(doc: np.ndarray, start: np.ndarray, n: np.ndarray, piece: np.ndarray, whole: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, whole, piece))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (whole[order][1:] == whole[order][:-1]) & (piece[order][1:] == piece[order][:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        later = doc[order] >> bits > doc[order[head]] >> bits
        gone, kept = order[later], order[~later]
        bucket = (piece[kept] >> np.uint64(32)).astype(np.int64) % buckets
        by = np.argsort(bucket, kind="stable")
        kept, bucket = kept[by], bucket[by]
        entries = np.zeros(len(kept), dtype=_ENTRY)
        entries["m"], entries["h"], entries["at"], entries["n"], entries["off"] = (piece[kept] & np.uint64(0xFFFFFFFF)).astype(np.uint32), whole[kept], start[kept], n[kept], off[kept]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        names, payload = [], []
        for b in used.tolist():
            own = entries[cuts[b] : cuts[b + 1]]
            docs, own["doc"] = np.unique(doc[kept[cuts[b] : cuts[b + 1]]], return_inverse=True)
            names.append(docs.astype(np.int64).tobytes())
            payload.append(own.tobytes())
        spans = np.stack([x.astype(np.int64) for x in _merged(doc[gone], start[gone], start[gone] + n[gone] + LENGTH - 1)], axis=1)
        spread = np.array_split(spans, len(used))
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(names, pa.binary()), pa.array(payload, pa.binary()), pa.array([s.tobytes() for s in spread], pa.binary())], names=["bucket", "ids", "entries", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = classes.value, [], 0
        for ids, base, data, rows in _pieces(batches):
            row, start, n, piece, whole, off = stretches(data, rows, known)
            if not len(row):
                continue
            held.append((ids[row], start + base[row], n.astype(np.uint8), piece, whole, off.astype(np.uint8)))
            size += len(row)
            if size >= GATHERED:
                yield pack(*[np.concatenate(c) for c in zip(*held, strict=True)])
                held, size = [], 0
        if held:
            yield pack(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return texts.mapInArrow(run, "bucket int, ids binary, entries binary, spans binary")


def _settle(table: pa.Table, bits: int) -> pa.Table:
    """A bucket: stretches that an earlier document has too are removed, those that differ under one piece are asked for."""
    parts, docs = [], []
    for ids, entries in zip(table.column("ids"), table.column("entries"), strict=True):
        own = np.frombuffer(entries.as_buffer(), dtype=_ENTRY)
        parts.append(own)
        docs.append(np.frombuffer(ids.as_buffer(), dtype=np.int64)[own["doc"]])
    e, doc = np.concatenate(parts), np.concatenate(docs)
    spans = np.concatenate([np.frombuffer(s.as_buffer(), dtype=np.int64).reshape(-1, 3) for s in table.column("spans")])
    bucket = np.uint64(table.column("bucket")[0].as_py())
    order = np.lexsort((doc, e["h"], e["m"]))
    m, h, at, n, doc = e["m"][order], e["h"][order], e["at"][order].astype(np.int64), e["n"][order].astype(np.int64), doc[order]
    new_m = np.concatenate([[True], m[1:] != m[:-1]])
    new_h = new_m | np.concatenate([[True], h[1:] != h[:-1]])
    heads, groups = np.flatnonzero(new_h), np.flatnonzero(new_m)
    first = doc[heads][np.cumsum(new_h) - 1]  # the first document of the same stretch
    gone = doc >> bits > first >> bits
    in_group = np.cumsum(new_m) - 1
    several = np.add.reduceat(new_h.astype(np.int64), groups) > 1
    apart = np.minimum.reduceat(doc, groups) != np.maximum.reduceat(doc, groups)
    ask = np.flatnonzero(~gone & (several & apart)[in_group])  # of the first document, every occurrence
    removed = _reply(np.concatenate([spans[:, 0], doc[gone]]), np.concatenate([spans[:, 1], at[gone]]), np.concatenate([spans[:, 2], at[gone] + n[gone] + LENGTH - 1]))
    off = e["off"][order].astype(np.int64)
    asked = _reply(doc[ask], at[ask], n[ask] + 64 * off[ask], (bucket << np.uint64(32)) | m[ask].astype(np.uint64))
    return pa.concat_tables([removed, asked])


def _fetched(asked: DataFrame) -> DataFrame:
    """(piece, doc, at, off, bytes) of the stretches that were asked for, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PIECE):
            asks = part.column(2)
            row = np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.list_value_length(asks)))
            at, coded, piece = (np.asarray(part.column(c).flatten()) for c in (2, 3, 4))
            texts = part.column(1).to_pylist()
            cut = [texts[r][a : a + n] for r, a, n in zip(row.tolist(), at.tolist(), ((coded & 63) + LENGTH - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(np.asarray(part.column(0))[row]), pa.array(at), pa.array(coded >> 6), pa.array(cut, pa.binary())], names=["piece", "doc", "at", "off", "bytes"])

    return asked.select("doc", "text", "ask", "strings", "piece").mapInArrow(run, "piece long, doc long, at int, off int, bytes binary")


def _hopeful(texts: pa.Array, piece: np.ndarray, doc: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, start, end): stretches that can share a string with another document's, and the part of each that can.

    A string of LENGTH bytes covers, by where the piece stands in it, one of a few blocks around
    the piece; without a block in common there is no string in common.
    """
    data, rows = text_bytes(texts)
    sums = _sums(data, 1)
    begin, end, at = rows[:-1], rows[1:], rows[:-1] + off
    rest = LENGTH - GRAM
    start, stop = end.copy(), begin.copy()
    for least in range(0, rest + 1, PLACES):  # places of the piece in the string
        most = min(least + PLACES - 1, rest)
        low, high = np.maximum(at - most, begin), np.minimum(at - least + LENGTH, end)  # all strings of this block
        there = np.flatnonzero((at - least >= begin) & (high - low >= LENGTH) & (low <= at - least))
        if not len(there):
            continue
        a = at[there] - least
        block = mix64((sums[at[there] + GRAM + rest - most] - sums[a]) * _BACK[1][a])
        order = np.lexsort((block, piece[there]))
        p, k, d = piece[there][order], block[order], doc[there][order]
        heads = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (k[1:] != k[:-1])]))
        several = np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)
        kept = there[order[np.repeat(several, np.diff(np.append(heads, len(order))))]]
        start[kept] = np.minimum(start[kept], low[kept])
        stop[kept] = np.maximum(stop[kept], high[kept])
    own = np.flatnonzero(stop > start)
    return own, (start - begin)[own], (stop - begin)[own]


def _shared(table: pa.Table, bits: int) -> pa.Table:
    """Suffix arrays over the different stretches of pieces: strings that an earlier document has too are removed.

    Equal strings have equal pieces, so one array can hold several pieces: pieces share one until they have RUN bytes.
    """
    piece, doc, at, off = (table.column(c).to_numpy() for c in ("piece", "doc", "at", "off"))
    at, off = at.astype(np.int64), off.astype(np.int64)
    texts = table.column("bytes").combine_chunks()
    hopeful, start, stop = _hopeful(texts, piece, doc, off)
    piece, doc, at, off = piece[hopeful], doc[hopeful], at[hopeful] + start, off[hopeful] - start
    texts = [t[a:b] for t, a, b in zip(texts.take(pa.array(hopeful)).to_pylist(), start.tolist(), stop.tolist(), strict=True)]
    order = np.lexsort((doc, piece)).tolist()
    same: dict[tuple[int, bytes], list[int]] = {}  # the first of each has the smallest document
    for i in order:
        same.setdefault((int(piece[i]), texts[i]), []).append(i)
    found = [t for _, t in same]
    places = list(same.values())
    heads = np.array([x[0] for x in places], dtype=np.int64)
    sizes = np.cumsum([len(t) for t in found])
    of = piece[heads]
    ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)) if len(of) else np.zeros(0, dtype=np.int64)
    # the same bytes in a later document go as a whole; what the first document has, the arrays decide
    out = [(doc[i], at[i], at[i] + len(t)) for t, own in zip(found, places, strict=True) for i in own[1:] if doc[i] >> bits > doc[own[0]] >> bits]
    a = 0
    while a < len(found):
        full = int(sizes[a - 1]) + RUN if a else RUN
        k = int(np.searchsorted(sizes[ends - 1], full, side="right"))
        b = max(int(ends[k - 1]) if k else 0, int(ends[np.searchsorted(ends, a, side="right")]))  # whole pieces, one at least
        for which, start in _parts(found[a:b], off[heads[a:b]], doc[heads[a:b]] >> bits):
            for w, st in zip(which.tolist(), start.tolist(), strict=True):
                out += [(doc[i], at[i] + st, at[i] + st + LENGTH) for i in places[a + w]]
        a = b
    d, st, e = (np.array(c, dtype=np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=np.int64),) * 3
    return _reply(*_merged(d, st, e)).select(["doc", "start", "end"])


def _parts(texts: list[bytes], off: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, start) of _repeats; many texts are divided, for each block around the piece, into those that agree in it.

    A string with its piece at place o covers the first, second or third block as o goes from the
    end of its string to the start, so each string is looked for with exactly one block.
    """
    if sum(map(len, texts)) <= DIVIDED:
        yield _repeats(texts, doc)
        return
    rest = LENGTH - GRAM
    third = rest // 3
    for least, most in ((0, third - 1), (third, 2 * third - 1), (2 * third, rest)):  # places of the piece in the string
        agree: dict[bytes, list[tuple[int, int]]] = {}
        for k, (t, o) in enumerate(zip(texts, off.tolist(), strict=True)):
            a, b = max(o - most, 0), min(o - least + LENGTH, len(t))  # all strings of this block
            if o - least >= 0 and b - a >= LENGTH and a <= o - least:
                agree.setdefault(t[o - least : o + GRAM + rest - most], []).append((k, a, b))
        for own in agree.values():
            if len(own) > 1:
                which = np.array([k for k, _, _ in own])
                found, start = _repeats([texts[k][a:b] for k, a, b in own], doc[which])
                yield which[found], start + np.array([a for _, a, _ in own])[found]


def _repeats(texts: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the strings of different texts that a text of a smaller document has too."""
    symbols: list[int] = []
    for t in texts:
        symbols += [x + 2 for x in t]
        symbols.append(1)
    symbols.append(0)
    order = np.array(suffix_order(symbols))
    lengths = np.array([len(t) + 1 for t in texts])
    own = np.append(np.repeat(np.arange(len(texts)), lengths), -1)
    place = np.append(np.arange(len(symbols) - 1) - np.repeat(np.cumsum(lengths) - lengths, lengths), 0)
    room = np.append(np.repeat(lengths - 1, lengths), 0) - place
    order = order[room[order] >= LENGTH]  # suffixes that begin with a whole string
    none = np.zeros(0, dtype=np.int64)
    if len(order) < 2:
        return none, none
    window = np.lib.stride_tricks.sliding_window_view(np.array(symbols, dtype=np.uint16), LENGTH)
    new = np.ones(len(order), dtype=bool)
    for a in range(1, len(order), 1 << 16):
        b = min(a + (1 << 16), len(order))
        new[a:b] = (window[order[a:b]] != window[order[a - 1 : b - 1]]).any(axis=1)
    docs = doc[own[order]]
    heads = np.flatnonzero(new)
    gone = docs > np.minimum.reduceat(docs, heads)[np.cumsum(new) - 1]
    return own[order[gone]], place[order[gone]]


def repeated_spans(texts: DataFrame, bits: int = 0) -> DataFrame:
    """(doc, start array<int>, end array<int>): byte spans of the strings of LENGTH bytes of texts (doc, text in bytes) that also start in a document of a smaller id; an id is doc without its last bits."""
    texts = texts.where("doc IS NOT NULL")
    size = texts.select(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    spark = texts.sparkSession
    buckets = int(max(spark.sparkContext.defaultParallelism, 16, -(-size // BUCKET_BYTES)))
    tasks = int(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    classes = spark.sparkContext.broadcast(piece_classes(texts))  # COUNTERS bytes
    settled = staged(_dealt(texts, buckets, classes, bits).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda t: _settle(t, bits), _REPLY), "settled")
    asks = settled.where("ask IS NOT NULL").groupBy("doc").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("ask", "strings", "piece")])
    asks = staged(asks, "asks")
    fetched = _fetched(texts.join(asks, "doc")).withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)))
    shared = staged(fetched.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda t: _shared(t, bits), "doc long, start array<int>, end array<int>"), "shared")
    spans = settled.where("start IS NOT NULL").select("doc", "start", "end").unionByName(shared)
    return spans.groupBy("doc").agg(F.flatten(F.collect_list("start")).alias("start"), F.flatten(F.collect_list("end")).alias("end"))


def _told_apart(texts: DataFrame) -> tuple[DataFrame, int]:
    """texts (doc, text), and 0; where rows repeat an id with another text, doc is moved up by some bits, which number the texts of an id, and those bits."""
    known = texts.where("doc IS NOT NULL").select("doc", F.xxhash64("text").alias("hash"))
    repeated = staged(known.groupBy("doc").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("doc"), "repeated")
    if repeated.isEmpty():
        return texts, 0
    number = F.row_number().over(Window.partitionBy("doc").orderBy("hash")) - 1
    several = staged(known.join(repeated, "doc").distinct().select("doc", "hash", number.cast("long").alias("number")), "several")
    most, least, largest = *several.agg(F.max("number")).first(), *texts.agg(F.min("doc"), F.max("doc")).first()
    bits = int(most).bit_length()
    if max(-least, largest + 1) << bits >= 1 << 63:
        raise ValueError(f"ids are too large to number {most + 1} texts of one id beside them")
    marked = texts.withColumn("hash", F.xxhash64("text")).join(several, ["doc", "hash"], "left")
    return marked.select((F.shiftleft("doc", bits) + F.coalesce("number", F.lit(0))).alias("doc"), "text"), bits


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every row.

    Ids are integers; rows that repeat an id, with the same text or another, never remove from each
    other, and each loses what documents of smaller ids have, whichever of their texts has it.
    Texts shorter than LENGTH bytes keep everything; a null text counts as empty; a row with a
    null id is kept whole and removes nothing; an empty table gives an empty result; other
    columns are ignored whatever their names.
    """
    texts, bits = _told_apart(docs.select(F.col(id_col).cast("long").alias("doc"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text")))
    spans = staged(repeated_spans(texts, bits), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PIECE):
            rows = []
            for text, start, end in zip(part.column(1), part.column(2), part.column(3), strict=True):
                text = text.as_py()
                if not start.is_valid:
                    rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
                    continue
                start, end = (np.asarray(x.values, dtype=np.int64) for x in (start, end))
                _, start, end = _merged(np.zeros(len(start), dtype=np.int64), start, end)
                edges = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(text)]
                kept = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                rows.append((len(text), len(text) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = texts.join(spans, "doc", "left").select("doc", "text", "start", "end").mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumn("doc", F.shiftright("doc", bits)).withColumnRenamed("doc", id_col)
