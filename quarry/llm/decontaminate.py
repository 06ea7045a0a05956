"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders, everything else
into lower-cased words; punctuation goes. Windows of WINDOW template words of the benchmark are
the build side of a hash join that every window of every document probes. What matches is put
together by document and item: literal words are compared once more, slots must be filled
consistently (one value of the item always by the same value of the document, different values
by different ones), and the windows within one stretch of the document must cover enough of the
item. A capitalised word that opens a sentence may be a name or not: it is tried as both. So an item is found word for word,
with changed numbers, names or units, or with a few words edited. Windows that say little as a
template (fewer than two literal words, or an item of fewer than WINDOW words within a longer
document) are matched word for word, numbers and names included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _BYTE_KEYS, _LOWER, _SPACE, _powers, mix64, slices, staged, text_bytes

#: Template words of a window; share of an item's template words that matching windows must cover.
WINDOW, COVERAGE = 5, 0.8
#: Windows of the benchmark that one pass sends to the executors at most (about 24 bytes each).
PASS_WINDOWS = 1_000_000
#: Words that measure, when they follow a number. Fixed values.
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams ton tons lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees "
    "meter meters metre metres kilometer kilometers kilometre kilometres mph kmh hz khz mhz w kw v a j kj cal kcal "
    "sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate jahr jahre jahren stück meilen gramm kilo tonnen prozent grad "
    "seconde secondes heure heures jour jours semaine semaines mois an ans année années mètre mètres gramme grammes kilos tonne tonnes pour degrés "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años metro metros gramo gramos litro litros kilómetro kilómetros grados"
).split()
#: Words that are numbers. Fixed values.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend millionen "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent cents mille millions "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta cien ciento mil millón millones"
).split()

WORD, NUMBER, UNIT, NAME = range(4)
_EXACT = np.uint64(0xA24BAED4963EE407)
_PLACE = mix64(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n\r:;|\"("]] = True


@dataclass
class Template:
    """Template words of several texts: hashes of the words; of three templates, without names, with names, with openings as names too; row offsets."""

    words: np.ndarray
    kinds: np.ndarray
    plain: np.ndarray
    named: np.ndarray
    opened: np.ndarray
    opens: np.ndarray  # capitalised words at the start of a sentence
    rows: np.ndarray


def _hash_runs(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray, where: np.ndarray) -> np.ndarray:
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(where)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(_BYTE_KEYS[_LOWER[data[where]]] * _powers(int(lengths.max()))[place], starts)
    return mix64(sums ^ (lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _known(words: list[str]) -> np.ndarray:
    data, rows = text_bytes(pa.array(words))
    lengths = np.diff(rows)
    return np.sort(_hash_runs(data, rows[:-1], lengths, np.arange(len(data))))


_UNIT_KEYS, _NUMBER_KEYS = _known(UNITS), _known(NUMBERS)


def _isin(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


def _goes_on(data: np.ndarray, kind: np.ndarray, begin: np.ndarray, lengths: np.ndarray, numeric: np.ndarray, after_number: np.ndarray) -> np.ndarray:
    """Words that continue the number before them: digits after one , or . (3,500.2), number words after blanks or a hyphen (twenty-five, 5 million)."""
    out = np.zeros(len(begin), dtype=bool)
    at = np.flatnonzero(numeric & after_number)
    if len(at):
        ends, starts = begin[at - 1] + lengths[at - 1], begin[at]
        digits = (kind[begin[at - 1]] == 2).astype(np.int8) + (kind[starts] == 2)
        single = np.where(starts - ends == 1, data[ends], 0)
        solid = np.concatenate([[0], np.cumsum(~_SPACE[data])])
        out[at] = np.where(digits == 2, (single == ord(",")) | (single == ord(".")), (solid[starts] == solid[ends]) | (single == ord("-")))
    return out


def _merged(words: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Hashes of the kept words; what goes on a number counts in its hash, so 3.5 isn't 3.7."""
    out, more = words[keep], np.flatnonzero(~keep)
    of = np.cumsum(keep)[more] - 1
    nth = more - np.flatnonzero(keep)[of]
    for n in range(1, int(nth.max(initial=0)) + 1):
        i = nth == n
        out[of[i]] = mix64(out[of[i]] * np.uint64(0x9E3779B97F4A7C15) + words[more[i]])
    return out


def _capitals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where a capital letter begins, data in lower case), for A-Z and for the capitals of two bytes of Latin-1, Greek and Cyrillic."""
    out, upper = data.copy(), (data >= 65) & (data <= 90)
    out[upper] += 32
    lead, second = data[:-1], data[1:]
    # (first byte, second bytes from, to, how far the second byte moves, new first byte); the multiplication sign, 0xC3 0x97, is no letter
    for byte, low, high, step, new in ((0xC3, 0x80, 0x9E, 32, 0xC3), (0xCE, 0x91, 0x9F, 32, 0xCE), (0xCE, 0xA0, 0xA9, -32, 0xCF), (0xD0, 0x90, 0x9F, 32, 0xD0), (0xD0, 0xA0, 0xAF, -32, 0xD1)):
        at = np.flatnonzero((lead == byte) & (second >= low) & (second <= high) & ~((lead == 0xC3) & (second == 0x97)))
        out[at], out[at + 1] = new, data[at + 1].astype(np.int16) + step
        upper[at] = True
    return upper, out


def template(values: pa.Array) -> Template:
    """Canonicalise every text of an Arrow array; null counts as empty."""
    data, offsets = text_bytes(values)
    empty = np.zeros(0, dtype=np.uint64)
    if not len(data):
        return Template(empty, empty.astype(np.uint8), empty, empty, empty, empty.astype(bool), np.zeros(len(values) + 1, dtype=np.int64))
    kind = _KIND[data]
    first = kind > 0
    first[1:] &= kind[1:] != kind[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = kind[cuts] > 0
    begin = np.flatnonzero(first)
    if not len(begin):
        return Template(empty, empty.astype(np.uint8), empty, empty, empty, empty.astype(bool), np.zeros(len(values) + 1, dtype=np.int64))
    where = np.flatnonzero(kind)
    lengths = np.diff(np.append(np.searchsorted(where, begin), len(where)))
    capital, folded = _capitals(data)
    words = _hash_runs(folded, begin, lengths, where)
    row = np.searchsorted(offsets, begin, side="right") - 1
    opens = np.ones(len(begin), dtype=bool)
    opens[1:] = row[1:] != row[:-1]
    numeric = (kind[begin] == 2) | _isin(words, _NUMBER_KEYS)
    after_number = np.zeros(len(begin), dtype=bool)
    after_number[1:] = numeric[:-1] & ~opens[1:]
    unit = ~numeric & after_number & _isin(words, _UNIT_KEYS)
    ends = np.cumsum(_ENDS[data])
    sentence = opens.copy()
    sentence[1:] |= ends[begin[1:]] > ends[begin[:-1]]
    upper = capital[begin] & ~numeric & ~unit
    name = upper & ~sentence
    kinds = np.where(numeric, NUMBER, np.where(unit, UNIT, np.where(name, NAME, WORD))).astype(np.uint8)
    keep = ~_goes_on(data, kind, begin, lengths, numeric, after_number)
    words = _merged(words, keep)
    kinds, row, opens = kinds[keep], row[keep], (upper & sentence)[keep]
    plain = np.where((kinds == NUMBER) | (kinds == UNIT), _PLACE[kinds], words)
    named = np.where(kinds == NAME, _PLACE[NAME], plain)
    return Template(words, kinds, plain, named, np.where(opens, _PLACE[NAME], named), opens, np.searchsorted(row, np.arange(len(values) + 1)))


def windows(t: Template, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first word, hash, row) of all windows that hold two literal words at least; a shorter text is one window.

    Windows with names are there twice, with placeholders for the names and with the names as words; windows
    with a capitalised word that opens a sentence once more, with a placeholder for it too.
    """
    n = len(t.words)
    found = []
    rows = np.repeat(np.arange(len(t.rows) - 1), np.diff(t.rows))
    left = t.rows[rows + 1] - np.arange(n) if n else np.zeros(0, dtype=np.int64)
    at_start = np.arange(n) == t.rows[rows] if n else np.zeros(0, dtype=bool)
    width = np.minimum(left, size)
    use = (left >= size) | at_start
    name = t.kinds == NAME
    for keys, literal, needed in ((t.plain, (t.kinds == WORD) | name, None), (t.named, t.kinds == WORD, name), (t.opened, (t.kinds == WORD) & ~t.opens, t.opens)):
        sums, words, there = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int8), np.zeros(n, dtype=bool)
        for k in range(min(size, n)):
            inside = np.flatnonzero(width > k)
            sums[inside] = (sums[inside] + keys[inside + k]) * np.uint64(0x9E3779B97F4A7C15)
            words[inside] += literal[inside + k]
            there[inside] |= needed[inside + k] if needed is not None else True
        fine = np.flatnonzero(use & (words >= np.minimum(2, width)) & there)
        found.append((fine, mix64(sums[fine] ^ width[fine].astype(np.uint64))))
    place = np.concatenate([f[0] for f in found])
    keys = np.concatenate([f[1] for f in found])
    return place, keys, rows[place] if n else place


def exact_windows(t: Template, widths: list[int], of_items: bool = False, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first word, hash, row) of windows by their words, with numbers and names as they stand.

    Full windows are those that windows() leaves out. Smaller ones have the given widths; of items they are whole
    items, of documents all but what windows() has of texts as short. A single number is no window.
    """
    n = len(t.words)
    rows = np.repeat(np.arange(len(t.rows) - 1), np.diff(t.rows))
    left = t.rows[rows + 1] - np.arange(n) if n else np.zeros(0, dtype=np.int64)
    at_start = np.arange(n) == t.rows[rows] if n else np.zeros(0, dtype=bool)
    words = np.concatenate([[0], np.cumsum((t.kinds == WORD) | (t.kinds == NAME))])
    places, keys = [], []
    for width in sorted({size, *widths}):
        at = np.flatnonzero(left >= width)
        literal = words[at + width] - words[at]
        if width == size:
            use = literal < 2
        else:
            whole = (left[at] == width) & at_start[at]
            use = whole if of_items else ~(whole & (literal >= min(2, width)))
        at = at[use & ((literal > 0) | (width > 1))]
        sums = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            sums = (sums + t.words[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        places.append(at)
        keys.append(mix64(sums ^ _EXACT ^ np.uint64(width)))
    place = np.concatenate(places)
    return place, np.concatenate(keys), rows[place] if n else place


@dataclass
class Index:
    """Benchmark windows in the order of their hashes, and the templates of the items."""

    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    ids: list[int]
    words: list[np.ndarray]
    kinds: list[np.ndarray]
    opens: list[np.ndarray]
    widths: list[int]  # of items shorter than a window


def build_index(ids: list[int], texts: list[str | None]) -> Index:
    t = template(pa.array(texts, pa.string()))
    lengths = np.diff(t.rows)
    widths = np.unique(lengths[(lengths > 0) & (lengths < WINDOW)]).tolist()
    place, keys, row = (np.concatenate(x) for x in zip(windows(t), exact_windows(t, widths, of_items=True), strict=True))
    order = np.argsort(keys, kind="stable")
    parts = [slice(a, b) for a, b in zip(t.rows[:-1], t.rows[1:], strict=True)]
    return Index(keys[order], row[order], (place - t.rows[row])[order], ids, [t.words[p] for p in parts], [t.kinds[p] for p in parts], [t.opens[p] for p in parts], widths)


def _covered(item_at: np.ndarray, doc_at: np.ndarray, item_words: np.ndarray, item_kinds: np.ndarray, item_opens: np.ndarray, doc_words: np.ndarray, size: int = WINDOW) -> tuple[int, int, bool]:
    """(covered item words, windows, any slot changed) of the best stretch of the document, after the check of words and slots."""
    length = len(item_words)
    doc_at, item_at = np.unique(np.stack([doc_at, item_at]), axis=1)  # by the place in the document
    best = (0, 0, False)
    reach = np.searchsorted(doc_at, doc_at + 2 * length)
    tried = -1
    for a in range(len(doc_at)):
        b = int(reach[a])
        if b == tried or min(length, (b - a) * size) <= best[0]:  # a stretch within one that was tried, or too short to win
            continue
        tried = b
        there, back, seen, used, changed = {}, {}, np.zeros(length, dtype=bool), 0, False
        for i, d in zip(item_at[a:b].tolist(), doc_at[a:b].tolist(), strict=True):
            width = min(size, length - i)
            own, other = item_words[i : i + width], doc_words[d : d + width]
            slot = (item_kinds[i : i + width] != WORD) | (item_opens[i : i + width] & (own != other))
            if (own != other)[~slot].any():
                continue  # only the hashes of the windows were equal
            pairs = list(zip(own[slot].tolist(), other[slot].tolist(), strict=True))
            if all(there.get(x, y) == y and back.get(y, x) == x for x, y in pairs):
                for x, y in pairs:
                    there[x], back[y] = y, x
                    changed |= x != y
                seen[i : i + width] = True
                used += 1
        if seen.sum() > best[0]:
            best = (int(seen.sum()), used, bool(changed))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """(id_col, item_id, coverage, n_windows, reparameterised), one row for each document and each item that it holds.

    Whole texts are read. Null or empty texts, on either side, match nothing; an item shorter
    than a window counts as one window, found word for word anywhere and, if it has two literal
    words (or is one), with its slots changed in documents as short; repeated documents are found
    each, repeated items too; empty tables give an empty result; other columns are ignored
    whatever their names. The benchmark is sent to the executors in parts of at most
    pass_windows windows, one pass over the documents for each.
    """
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    # A word has a character and a blank, and a window is built from each of two templates.
    bound = items.select(F.coalesce(F.sum(F.length("text") + 2), F.lit(0))).first()[0]
    passes = max(1, -(-int(bound) // pass_windows))
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    found = None
    for n in range(passes):
        mine = (items.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == n) if passes > 1 else items).toArrow()
        index = spark.sparkContext.broadcast(build_index(mine.column(0).to_pylist(), mine.column(1).to_pylist()))

        def probe(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own: Index = index.value
            filled = np.zeros(1 << 20, dtype=bool)
            filled[(own.keys >> np.uint64(44)).astype(np.int64)] = True
            for part in slices(batches, "__text"):
                t = template(part.column(1))
                place, keys, row = (np.concatenate(x) for x in zip(windows(t), exact_windows(t, own.widths), strict=True))
                maybe = np.flatnonzero(filled[(keys >> np.uint64(44)).astype(np.int64)])
                low, high = np.searchsorted(own.keys, keys[maybe]), np.searchsorted(own.keys, keys[maybe], side="right")
                hits = np.repeat(maybe, high - low)
                if not len(hits):
                    continue
                entry = np.arange(len(hits)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
                item, item_at, doc_row, doc_at = own.item[entry], own.place[entry], row[hits], place[hits]
                order = np.lexsort((item, doc_row))
                edges = np.flatnonzero(np.diff(doc_row[order]) | np.diff(item[order])) + 1
                rows = []
                for group in np.split(order, edges):
                    x = int(item[group[0]])
                    length = len(own.words[x])
                    if min(len(group) * WINDOW, length) < coverage * length:
                        continue
                    seen, used, changed = _covered(item_at[group], doc_at[group], own.words[x], own.kinds[x], own.opens[x], t.words)
                    if seen >= coverage * length:
                        rows.append((int(doc_row[group[0]]), own.ids[x], seen / length, used, changed))
                if rows:
                    r, i, c, w, s = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(i, pa.int64()), pa.array(c, pa.float64()), pa.array(w, pa.int64()), pa.array(s)], names=[id_col, "item_id", "coverage", "n_windows", "reparameterised"])

        one = texts.mapInArrow(probe, f"`{id_col}` {kind}, item_id long, coverage double, n_windows long, reparameterised boolean")
        if passes > 1:  # each pass runs and is written before the next part of the benchmark is fetched
            one = staged(one, "contaminated")
            index.destroy()
        found = one if found is None else found.unionByName(one)
    return found
