"""Encoding and decoding with merge-type SentencePiece vocabularies.

The agenda of a string holds its adjacent symbol pairs that make a piece of the vocabulary;
the pair of the highest score, the leftmost among equals, is merged first, and the merged
symbol puts its own pairs on the agenda. No piece has a word mark behind another character,
so a text falls into words that are encoded on their own. The distinct new words of an Arrow
slice are encoded together: one row of a score matrix is the agenda of one word, and each step
takes the best pair of every row. Words of more than WIDE symbols take a heap instead.
Every distinct word is also encoded by the sentencepiece library, and compared.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices

MARK = "▁"
#: Words that a Python worker remembers at most; then it starts anew.
REMEMBERED = 250_000
#: Symbols of a word that the matrix agenda takes at most.
WIDE = 48


#: What a normaliser would change: compatibility forms, composed and decomposed letters, blanks in a row and at the ends.
PROBE = " Ａﬁ  ½é e\u0301 ①"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder of one vocabulary; one per Python worker."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        if any(MARK in names[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece has a word mark behind another character: words can't be encoded on their own")
        if any("\n" in names[i][1:] for i in normal):
            raise ValueError("a piece has a line feed behind another character: words can't be encoded on their own")
        if lib.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
            raise ValueError("the vocabulary normalises texts, or puts no word mark before them: it can't be encoded as it is")
        self.ids = {names[i]: i for i in normal}
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        letters = sorted({c for i in normal for c in names[i]} - set(self.ids))
        self.symbol = self.ids | {c: size + n for n, c in enumerate(letters)}
        self.symbols = size + len(letters)
        pairs = {}
        for i in normal:
            for cut in range(1, len(names[i])):
                a, b = self.symbol.get(names[i][:cut]), self.symbol.get(names[i][cut:])
                if a is not None and b is not None:
                    pairs[a * self.symbols + b] = i
        self.pairs = pairs
        self.score = np.array([lib.get_score(i) for i in range(size)], dtype=np.float64)
        self.rank = np.append(np.unique(-self.score, return_inverse=True)[1], size).astype(np.int32)  # small for high scores, equal for equal ones; the last, for -1, is of no piece
        self.of_code = -1 - np.arange(0x110000, dtype=np.int32)  # the symbol of every code point
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_code[ord(c)] = i
        self._hash(np.fromiter(pairs, dtype=np.int64), np.fromiter(pairs.values(), dtype=np.int32))
        self.written = [str(i).encode() for i in range(size)]
        self.plain = [names[i].replace(MARK, " ").encode() for i in range(size)]
        for value, i in self.bytes.items():
            self.plain[i] = bytes([value])
        self.plain[self.unknown] = " ⁇ ".encode()
        self.space = self.encode_many([MARK])[0]
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressing table of the pairs, for look-ups of whole arrays."""
        self.bits = 64 - max(10, int(len(keys)).bit_length() + 3)
        self.slots = np.full(1 << (64 - self.bits), -1, dtype=np.int64)
        self.merged = np.full(len(self.slots), -1, dtype=np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at] == -1
            first = np.zeros(len(at), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slots[at[put]], self.merged[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.bits)).astype(np.int64)

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece ids of pairs, -1 for none; symbols below 0 never merge."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.symbols + right, -2)
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.merged[at], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            found = self.slots[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _matrix(self, words: list[str]) -> list[list[int]]:
        """Symbols of words of one length, after all merges; -1 - code point for characters of no piece."""
        out: list[list[int]] = [[]] * len(words)
        sym = self.of_code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].reshape(len(words), -1)
        rows = np.arange(len(words))
        piece = self._merge(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(len(words), -1)
        while True:
            if piece.shape[1]:
                best = self.rank[piece].argmin(axis=1)
                new = piece[np.arange(len(rows)), best]
                live = new >= 0
            else:
                live = np.zeros(len(rows), dtype=bool)
            if not live.all():
                for r, s in zip(rows[~live].tolist(), sym[~live].tolist(), strict=True):
                    out[r] = s
                if not live.any():
                    return out
                rows, sym, piece, best, new = rows[live], sym[live], piece[live], best[live], new[live]
            n, width = np.arange(len(rows)), sym.shape[1]
            columns = np.arange(width - 1)
            sym = np.where(columns > best[:, None], sym[:, 1:], sym[:, :-1])
            sym[n, best] = new
            piece = np.where(columns[:-1] >= best[:, None], piece[:, 1:], piece[:, :-1])
            has = np.flatnonzero(best > 0)
            piece[has, best[has] - 1] = self._merge(sym[has, best[has] - 1], new[has])
            has = np.flatnonzero(best < width - 2)
            piece[has, best[has]] = self._merge(new[has], sym[has, best[has] + 1])

    def _heap(self, word: str) -> list[int]:
        sym = [self.symbol.get(c, -1 - ord(c)) for c in word]
        before, after = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        agenda: list[tuple[float, int, int, int, int]] = []

        def put(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and sym[a] >= 0 and sym[b] >= 0 and (piece := self.pairs.get(sym[a] * self.symbols + sym[b])) is not None:
                heapq.heappush(agenda, (-self.score[piece], a, sym[a], sym[b], b))

        for i in range(len(sym) - 1):
            put(i, i + 1)
        gone = [False] * len(sym)
        while agenda:
            _, a, was_a, was_b, b = heapq.heappop(agenda)
            if gone[a] or gone[b] or sym[a] != was_a or sym[b] != was_b or after[a] != b:
                continue
            sym[a] = self.pairs[was_a * self.symbols + was_b]
            gone[b] = True
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            put(before[a], a)
            put(a, after[a])
        return [s for s, dead in zip(sym, gone, strict=True) if not dead]

    def encode_many(self, words: list[str]) -> list[list[int]]:
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        out: list[list[int]] = [[]] * len(words)
        for length, places in by_length.items():
            if not length:
                continue
            if length > WIDE:
                found = [self._heap(words[i]) for i in places]
            else:
                found = [s for at in range(0, len(places), 8192) for s in self._matrix([words[i] for i in places[at : at + 8192]])]
            for i, s in zip(places, found, strict=True):
                out[i] = s if min(s) >= 0 and max(s) < len(self.written) else [x for one in s for x in self._fallen(one)]
        return out

    def _fallen(self, symbol: int) -> list[int]:
        """Ids of a symbol; characters that are no piece become their bytes, or the unknown id in a vocabulary without bytes."""
        if 0 <= symbol < len(self.written):
            return [symbol]
        text = chr(-1 - symbol) if symbol < 0 else next(c for c, n in self.symbol.items() if n == symbol)
        return [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown]

    def learn(self, keys: list[str]) -> None:
        """Encode, decode and check words that aren't known yet."""
        if len(self.known) + len(keys) > REMEMBERED:
            self.known = {}
        found = self.encode_many([k if k[:1] == "\n" else MARK + k.replace(" ", MARK) for k in keys])
        for key, ids, own in zip(keys, found, self.library.encode(keys, num_threads=1), strict=True):
            right = own == (self.space + ids if key[:1] == "\n" else ids) if key else ids == self.space
            self.known[key] = (b",".join([self.written[i] for i in ids]), b"".join([self.plain[i] for i in ids]), right)

    def words(self, text: str) -> list[str]:
        """Keys of the words of a text, as they follow each other: a key stands for word mark and key, or, if it begins with a line feed, for itself."""
        parts = text.replace("\n", " \n").split(" ")
        if "" not in parts:
            return parts
        out, empty = [], 0
        for p in parts:
            if not p:
                empty += 1
            elif p[0] == "\n":
                if empty:
                    out.append(" " * (empty - 1))
                out.append(p)
                empty = 0
            else:
                out.append(" " * empty + p)
                empty = 0
        if empty:
            out.append(" " * (empty - 1))
        return out

    def code(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes, bool]]:
        """(number of ids, ids written with commas, decoded text, agreement with the library) of every text."""
        split = [self.words(t) if t else [] for t in texts]
        words = set().union(*split)
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            fresh = words
        if fresh:
            self.learn(list(fresh))
        get = self.known.__getitem__
        for keys in split:
            own, plain, right = zip(*map(get, keys), strict=True) if keys else ((), (), ())
            ids = b",".join(own)
            yield (ids.count(b",") + 1 if ids else 0), ids, b"".join(plain)[1:], all(right)


_CODECS: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    if model_path not in _CODECS:
        _CODECS[model_path] = Codec(model_path)
    return _CODECS[model_path]


def encode_decode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every whole text: (id_col, ids array<int>, decoded string, agrees boolean).

    A null or empty text has no ids and decodes to the empty string. Repeated rows are encoded
    each on their own; an empty table gives an empty result; other columns are ignored whatever
    their names. agrees is false where the library encodes some word of the text otherwise.
    """
    return _coded(docs, model_path or default_model(), id_col, text_col, "ids array<int>, decoded string", lambda n, ids, decoded: (np.array(ids.split(b",") if ids else [], dtype=np.int32), decoded.decode("utf-8", "replace")), [pa.list_(pa.int32()), pa.string()])


def digests(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256, agrees): the digests of encode_decode, without moving the ids out of Python."""
    return _coded(docs, model_path or default_model(), id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda n, ids, decoded: (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()), [pa.int64(), pa.string(), pa.string()])


def _coded(docs: DataFrame, model_path: str, id_col: str, text_col: str, columns: str, shape, types: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for part in slices(batches, "__text"):
            rows = [(*shape(n, ids, decoded), agrees) for n, ids, decoded, agrees in own.code(part.column(1).to_pylist())]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*types, pa.bool_()], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=[id_col, *[c.split()[0] for c in columns.split(", ")], "agrees"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, {columns}, agrees boolean")
