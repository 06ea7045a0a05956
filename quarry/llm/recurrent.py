"""Language-model scores from corpus counts and a gated recurrent network.

Token counts are gathered over all training documents. A gated recurrent unit over the most
frequent words (the rest share one symbol, and enter by their ending) is trained in numpy with
backpropagation truncated to WINDOW tokens, on the whole texts of all training documents: a hash
deals each document to one of a few rounds and to one shard of its round. Shards train side by
side, from the weights that the round before left, and their weights are averaged by tokens, in
a tree and in a fixed order; so the model depends on the documents, not on how rows fall into
partitions. The state starts anew with each document. The output softmax is factored into
classes. For scoring, the state is carried from window to window, so a document's score is that
of its whole text. The network is mixed with the counts, so that every word has a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, slices, staged

ALPHA = 0.1
#: Classes of the output layer, words of each; input and state size; endings that stand for rare words.
CLASSES, PER_CLASS, EMBED, HIDDEN, ENDINGS = 64, 64, 24, 32, 64
VOCABULARY = CLASSES * PER_CLASS
END, RARE = 0, 1
#: Tokens that gradients go back; streams trained side by side, and steps that each has at least where texts are few.
WINDOW, STREAMS, STEPS = 24, 256, 24
#: Tokens of a document, and documents, that are scored at once.
SCORED, ABREAST = 24, 512
#: States that are collected before their words are scored; equal words from which their rows are summed by themselves.
COLLECTED, MANY = 8192, 16
#: Scores of classes and words are cut here, so that no exponential overflows and none has to be shifted.
HIGHEST = 60.0
#: Share of the training documents that the rounds end with, and the size of steps in each.
ROUNDS, RATES, CLIP = (0.1, 0.25, 0.5, 1.0), (6e-3, 5e-3, 4e-3, 2e-3), 5.0
#: Tokens of a shard (more where that would make over MOST_SHARDS), tokens that are laid out at once, shards that are averaged together.
SHARD, MOST_SHARDS, LAID_OUT, AVERAGED = 1_500_000, 65_536, 400_000, 64
#: Tokens of a document from which it counts as long; tokens that are scored side by side.
LONG, HELD = 1500, 600_000
#: Weight of the network in the mixture with the counts.
MIXED = 0.9
#: Most frequent words, at most, whose counts every task holds; the others are joined.
HEAD = 250_000


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(lower-cased (A-Z) words of binary texts end to end, where the words of each text begin and the last ones end); each text has one more token, its end."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    split = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.Array.from_buffers(pa.string(), len(texts), texts.buffers())))
    words, cuts = split.flatten(), split.offsets.to_numpy()
    there = np.concatenate([[0], np.cumsum(pa.compute.binary_length(words).to_numpy() > 0)])  # blanks at the ends of a text leave empty words
    if there[-1] < len(words):
        words = words.filter(pa.compute.not_equal(words, ""))
    return words.cast(pa.binary()), there[cuts]


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from; a null id is not held out."""
    return F.coalesce(crc_mod(F.col(id_col), 10) == 0, F.lit(False))


def token_counts(texts: DataFrame) -> DataFrame:
    """(token binary, c) over all texts (one binary column); partial counts are made before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def flush() -> pa.RecordBatch:
            found = pa.compute.value_counts(pa.chunked_array(held, pa.binary()))
            held.clear()
            return pa.RecordBatch.from_arrays(found.flatten(), names=["token", "c"])

        for part in slices(batches, "text", 8 << 20):
            words, _ = tokens_of(part.column(0))
            held.append(words)
            ends += len(part)
            size += words.nbytes
            if size > 64 << 20:
                yield flush()
                size = 0
        if held:
            yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], names=["token", "c"])

    return texts.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, lengths) of stretches of equal values, longest first."""
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    n = np.diff(np.append(begins, len(values)))
    order = np.argsort(-n, kind="stable")
    return begins[order], n[order]


def _anew(keep: np.ndarray) -> dict[int, np.ndarray]:
    """By step, the places at which a document begins."""
    step, place = np.nonzero(keep == 0)
    cuts = np.flatnonzero(step[1:] != step[:-1]) + 1
    return {int(step[i]): p for i, p in zip(np.append(0, cuts), np.split(place, cuts), strict=True)} if len(step) else {}


def _sums(rows: np.ndarray, begins: np.ndarray, n: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Sums (K x stretches x wide) of stretches of rows (K x N x wide), which are in this order; longest first."""
    order = np.arange(rows.shape[1]) if order is None else order
    out = rows.take(order[begins], axis=1)
    many = int(np.searchsorted(-n, -MANY, side="right"))
    for k in range(many):
        own = rows.take(order[begins[k] : begins[k] + n[k]], axis=1)
        np.matmul(np.ones(n[k], dtype=rows.dtype), own, out=out[:, k])
    for step in range(1, int(n[many]) if many < len(n) else 0):
        go_on = int(np.searchsorted(-n, -step, side="left"))  # stretches of more than step rows
        out[:, many:go_on] += rows.take(order[begins[many:go_on] + step], axis=1)
    return out


@dataclass
class Network:
    """Weights, all in one vector, so that tasks can average them."""

    vector: np.ndarray
    parts: dict[str, np.ndarray] = field(default_factory=dict)
    squares: np.ndarray | None = None  # of gradients so far, by which steps are sized, and how many there were
    updates: int = 0
    room: dict[str, np.ndarray] = field(default_factory=dict)  # memory that windows use again

    SHAPES = {"embed": (VOCABULARY + ENDINGS, EMBED), "w": (EMBED, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "class_w": (HIDDEN, CLASSES), "class_b": (CLASSES,), "word_w": (CLASSES, HIDDEN, PER_CLASS), "word_b": (CLASSES, PER_CLASS)}

    @classmethod
    def fresh(cls, seed: int = 1) -> Network:
        size = sum(int(np.prod(s)) for s in cls.SHAPES.values())
        net = cls(np.zeros(size, dtype=np.float32))
        rng = np.random.default_rng(seed)
        for name, part in net.split(net.vector).items():
            if not name.endswith("b"):
                part[...] = rng.normal(0, 0.1 if name == "embed" else HIDDEN**-0.5, part.shape)
        return net

    @classmethod
    def split(cls, vector: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            out[name] = vector[at : at + n].reshape(shape)
            at += n
        return out

    def __post_init__(self):
        self.parts = self.split(self.vector)

    def _space(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.room or len(self.room[name]) < size:
            self.room[name] = np.empty(size, dtype=self.vector.dtype)
        return self.room[name][:size].reshape(shape)

    def gates(self, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What every input, or each of some, adds to the gates (3 x words x HIDDEN, with their bias) and the weights of the state (3 x HIDDEN x HIDDEN). Two gates are negated and the third is doubled, as their functions take them by way of exp."""
        p = self.parts
        signs = np.array([-1, -1, 2], dtype=self.vector.dtype)[:, None, None]
        w, u = (np.ascontiguousarray(p[k].reshape(-1, 3, HIDDEN).transpose(1, 0, 2)) * signs for k in "wu")
        embed = p["embed"] if words is None else p["embed"][words]
        table = np.matmul(embed, w, out=self._space("table", 3, len(embed), HIDDEN))
        table += p["b"].reshape(3, 1, HIDDEN) * signs
        return table, u

    def forward(self, inputs: np.ndarray, state: np.ndarray, kept: list | None = None, keep: np.ndarray | None = None, gates: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each of T inputs (T x B), from a state (B x HIDDEN), and the last one; keep (T x B) is 0 where a document begins; gates() of the present weights may be given. The states lie in memory that the next call uses again.

        Inside, gates lie behind each other (3 x B x HIDDEN), so that each of them is one stretch of memory.
        """
        table, u = gates or self.gates()
        steps, wide = inputs.shape
        out = self._space("out", steps, wide, HIDDEN)
        held = steps if kept is not None else 1
        every_a, every_g, states = self._space("a", held, 3, wide, HIDDEN), self._space("g", held, 3, wide, HIDDEN), self._space("states", held, wide, HIDDEN)
        part = self._space("part", wide, HIDDEN)
        anew = _anew(keep) if keep is not None else {}
        with np.errstate(over="ignore"):  # a gate that is shut has 1 / infinity
            for t in range(steps):
                at = t if kept is not None else 0
                if kept is not None or t in anew:
                    states[at] = state
                    state = states[at]
                if t in anew:
                    state[anew[t]] = 0
                a = table.take(inputs[t], axis=1, out=every_a[at], mode="clip")
                g = np.matmul(state, u, out=every_g[at])
                zr = a[:2]
                zr += g[:2]
                np.exp(zr, out=zr)
                zr += 1
                np.divide(1, zr, out=zr)
                z, r, n, gn = zr[0], zr[1], a[2], g[2]
                n += np.multiply(r, gn, out=part)
                np.exp(n, out=n)
                n += 1
                np.divide(-2, n, out=n)
                n += 1
                if kept is not None:
                    kept.append((state, z, r, n, gn))
                after = np.subtract(state, n, out=out[t])
                after *= z
                after += n
                state = after
        return out, state.copy()

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P of each target after each state (rows); with grads, also adds gradients of the sum of -ln P and returns those of the states.

        Rows are taken in the order of their targets, so that those of a class are one stretch.
        """
        p = self.parts
        if not len(targets):
            return np.zeros(0, dtype=states.dtype), None if grads is None else np.zeros_like(states)
        size = len(targets)
        order = np.argsort(targets.astype(np.uint16), kind="stable")
        y = targets[order].astype(np.int64)
        of, own = y // PER_CLASS, y % PER_CLASS
        there = states.take(order, axis=0, out=self._space("there", size, HIDDEN), mode="clip")
        top = max(float(there.max()), -float(there.min()))
        edges = np.searchsorted(of, np.arange(CLASSES + 1)).tolist()
        classes = [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES) if edges[c] < edges[c + 1]]
        e, total, at = self._space("e", size, PER_CLASS), np.empty(size, dtype=states.dtype), np.arange(size) * PER_CLASS
        scaled, more = (self._space(k, size, HIDDEN) for k in ("scaled", "more"))
        back = self._space("back", size, HIDDEN)
        ln = 0

        def low(w: np.ndarray, b: np.ndarray) -> bool:  # no score can come near HIGHEST
            return top * float(np.abs(w).sum(axis=-2).max()) + float(np.abs(b).max()) < HIGHEST

        def shares() -> np.ndarray:  # what each row's e has to be divided by
            inverse = 1 / total
            np.multiply(there, inverse[:, None], out=scaled)
            return inverse

        # first the class, then the word within it: e * weights / total are the probabilities
        w, b = p["class_w"], p["class_b"]
        np.matmul(there, w, out=e)
        weights = np.exp(b)
        if not low(w, b):
            e += b
            np.minimum(e, HIGHEST, out=e)
            weights, b = np.ones_like(b), np.zeros_like(b)
        ln = e.ravel().take(at + of) + b[of]
        np.exp(e, out=e)
        np.matmul(e, weights, out=total)
        ln -= np.log(total)
        if grads is not None:
            inverse = shares()
            grads["class_w"] += (scaled.T @ e) * weights
            grads["class_b"] += (inverse @ e) * weights
            np.matmul(e, (w * weights).T, out=back)
            back *= inverse[:, None]
        w, b = p["word_w"], p["word_b"]
        for c, mine in classes:
            np.matmul(there[mine], w[c], out=e[mine])
        weights = np.exp(b)
        if not low(w, b):
            e += b[of]
            np.minimum(e, HIGHEST, out=e)
            weights, b = np.ones_like(b), np.zeros_like(b)
        ln += e.ravel().take(at + own)
        ln += b.ravel().take(y)
        np.exp(e, out=e)
        for c, mine in classes:
            np.matmul(e[mine], weights[c], out=total[mine])
        ln -= np.log(total)
        out = np.empty_like(ln)
        out[order] = ln
        if grads is None:
            return out, None
        inverse = shares()
        d_w, d_b = np.zeros_like(w), np.zeros_like(b)
        weighed = np.ascontiguousarray((w * weights[:, None]).transpose(0, 2, 1))
        for c, mine in classes:
            held = e[mine]
            np.matmul(scaled[mine].T, held, out=d_w[c])
            np.matmul(inverse[mine], held, out=d_b[c])
            np.matmul(held, weighed[c], out=more[mine])
        d_w *= weights[:, None]
        d_b *= weights
        grads["word_w"] += d_w
        grads["word_b"] += d_b
        more *= inverse[:, None]
        back += more
        heads, n = _stretches(y)  # what the targets themselves add, one row for each that occurs
        (sums,) = _sums(there[None], heads, n)
        c, word = of[heads], own[heads]
        grads["word_w"][c, :, word] -= sums
        grads["word_b"][c, word] -= n
        one = (np.arange(CLASSES)[:, None] == c).astype(sums.dtype)
        grads["class_w"] -= (one @ sums).T
        grads["class_b"] -= one @ n.astype(sums.dtype)
        towards = p["class_w"].T[c] + p["word_w"][c, :, word]
        number = np.argsort(heads, kind="stable")
        back -= towards.take(np.repeat(number, n[number]), axis=0, out=more, mode="clip")
        given = self._space("given", size, HIDDEN)
        given[order] = back
        return out, given

    def gradients(self, x: np.ndarray, y: np.ndarray, state: np.ndarray, keep: np.ndarray, flat: np.ndarray) -> tuple[float, np.ndarray]:
        """Adds the gradients of the sum of -ln P of the targets of a window to flat; returns that sum and the last state."""
        p, grads = self.parts, self.split(flat)
        kept: list = []
        order = np.argsort(x.ravel().astype(np.uint16), kind="stable")
        words = x.ravel()[order]
        heads, times = _stretches(words)
        words = words[heads]
        number = np.empty(x.size, dtype=np.int64)
        by_place = np.argsort(heads)
        number[order] = np.repeat(by_place, times[by_place])
        states, last = self.forward(number.reshape(x.shape), state, kept, keep, self.gates(words))
        ln, back = self.log_probs(states.reshape(-1, HIDDEN), y.ravel(), grads)
        back = back.reshape(*y.shape, HIDDEN)
        d_a = self._space("d_a", 4, *x.shape, HIDDEN)  # of the new state's share of the state before, of both gates, of the new state
        rest, three = self._space("rest", x.shape[1], HIDDEN), self._space("three", 3, x.shape[1], HIDDEN)
        u = np.ascontiguousarray(p["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0)[[2, 0, 1]])
        carried, anew = np.zeros_like(state), _anew(keep)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, gn = kept[t]  # gn is doubled
            d = carried
            d += back[t]
            through, d_z, d_r, d_n = d_a[:, t]
            np.subtract(1, z, out=rest)
            rest *= d
            np.multiply(n, n, out=d_n)
            np.subtract(1, d_n, out=d_n)
            d_n *= rest
            np.subtract(h, n, out=d_z)
            d_z *= z
            d_z *= rest
            np.multiply(d_n, r, out=through)
            np.subtract(1, r, out=d_r)
            d_r *= 0.5
            d_r *= gn
            d_r *= through
            d *= z
            for more in np.matmul(d_a[:3, t], u, out=three):
                d += more
            if t in anew:
                d[anew[t]] = 0
        before = self._space("states", *x.shape, HIDDEN).reshape(-1, HIDDEN)  # as forward left them
        d_a = d_a.reshape(4, -1, HIDDEN)
        grads["u"] += np.matmul(before.T, d_a[:3])[[1, 2, 0]].transpose(1, 0, 2).reshape(HIDDEN, -1)
        sums = _sums(d_a[1:], heads, times, order).transpose(1, 0, 2).reshape(len(words), -1)
        grads["b"] += sums.sum(axis=0)
        grads["w"] += p["embed"][words].T @ sums
        grads["embed"][words] += sums @ p["w"].T
        return -float(ln.sum()), last

    def train(self, documents: list[tuple[np.ndarray, np.ndarray]], rate: float = RATES[0]) -> int:
        """One pass over (inputs, targets) of documents, put end to end into streams, the last of which is filled up from the first; returns the number of tokens."""
        if not documents:
            return 0
        inputs = np.concatenate([d[0] for d in documents])
        targets = np.concatenate([d[1] for d in documents])
        begins = np.zeros(len(inputs), dtype=bool)
        begins[np.cumsum([0, *[len(d[0]) for d in documents[:-1]]])] = True
        streams = max(1, min(STREAMS, len(inputs) // (WINDOW * STEPS)))
        tokens, steps = len(inputs), -(-len(inputs) // streams)
        inputs, targets, begins = (np.resize(x, steps * streams).reshape(streams, steps).T for x in (inputs, targets, begins))
        keep = np.where(begins, 0, 1).astype(self.vector.dtype)
        keep[0] = 0
        state = np.zeros((streams, HIDDEN), dtype=self.vector.dtype)
        flat, work = np.zeros_like(self.vector), np.empty_like(self.vector)
        if self.squares is None:
            self.squares = np.zeros_like(self.vector)
        for at in range(0, steps, WINDOW):
            flat[...] = 0
            x = inputs[at : at + WINDOW]
            _, state = self.gradients(x, targets[at : at + WINDOW], state, keep[at : at + WINDOW], flat)
            flat /= streams
            size = float(np.sqrt(flat @ flat))
            if size > CLIP:
                flat *= CLIP / size
            np.multiply(flat, flat, out=work)
            work *= 0.02
            self.squares *= 0.98
            self.squares += work
            self.updates += 1
            np.sqrt(self.squares, out=work)
            work *= (1 - 0.98**self.updates) ** -0.5
            work += 1e-4
            np.divide(flat, work, out=work)
            work *= rate
            self.vector -= work
        return tokens


@dataclass
class Model:
    """Network and counts: all that scoring needs, of bounded size."""

    counts: dict[bytes, int]  # of the most frequent tokens
    numbers: dict[bytes, int]  # the network's vocabulary
    train_tokens: int
    types: int
    rest: float  # ln of the mass that words outside the vocabulary have by the counts
    network: Network
    looked_up: tuple | None = None  # see tables

    def __getstate__(self):
        return self.__dict__ | {"looked_up": None}

    @property
    def norm(self) -> float:
        return self.train_tokens + ALPHA * (self.types + 1)

    def tables(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(held words, what each is as an input of the network, their counts); worked out once in a process."""
        if self.looked_up is None:
            words = [w for w in self.counts if w]
            seen = np.fromiter((self.numbers[w] if w in self.numbers else _ending(w) for w in words), dtype=np.uint16, count=len(words))
            self.looked_up = pa.array(words, pa.binary()), seen, np.fromiter(map(self.counts.__getitem__, words), dtype=np.int64, count=len(words))
        return self.looked_up

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, counts): what each word is as an input of the next one (uint16), and its count, 0 where it isn't held."""
        held, seen, counts = self.tables()
        at = pa.compute.fill_null(pa.compute.index_in(words, value_set=held), len(held)).to_numpy()
        inputs, c = np.append(seen, np.uint16(0))[at], np.append(counts, 0)[at]
        other = np.flatnonzero(at == len(held))
        if len(other):
            inputs[other] = [_ending(w) for w in words.take(pa.array(other)).to_pylist()]
        return inputs, c


def _pair(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of a document: each word but the last is an input of the next; the first input is the end of what was before."""
    inputs = np.empty(len(seen), dtype=np.int32)
    inputs[0], inputs[1:] = END, seen[:-1]
    targets = seen.astype(np.int32)
    targets[seen >= VOCABULARY] = RARE
    return inputs, targets


def _ending(word: bytes) -> int:
    """The input that stands for a word outside the network's vocabulary."""
    return VOCABULARY + (word[-1] * 31 + (word[-2] if len(word) > 1 else 7)) % ENDINGS


def _vocabulary(counts: dict[bytes, int]) -> dict[bytes, int]:
    top = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[: VOCABULARY - 2]
    return {b"": END} | {w: n for n, w in enumerate(top, 2)}


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """(model, written table of all token counts). train holds the documents that may be learned from: all their whole texts are counted and trained on."""
    model, counts = _counted(train, text_col)
    return _trained(staged(_encoded(train, model, id_col, text_col).select("words", "at"), "encoded"), model), counts


def fit_and_score(docs: DataFrame, learned, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score of docs by what fit learns from those where learned (a column) is true; texts are taken apart once for both."""
    model, counts = _counted(docs.where(learned), text_col)
    encoded = staged(_encoded(docs, model, id_col, text_col, learned), "encoded")
    return _scored(encoded, _trained(encoded.where("learned"), model), counts, id_col)


def _counted(train: DataFrame, text_col: str) -> tuple[Model, DataFrame]:
    """(model with a network that hasn't learned yet, written table of all token counts)."""
    counts = staged(token_counts(train.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    steps = sorted((r["step"], r["n"]) for r in counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("step")).agg(F.count("*").alias("n")).collect())
    least, held = 0, total[1]
    for step, n in steps:  # leave the least frequent words out until the rest is few enough
        if held <= HEAD:
            break
        held, least = held - n, step + 1
    head = counts.where(F.floor(F.log2("c") * 8) >= least).toArrow()
    known = dict(zip(head.column(0).to_pylist(), head.column(1).to_pylist(), strict=True))
    numbers = _vocabulary(known)
    model = Model(known, numbers, int(total[0]), int(total[1]), 0.0, Network.fresh())
    inside = sum((known.get(w, 0) + ALPHA) / model.norm for w in numbers)
    model.rest = float(np.log(max(1 - inside, 1e-12)))
    return model, counts


def _encoded(docs: DataFrame, model: Model, id_col: str, text_col: str, learned=None) -> DataFrame:
    """(id, row, at, learned, n_tokens, n_known, base, words, tail) of every text: its words as inputs of the network (uint16), what the counts say of them, and the words that model doesn't hold, which counts have to price."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most HEAD counts and a network of fixed size
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = sent.value
        whole, number = len(own.counts) == own.types, TaskContext.get().partitionId() << 36
        log_norm = np.log(own.norm)
        for part in slices(batches, "text", 8 << 20):
            words, cuts = tokens_of(part.column("text"))
            ends = cuts + np.arange(len(cuts))  # with the end of each text
            seen, c = np.full(ends[-1], END, dtype=np.uint16), np.full(ends[-1], own.counts.get(b"", 0), dtype=np.int64)
            place = np.arange(len(words)) + np.repeat(np.arange(len(part)), np.diff(cuts))
            seen[place], c[place] = own.encode(words)
            starts = ends[:-1]
            base = np.log(c + ALPHA) - log_norm
            other = np.zeros(0, dtype=np.int64)
            if not whole:
                other = np.flatnonzero(c == 0)
                base[other] = 0.0  # priced by counts
            at = np.searchsorted(place, other)
            at[~np.isin(other, place)] = len(words)  # ends, where few texts are learned from
            tails = pa.StructArray.from_arrays([pa.concat_arrays([words, pa.array([b""], pa.binary())]).take(pa.array(at)), pa.array(np.ones(len(other), dtype=np.int64))], names=["token", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(other, ends).astype(np.int32)), tails)
            packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(seen)])
            columns = [part.column("id"), pa.array(np.arange(number, number + len(starts))), part.column("at"), part.column("learned"), pa.array(np.diff(ends)), pa.array(np.add.reduceat(c > 0, starts, dtype=np.int64)), pa.array(np.add.reduceat(base, starts)), packed, lists]
            number += len(starts)
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "at", "learned", "n_tokens", "n_known", "base", "words", "tail"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), (F.lit(True) if learned is None else learned).alias("learned"))
    return texts.withColumn("at", F.xxhash64("id", "text")).mapInArrow(run, f"id {kind}, row long, at long, learned boolean, n_tokens long, n_known long, base double, words binary, tail array<struct<token:binary,n:long>>")


def _trained(documents: DataFrame, model: Model) -> Model:
    """model with the network that the rounds over documents (words, at) leave."""
    begin = 0.0
    for end, rate in zip(ROUNDS, RATES, strict=True):
        place = F.shiftrightunsigned("at", 33)  # 31 bits say which round, the others which shard
        mine = documents.where((place >= int(begin * 2**31)) & (place < int(end * 2**31)))
        model.network = _round(mine, model.network, rate, max(1, round(model.train_tokens * (end - begin))))
        begin = end
    return model


def _round(documents: DataFrame, network: Network, rate: float, tokens: int) -> Network:
    """The network after one round over documents (words, at), about so many tokens: shards train side by side from network's weights."""
    sent = documents.sparkSession.sparkContext.broadcast(network.vector)
    shards = min(-(-tokens // SHARD), MOST_SHARDS)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, done, waiting, size = None, None, 0, [], 0

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int64()), "tokens": pa.array([done], pa.int64()), "weights": pa.array([own.vector.tobytes()], pa.binary())})

        for part in slices(batches, "words"):
            for shard, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if shard != now or size >= LAID_OUT:
                    done += own.train(waiting, rate) if waiting else 0
                    waiting, size = [], 0
                if shard != now:
                    if own is not None:
                        yield result()
                    now, own, done = shard, Network(sent.value.copy()), 0
                waiting.append(_pair(np.frombuffer(words, dtype=np.uint16)))
                size += len(waiting[-1][0])
        if own is not None:
            done += own.train(waiting, rate)
            yield result()

    def mean(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("shard").to_numpy(), kind="stable").tolist()
        tokens_ = rows.column("tokens").to_pylist()
        total = np.zeros(len(sent.value))
        for i in order:
            total += tokens_[i] * np.frombuffer(rows.column("weights")[i].as_buffer(), dtype=np.float32)
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py() // AVERAGED], pa.int64()), "tokens": pa.array([sum(tokens_)], pa.int64()), "weights": pa.array([(total / sum(tokens_)).astype(np.float32).tobytes()], pa.binary())})

    shape = "shard long, tokens long, weights binary"
    dealt = documents.select(F.pmod("at", F.lit(shards)).alias("shard"), "words", "at")
    trained = dealt.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "at").select("shard", "words").mapInArrow(refine, shape)
    trained = staged(trained, "trained")
    while shards > 1:
        trained = trained.groupBy(F.floor(F.col("shard") / AVERAGED).alias("group")).applyInArrow(mean, shape)
        shards = -(-shards // AVERAGED)
    found = trained.collect()
    return Network(np.frombuffer(bytes(found[0]["weights"]), dtype=np.float32).copy()) if found else network


def _window_scores(net: Network, inputs: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """ln P by the network of every token of documents, end to end; documents run side by side, longest first, with their states carried on."""
    sizes = np.array([len(x) for x in inputs])
    longest = np.argsort(-sizes, kind="stable")
    begins = np.cumsum(sizes) - sizes
    flat_x, flat_y = np.concatenate(inputs), np.concatenate(targets)
    out = np.empty(len(flat_x), dtype=np.float32)
    gates = net.gates()
    held, places, size = np.empty((COLLECTED + ABREAST * SCORED, HIDDEN), dtype=np.float32), [], 0

    def flush():
        where = np.concatenate(places)
        out[where] = net.log_probs(held[: len(where)], flat_y[where])[0]
        places.clear()

    for first in range(0, len(longest), ABREAST):
        order = longest[first : first + ABREAST]
        begin, lengths = begins[order], sizes[order]
        state = np.zeros((len(order), HIDDEN), dtype=np.float32)
        for at in range(0, int(lengths[0]), SCORED):
            n = int(np.searchsorted(-lengths, -at, side="left"))  # documents that go on
            steps = np.arange(at, min(at + SCORED, int(lengths[0])))[:, None]
            there = steps < lengths[:n]
            where = np.where(there, begin[:n] + steps, 0)
            states, state = net.forward(flat_x[where], state[:n], gates=gates)
            rows = np.flatnonzero(there)
            places.append(where.ravel()[rows])
            states.reshape(-1, HIDDEN).take(rows, axis=0, out=held[size : size + len(rows)], mode="clip")
            size += len(rows)
            if size >= COLLECTED:
                flush()
                size = 0
    if places:
        flush()
    return out


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) of every whole text, one row a row.

    Scores are log10 probabilities. A null or empty text is its end alone. Repeated rows are
    scored each; an empty table gives an empty result; other columns are ignored whatever their
    names. With nothing to learn from, every token has the mass of an unseen word.
    """
    return _scored(staged(_encoded(docs, model, id_col, text_col), "encoded"), model, counts, id_col)


def _scored(encoded: DataFrame, model: Model, counts: DataFrame, id_col: str) -> DataFrame:
    """score of a written table that _encoded made."""
    kind = dict(encoded.dtypes)["id"]
    known = np.zeros(VOCABULARY)
    for w, n in model.numbers.items():
        known[n] = model.counts.get(w, 0)
    by_counts = np.log(known + ALPHA) - np.log(model.norm)
    by_counts[RARE] = model.rest  # a rare word shares the network's probability by its share of the counts
    sent = encoded.sparkSession.sparkContext.broadcast((model.network.vector, by_counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, by_counts = Network(sent.value[0]), sent.value[1]
        waiting: dict[bool, list[tuple]] = {False: [], True: []}  # short and long documents, so that those which run side by side are alike
        kind_, held = None, {False: 0, True: 0}

        def flush(some: list[tuple]) -> pa.RecordBatch:
            doc_ids, numbers, sizes, seen_known, base, words = zip(*some, strict=True)
            inputs, targets = zip(*[_pair(np.frombuffer(w, dtype=np.uint16)) for w in words], strict=True)
            # the network's and the counts' probabilities are mixed, as a multiple of the counts'
            ln = _window_scores(network, inputs, targets) - by_counts[np.concatenate(targets)]
            np.exp(ln, out=ln)
            ln *= MIXED
            ln += 1 - MIXED
            np.log(ln, out=ln)
            own = np.add.reduceat(ln, np.cumsum(sizes) - sizes) + base
            some.clear()
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, kind_), pa.array(numbers, pa.int64()), pa.array(sizes, pa.int64()), pa.array(seen_known, pa.int64()), pa.array(base, pa.float64()), pa.array(own)], names=["id", "row", "n_tokens", "n_known", "base", "own"])

        for part in slices(batches, "words"):
            kind_ = part.schema.field(0).type
            for one in zip(*(c.to_pylist() for c in part.columns), strict=True):
                side = one[2] > LONG
                waiting[side].append(one)
                held[side] += one[2]
                if held[side] > HELD:
                    yield flush(waiting[side])
                    held[side] = 0
        for some in waiting.values():
            if some:
                yield flush(some)

    first = encoded.select("id", "row", "n_tokens", "n_known", "base", "words").mapInArrow(run, f"id {kind}, row long, n_tokens long, n_known long, base double, own double")
    if len(model.counts) < model.types:
        first = staged(first, "scored")
        tail = encoded.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.n").join(counts, "token", "left")
        c = F.coalesce("c", F.lit(0))
        priced = tail.groupBy("row").agg(F.sum(F.col("n") * (F.log(c + ALPHA) - float(np.log(model.norm)))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
        first = first.join(priced, "row", "left")
    else:
        first = first.withColumns({"more": F.lit(0.0), "known": F.lit(0)})
    ten = float(np.log(10))
    more, known_ = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return first.select(F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + known_).cast("long").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), ((F.col("base") + more) / ten).alias("base_score"), ((F.col("own") + more) / ten).alias("score"))
