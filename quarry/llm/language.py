"""Language identification with string kernels.

The kernel of two texts is the normalised number of character n-grams, of all lengths up to
N_GRAM, that both have (a blended spectrum with presence instead of counts). Nystroem's method
stands in for all pairs: each text is described by its kernels with a few landmark texts, and
kernel ridge regression, one language against the rest, is solved in that description. Fitting
takes a bounded sample; predictions run over whole texts as batched matrix products.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import MIX_1, crc_mod, slices

#: Longest n-grams, slots that n-grams are hashed to, landmarks of each language, and of all together.
N_GRAM, SLOTS, LANDMARKS, ALL_LANDMARKS = 3, 1 << 14, 24, 512
#: Labelled texts of each language that fitting takes at most.
FIT_TEXTS = 400
RIDGE = 1e-3
UNKNOWN = "und"

#: Letters and marks of the first plane, lower-cased; anything else there is a space. Of the others, only symbols (emoji) are.
_LETTER = np.array([ord(chr(c).lower()[0]) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LM" else 32 for c in range(0x10000)], dtype=np.uint32)
_SYMBOLS = (0x1F000, 0x20000)


def presence(texts: list[str]) -> np.ndarray:
    """Rows of 0 and 1: which n-gram slots each text has. Characters that are no letters count as spaces."""
    out = np.zeros((len(texts), SLOTS), dtype=np.float32)
    flat = out.ravel()
    codes = np.frombuffer("".join([t + " " for t in texts]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = codes < 0x10000
    codes = np.where(low, _LETTER[np.where(low, codes, 0)], np.where((codes >= _SYMBOLS[0]) & (codes < _SYMBOLS[1]), 32, codes)).astype(np.uint64)
    lengths = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), lengths + 1) if len(texts) else np.zeros(0, dtype=np.int64)
    base = row * SLOTS
    key = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, N_GRAM + 1):  # a gram may reach into the space between two texts, not into the next one
        key = (key[: len(codes) - n + 1] * np.uint64(0x110000) + codes[n - 1 :]) if n > 1 else codes.copy()
        if not len(key):
            break
        slot = ((key * MIX_1 + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        inside = row[: len(key)] == row[n - 1 :]
        flat[(base[: len(key)] + slot.astype(np.int64))[inside]] = 1.0
    return out


@dataclass
class Classifier:
    languages: list[str]
    landmarks: np.ndarray  # unit rows over the slots
    weights: np.ndarray  # landmarks x languages

    def scores(self, texts: list[str]) -> np.ndarray:
        x = presence(texts)
        return self.kernel(x) @ self.weights

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.landmarks.T) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_texts: int = FIT_TEXTS) -> Classifier:
    """Fit on at most fit_texts whole texts of every language, taken in the order of a hash.

    Tasks turn the texts that are taken into presence bits (SLOTS bits a text), which alone reach
    the driver. One job counts the languages, one takes their texts. Rows with a null or
    letterless text or a null language are left out.
    """
    fine = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("at"))
    counts = {r["lang"]: r["count"] for r in fine.groupBy("lang").count().collect()}
    if not counts:
        return Classifier([], np.zeros((0, SLOTS), dtype=np.float32), np.zeros((0, 0), dtype=np.float32))
    # more than are wanted pass, so that enough are there; of a language with fewer, all do
    least = {k: int(min((1.25 * fit_texts + 50) / n, 1) * 2**64) - 2**63 - 1 for k, n in counts.items()}
    limits = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices((c for b in batches for c in _rows(b, 128)), "text"):
            packed = np.packbits(presence(part.column(1).to_pylist()).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in packed], pa.binary())], names=["lang", "at", "bits"])

    taken: dict[str, list[tuple[int, bytes]]] = {}
    for r in fine.where(F.col("at") <= F.element_at(limits, F.col("lang"))).mapInArrow(bits, "lang string, at long, bits binary").collect():
        taken.setdefault(r["lang"], []).append((r["at"], bytes(r["bits"])))
    languages = sorted(taken)
    x, target, marks = [], [], []
    for n, k in enumerate(languages):
        own = np.unpackbits(np.array([np.frombuffer(b, dtype=np.uint8) for _, b in sorted(taken[k])[:fit_texts]]), axis=1)
        x.append(own)
        target += [n] * len(own)
        richest = np.argsort(-own.sum(axis=1, dtype=np.int64), kind="stable")
        marks.append(own[richest[: max(2, min(LANDMARKS, ALL_LANDMARKS // len(languages)))]])
    marks = np.concatenate(marks).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]
    model = Classifier(languages, marks, np.zeros((len(marks), len(languages)), dtype=np.float32))
    k_nm = np.concatenate([model.kernel(own[a : a + 256].astype(np.float32)) for own in x for a in range(0, len(own), 256)]).astype(np.float64)
    k_mm = (marks @ marks.T).astype(np.float64)
    y = np.where(np.array(target)[:, None] == np.arange(len(languages)), 1.0, -1.0)
    each = 1.0 / np.bincount(target, minlength=len(languages))[target]  # languages weigh alike
    gram = k_nm.T @ (k_nm * each[:, None]) + RIDGE * k_mm + 1e-9 * np.eye(len(k_mm))
    model.weights = np.linalg.lstsq(gram, k_nm.T @ (y * each[:, None]), rcond=None)[0].astype(np.float32)
    return model


def predict(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns lang and score (0 to 1) added; a text that is null or has no letter, or a model without languages, gives und and 0.

    Whole texts are read. Repeated rows are predicted each on their own; an empty table gives an
    empty result; columns of docs pass through, except that those of the names lang and score are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # at most ALL_LANDMARKS (or two a language) x SLOTS floats
    kept = docs.drop(lang, score).withColumn("__text", F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in slices((c for b in batches for c in _rows(b, 128)), "__text"):
            texts = part.column(part.schema.get_field_index("__text")).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            there = [i for i, t in enumerate(texts) if t] if own.languages else []
            if there:
                f = own.scores([texts[i] for i in there])
                best = f.argmax(axis=1)
                for i, b, s in zip(there, best, np.clip((f[np.arange(len(there)), best] + 1) / 2, 0, 1), strict=True):
                    langs[i], scores[i] = own.languages[b], float(s)
            keep = [i for i, name in enumerate(part.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.array(langs, pa.string()), pa.array(scores)], names=[*[part.schema.names[i] for i in keep], lang, score])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c not in (lang, score))
    return kept.mapInArrow(run, f"{schema}, `{lang}` string, `{score}` double")


def _rows(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from; a null id is not held out."""
    return F.coalesce(crc_mod(F.col(id_col), 3) == 1, F.lit(False))
