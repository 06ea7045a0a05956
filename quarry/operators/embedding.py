"""Embedders, and a deterministic one: words are hashed to buckets. It stands in where no model is at hand."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quarry.errors import InvalidArgument, WrongAnswer
from quarry.functions import text

DIMENSION = 384
WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def bucket(word: Column) -> Column:
    return F.conv(F.substring(F.md5(F.encode(word, "UTF-8")), 1, 7), 16, 10).cast("long") % DIMENSION


def weights(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, bucket, weight): sparse unit vectors."""
    words = docs.select(key, F.explode(text.words(F.lower(text_col))).alias("word"))
    counts = words.groupBy(key, bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norms, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


def nearest_by_hash(docs: DataFrame, query: DataFrame, key: str, limit: int, text_col: str = "text") -> DataFrame:
    """The limit texts closest to the query text; scores that agree to nine digits are ties, which the smaller key wins.

    The query has at most DIMENSION weights, which become a literal. A text is scored within its row, so tasks
    hold one text at a time and only scores are sorted. Rows that repeat a key are one text: they alone are
    exploded and aggregated by bucket.
    """
    asked = {r["bucket"]: r["weight"] for r in weights(query, key, text_col).groupBy("bucket").agg(F.sum("weight").alias("weight")).collect()}
    weight = F.array(*[F.lit(float(asked.get(n, 0.0))) for n in range(DIMENSION)])
    repeated = docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("__again"))
    once, again = docs, None
    if not repeated.isEmpty():
        same = docs[key].eqNullSafe(F.col("__again"))
        once, again = docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")
    placed = once.select(key, F.sort_array(F.transform(text.words(F.lower(text_col)), bucket)).alias("__buckets"))
    product = F.aggregate("__buckets", F.lit(0.0), lambda total, b: total + F.get(weight, b.cast("int")))
    none = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("squares"))

    def step(done, b):  # a run of n equal buckets adds 1 + 3 + ... + (2 n - 1), which is n * n
        run = F.when(b == done["last"], done["run"] + 1).otherwise(F.lit(0).cast("long"))
        return F.struct(b.alias("last"), run.alias("run"), (done["squares"] + 2 * run + 1).cast("long").alias("squares"))

    scored = placed.select(key, product.alias("product"), F.aggregate("__buckets", none, step, lambda done: done["squares"]).alias("squares"))
    if again is not None:
        words = again.select(key, F.explode(text.words(F.lower(text_col))).alias("word"))
        counts = words.groupBy(key, bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("n"))
        scored = scored.unionByName(counts.groupBy(key).agg(F.sum(F.col("n") * F.get(weight, F.col("bucket").cast("int"))).alias("product"), F.sum(F.col("n") * F.col("n")).alias("squares")))
    found = scored.where("product > 0").select(key, F.round(F.col("product") / F.sqrt("squares"), 9).alias("score"))
    return found.orderBy(F.desc("score"), key).limit(limit).select(key, F.round("score", 6).alias("score"))


def hashed(text: str | None) -> np.ndarray:
    """Unit vector of DIMENSION floats; zeros for a text without words."""
    places = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % DIMENSION for w in WORD.findall((text or "").lower())]
    counts = np.bincount(np.array(places, dtype=np.int64), minlength=DIMENSION).astype(np.float64)
    return (counts / max(np.sqrt((counts * counts).sum()), 1e-12)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """An embedder: name and dimension that an index is made with, what is put before passages and before queries, and embed, many texts to vectors.

    Tasks call embed with at most batch texts; it is loaded once a Python worker where it is a closure over a loader.
    """

    name: str
    dimension: int
    embed: Callable[[list[str]], Sequence[np.ndarray]]
    passage: str = ""
    query: str = ""
    batch: int = 64

    def vectors(self, texts: list[str], prefix: str) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(texts), self.batch):
            some = [prefix + t for t in texts[at : at + self.batch]]
            got = list(self.embed(some))
            if len(got) != len(some) or any(len(v) != self.dimension for v in got):
                raise WrongAnswer(f"{self.name} gave {len(got)} vectors of {sorted({len(v) for v in got})} dimensions for {len(some)} texts of {self.dimension}")
            out += got
        return out


#: Variants: each has a name of its own, which an index remembers, since their vectors can't be compared. hashed-words stands in where no model is at hand.
MODELS: dict[str, Model] = {
    "hashed-words": Model("hashed-words", DIMENSION, lambda texts: [hashed(t) for t in texts]),
    "hashed-words-prefixed": Model("hashed-words-prefixed", DIMENSION, lambda texts: [hashed(t) for t in texts], "passage: ", "query: "),
}


def register(model: Model) -> None:
    """Make a model known by its name; a name stands for one model."""
    if MODELS.setdefault(model.name, model) is not model:
        raise InvalidArgument(f"{model.name} is known already")


def passages(model: Model):
    """Texts to vectors, as a function of a column, in Arrow batches."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series(model.vectors(some.fillna("").tolist(), model.passage), dtype=object)

    return embed


def query_vector(model: Model, text: str) -> list[float]:
    """The vector of a query; a blank query is an error."""
    if not text.strip():
        raise InvalidArgument("the query must not be empty")
    return [float(x) for x in model.vectors([text], model.query)[0]]
