"""MinHash near duplicates from two permutations, one of them shifted circularly for each coordinate.

Shingles are hashed to 32 bits. A first permutation scatters them once; coordinate k of a
signature is the smallest value that the second permutation gives them after they are shifted by
k, round the circle of 2^32 (Li and Li, C-MinHash). Coordinates are cut into bands; documents with
an equal band are candidates, and the sets of candidates are compared whole. With BANDS bands of
ROWS coordinates each, a pair of similarity 0.8 is missed three times in a million, a more similar
one less often.

Equal sets are one class from the start. A band is passed on once a batch, with the first class of
it there; the other classes of the batch that have it are connected with that one at once, so a
band that very many share is few rows in the shuffle, and no pairs of its holders are ever listed.
What bands connect is a family; links are verified within families, and families of any size are
settled as those of the n-gram Jaccard join are (quarry.llm.jaccard), with bands in place of
prefix tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import mix64, slices, staged
from quarry.llm.jaccard import _SEEDS, _STEP, _parity, connected_classes, of_documents, shingle_sets, told_apart

#: Words of a shingle; similarity in hundredths; bands of a signature and coordinates of a band.
WORDS, HUNDREDTHS, BANDS, ROWS = 4, 80, 32, 5
_FIRST = (np.uint32(0x9E3779B1), np.uint32(0x7FEB352D))
_SECOND = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def _permuted(x: np.ndarray, factors: tuple[np.uint32, np.uint32], out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers: odd factors and shifts that can be undone."""
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=out)
    np.multiply(out, factors[0], out=out)
    np.right_shift(out, np.uint32(13), out=spare)
    np.bitwise_xor(out, spare, out=out)
    return np.multiply(out, factors[1], out=out)


def signatures_of(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """A row of coordinates for each set (none of them empty)."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    tokens = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    spare, out = np.empty_like(tokens), np.empty_like(tokens)
    shifted = _permuted(tokens, _FIRST, np.empty_like(tokens), spare)
    found = np.empty((coordinates, len(sets)), dtype=np.uint32)
    for k in range(coordinates):
        np.minimum.reduceat(_permuted(shifted, _SECOND, out, spare), starts, out=found[k])
        shifted += np.uint32(1)  # round the circle
    return found.T


def bands_of(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A row of band keys (64 bits, each band has its own) for each set (none of them empty)."""
    found = signatures_of(sets, bands * rows).astype(np.uint64).reshape(len(sets), bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.zeros((len(sets), 1), dtype=np.uint64)
    for k in range(rows):
        keys = mix64(keys * _STEP + found[:, :, k])
    return keys


class Bands:
    """What makes sets candidates: a band that both have."""

    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows = bands, rows

    def keys(self, sets: list[np.ndarray]) -> list[list[int]]:
        return bands_of(sets, self.bands, self.rows).tolist() if sets else []

    def others(self, tokens: np.ndarray) -> list[frozenset[int]]:
        return []


def signatures(texts: DataFrame, words: int, hundredths: int, met: Bands) -> DataFrame:
    """(id, n_shingles, f1, f2, bands, parity) of each text: size and fingerprint of its set, band keys, parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column(1), words)
            some = [s for s in sets if len(s)]
            bands = iter(bands_of(some, met.bands, met.rows) if some else ())
            rows = []
            for s in sets:
                f1, f2 = (int(np.bitwise_xor.reduce(mix64(s * _STEP + seed)).astype(np.int64)) for seed in _SEEDS[:2]) if len(s) else (0, 0)
                rows.append((len(s), f1, f2, next(bands).tobytes() if len(s) else b"", _parity(s, hundredths) if len(s) else b""))
            n, f1, f2, keys, parity = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in (n, f1, f2)], pa.array(keys, pa.binary()), pa.array(parity, pa.binary())], names=["id", "n_shingles", "f1", "f2", "bands", "parity"])

    return texts.mapInArrow(run, "id long, n_shingles long, f1 long, f2 long, bands binary, parity binary")


def _unpacked(bands: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(bands.to_pylist()), dtype=np.int64).reshape(len(bands), -1)


def _met(groups: DataFrame) -> DataFrame:
    """(key, a, b) from classes (rep, bands): a band's key with its first holder of a batch; key is null where a and b share a band within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _unpacked(batch.column(1))
            reps = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            found, first, at = np.unique(keys.ravel(), return_index=True, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(reps[first]), pa.nulls(len(found), pa.int64())], names=["key", "a", "b"])
            a, b = reps[first][at.ravel()], reps
            both = np.unique(np.stack([a[a != b], b[a != b]], axis=1), axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["key", "a", "b"])

    return groups.select("rep", "bands").mapInArrow(run, "key long, a long, b long")


def _listed(groups: DataFrame) -> DataFrame:
    """(token, id, pos, n, parity): every band of classes, in the form in which classes of large families meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                keys = _unpacked(part.column(1))
                place = np.repeat(np.arange(len(keys)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(pa.array(place)), pa.array(np.zeros(len(place), dtype=np.int64)), part.column(2).take(pa.array(place)), part.column(3).take(pa.array(place))], names=["token", "id", "pos", "n", "parity"])

    return groups.select(F.col("rep").alias("id"), "bands", F.col("n_shingles").alias("n"), "parity").mapInArrow(run, "token long, id long, pos long, n long, parity binary")


def near_duplicates(docs: DataFrame, words: int = WORDS, hundredths: int = HUNDREDTHS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row: components of the links of similarity hundredths / 100 or more among candidates.

    kept says that the row's id is the smallest of its component. Ids are integers below
    jaccard.STAND_IN and name documents: rows that repeat an id are one document, which has the links
    of each of its texts; each row has the size of its own. Rows with a null id are sized but link
    with nothing, have a null component and are kept. A null, empty or wordless text has no shingles,
    links with nothing and is kept, unless another row of its id is not; an empty table gives an empty
    result; other columns are ignored whatever their names. Whole texts are read.
    """
    met = Bands(bands, rows)
    texts, names = told_apart(docs, id_col, text_col)
    signed = staged(signatures(texts, words, hundredths, met), "signatures")
    own = signed.where("n_shingles > 0 AND id IS NOT NULL")
    groups = staged(own.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("parity").alias("parity")), "classes")
    found = staged(_met(groups), "met")
    least = found.where("key IS NOT NULL").select("a", F.min("a").over(Window.partitionBy("key")).alias("least"))
    across = least.where("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    pairs = staged(found.where("key IS NULL").select("a", "b").unionByName(across).distinct(), "pairs")
    labels = connected_classes(texts, groups, pairs, lambda ids: _listed(groups.join(ids.withColumnRenamed("id", "rep"), "rep", "left_semi")), met, words, hundredths)
    out = of_documents(signed, groups, labels, names, id_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
