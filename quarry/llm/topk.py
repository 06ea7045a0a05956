"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors become integers. For a cut of the dimensions into segments, means and deviations
of the segments give a lower bound of the Euclidean distance, and so, with both norms, an
upper bound of the inner product. Bounds go from a coarse cut to a fine one; exact products
are taken only of pairs that no bound could exclude. Queries are a stated set; they are dealt
to blocks of bounded size, candidates to shares, and each block meets each share in one task:
the block comes first, then the share streams past it, and only the best of each query leave.
Nothing goes through the driver, and no broadcast grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that a task holds about, and of candidates that stream past them.
BLOCK_BYTES, SHARE_BYTES = 16 << 20, 256 << 20
#: Query vectors, and candidates, that meet at once: bounds what a task holds, whatever survives.
BLOCK, CANDIDATES = 256, 1024
#: Segments at each resolution, coarse to fine.
LEVELS = (4, 8, 16)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): v holds floor(scale * x) as longs; vectors that are null or empty, or hold null or non-finite components, are left out, as are null ids."""
    x = F.col(vector_col)
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"))


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, flat values) of a list array without nulls."""
    return np.asarray(pa.compute.list_value_length(column)), np.asarray(column.flatten())


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of about equal segments, each times the root of its length: differences of these bound distances from below."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = x[:, a:b]
        out += [part.mean(axis=1) * (b - a) ** 0.5, part.std(axis=1) * (b - a) ** 0.5]
    return np.stack(out, axis=1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class _Best:
    """Best k (ids, scores) of each query of a block over all candidates that it has met; a query never meets its own id."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.scores, self.ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        norm = (q * q).sum(axis=1)
        self.stats = [_statistics(q, s) for s in LEVELS]
        self.rest = [(norm - (a * a).sum(axis=1)) / 2 for a in self.stats]

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        q_ids, q, k, rows = self.q_ids, self.q, self.k, len(self.q)
        if len(ids) < 4 * k:
            open_q, open_x = np.repeat(np.arange(rows), len(ids)), np.tile(np.arange(len(ids)), rows)
        else:
            x_norm = (x * x).sum(axis=1)
            bound = self.scores[:, -1]
            a = _statistics(x, LEVELS[0])
            upper = self.stats[0] @ a.T + self.rest[0][:, None] + ((x_norm - (a * a).sum(axis=1)) / 2)[None, :]
            if not np.isfinite(bound).all():  # a first threshold: exact scores of the most promising
                top = np.argpartition(-upper, 2 * k, axis=1)[:, : 2 * k]
                first = np.einsum("qd,qkd->qk", q, x[top])
                first[ids[top] == q_ids[:, None]] = -np.inf
                bound = np.maximum(bound, -np.sort(-first, axis=1)[:, k - 1])
            open_q, open_x = np.nonzero(upper >= bound[:, None] - 0.5)
            for level, (stats, rest) in enumerate(zip(self.stats[1:], self.rest[1:], strict=True), 1):
                a = _statistics(x, LEVELS[level])
                x_rest = (x_norm - (a * a).sum(axis=1)) / 2
                keep = np.einsum("nd,nd->n", stats[open_q], a[open_x]) + rest[open_q] + x_rest[open_x] >= bound[open_q] - 0.5
                open_q, open_x = open_q[keep], open_x[keep]
        fair = ids[open_x] != q_ids[open_q]
        open_q, open_x = open_q[fair], open_x[fair]
        exact = np.empty(len(open_q))
        for at in range(0, len(open_q), 1 << 16):
            part = slice(at, at + (1 << 16))
            exact[part] = np.einsum("nd,nd->n", q[open_q[part]], x[open_x[part]])
        starts = np.searchsorted(open_q, np.arange(rows + 1))
        for r in np.flatnonzero(np.diff(starts)):
            own = slice(starts[r], starts[r + 1])
            all_i, all_s = np.append(self.ids[r], ids[open_x[own]]), np.append(self.scores[r], exact[own])
            best = _best(all_i, all_s, k)
            self.ids[r], self.scores[r] = all_i[best], all_s[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, place = np.nonzero(np.isfinite(self.scores))
        return self.q_ids[row], self.ids[row, place], self.scores[row, place].astype(np.int64)


class _Blocks:
    """The query vectors of a task by their length, in blocks of at most BLOCK."""

    def __init__(self, k: int):
        self.k, self.waiting, self.ready = k, {}, None

    def ask(self, ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        for width in np.unique(lengths).tolist():
            same = lengths == width
            self.waiting.setdefault(width, []).append((ids[same], flat[np.repeat(same, lengths)].reshape(-1, width)))

    def meet(self, ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        if self.ready is None:
            self.ready = {}
            for width, parts in self.waiting.items():
                i, q = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.float64)
                self.ready[width] = [_Best(i[a : a + BLOCK], q[a : a + BLOCK], self.k) for a in range(0, len(i), BLOCK)]
        for width in np.unique(lengths).tolist():
            same = lengths == width
            x = flat[np.repeat(same, lengths)].reshape(-1, width).astype(np.float64)
            for best in self.ready.get(width, ()):
                best.meet(ids[same], x)

    def batches(self) -> Iterator[pa.RecordBatch]:
        for best in (b for own in (self.ready or {}).values() for b in own):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.found()], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block_bytes: int = BLOCK_BYTES, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """The k highest integer inner products of each query vector over all vectors but its own id.

    queries has the same columns as vectors. Returns query_id, rank (from 1), vec_id, score;
    fewer than k rows where there are fewer candidates, ties to the smaller id. Vectors that
    are null or empty, or hold null or non-finite components, take no part; vectors of another
    length than the query's are no candidates of it, rows with a null id are left out; an empty
    table gives no rows. Repeated rows of one id count each; a query that is repeated is asked
    once. Sums must stay below 2**53, where doubles are exact integers.
    """
    ready = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale).distinct()
    size = lambda df: int(df.select(F.coalesce(F.sum(F.size("v") * 8 + 8), F.lit(0))).first()[0])
    blocks = max(1, -(-size(asked) // block_bytes))
    shares = max(1, -(-size(ready) // share_bytes), -(-vectors.sparkSession.sparkContext.defaultParallelism // blocks))

    def dealt(df: DataFrame, own: int, other: int, number, candidate: bool) -> DataFrame:
        """Rows of a block or share (by ids, and the partition that a row lies in, so that no id is too frequent) for each of the other side."""
        mine = F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(own))
        all_other = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return df.select("id", "v", mine.cast("int").alias("mine"), all_other.alias("other")).select(number(F.col("mine"), F.col("other")).alias("task"), F.lit(candidate).alias("candidate"), "id", "v")

    q = dealt(asked, blocks, shares, lambda mine, other: mine * shares + other, False)
    c = dealt(ready, shares, blocks, lambda mine, other: other * shares + mine, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                some = batch.slice(at, CANDIDATES)
                task, candidate = np.asarray(some.column(0)), some.column(1).to_numpy(zero_copy_only=False)
                edges = np.flatnonzero((task[1:] != task[:-1]) | (candidate[1:] != candidate[:-1])) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(task)], strict=True):
                    if task[a] != now:
                        if own is not None:
                            yield from own.batches()
                        now, own = task[a], _Blocks(k)
                    part = some.slice(a, b - a)
                    (own.meet if candidate[a] else own.ask)(np.asarray(part.column(2)), *_matrix(part.column(3)))
        if own is not None:
            yield from own.batches()

    met = q.unionByName(c).repartitionById(blocks * shares, F.col("task")).sortWithinPartitions("task", "candidate")
    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
