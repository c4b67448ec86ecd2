"""Exact top-k by inner product with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it.  Rows in the order
of (pivot, distance) are cut into blocks, each a run of annuli of ANNULUS rows.  A query
first searches the block it lies in; its k-th best score there is what other blocks have
to reach.  An upper bound of the scores in an annulus between the distances r0 and r1
from pivot p, of vectors no longer than m, follows from the triangle inequality: no
vector is nearer to q than d(q,p) - r1 or r0 - d(q,p), and q.x = (|q|^2 + |x|^2 -
|q-x|^2) / 2; also q.x <= q.p + |q| r1.  A query travels only to the blocks whose bound
reaches its k-th best, and there expands annuli by falling bound until none can add to it.

Pivots are fitted to SAMPLE vectors (fewer where vectors are wide, so that the sample
holds at most SAMPLE_VALUES numbers); every vector is indexed, and bounds hold whatever
the pivots.  The block directory that tasks get has at most DIRECTORY blocks and one more
entry a pivot.  A block with many queries is repeated for parts of QUERY_PART of them.
Where pivots part the vectors badly, all blocks are searched: a stated query set against
all rows, in blocks.

Defined results: vectors that are null, hold null or non-finite components, or whose
whole-number square length passes 2^62 (scores would not fit a long) take no part, nor do
rows without vec_id; an empty vector is a zero vector; vectors of different length meet
over the components both have; of repeated rows of one id the smallest vector in array
order stands for all; ties go to the smaller vec_id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.operators.stage import staged

# Fixed values of the contract.
SCALE, EVERY, K = 64, 20, 20

SAMPLE, SAMPLE_VALUES = 20_000, 1 << 23
PIVOTS = 256
ANNULUS = 256
BLOCK, LARGE_BLOCK, DIRECTORY = 4096, 65_536, 16_384
QUERY_PART = 65_536
QUERY_BATCH = 512
LONGEST = float(1 << 62) * (1 - 1e-9)
ORIGIN = -1  # the pivot of vectors of another length than the pivots
NONE = -np.iinfo(np.int64).max  # below any score, and its negative is a long


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """id, x: whole numbers of the vectors that take part, one row an id."""
    v = F.col("v")
    fine = v.isNotNull() & F.col("id").isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where(fine)
    square = F.aggregate(v, F.lit(0.0), lambda s, c: s + F.pow(F.floor(c * SCALE).cast("double"), F.lit(2.0)))
    big = F.exists(v, lambda c: F.abs(c) >= float(1 << 31) / SCALE)
    rows = rows.where(~big & (square < LONGEST)).select("id", F.transform(v, lambda c: F.floor(c * SCALE).cast("long")).alias("x"))
    return rows.groupBy("id").agg(F.min("x").alias("x"))


def fit_pivots(sample: np.ndarray, k: int, rounds: int = 5, seed: int = 12) -> np.ndarray:
    """A few rounds of k-means over distinct sample vectors."""
    distinct = np.unique(sample, axis=0)
    pivots = np.random.default_rng(seed).permutation(distinct)[:k].astype(float)
    for _ in range(rounds):
        at, _ = nearest_pivot(sample, pivots)
        n = np.bincount(at, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, at, sample)
        pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
    return pivots


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096]
        at[a : a + 4096] = ((pivots**2).sum(1) - 2 * part @ pivots.T).argmin(1)
    return at, np.sqrt(((x - pivots[at]) ** 2).sum(1))


@dataclass
class Annuli:
    """Runs of rows of one pivot and length, with what bounds their scores."""

    pivots: np.ndarray
    pivot: list[int] = field(default_factory=list)
    near: list[float] = field(default_factory=list)
    far: list[float] = field(default_factory=list)
    square: list[float] = field(default_factory=list)
    ids: list[np.ndarray] = field(default_factory=list)
    x: list[np.ndarray] = field(default_factory=list)

    def add(self, rows: pa.Table) -> None:
        pivot, dist, ids = (rows.column(c).to_numpy() for c in ("pivot", "dist", "id"))
        lists = rows.column("x").combine_chunks()
        d = np.diff(lists.offsets.to_numpy())
        change = np.flatnonzero((pivot[1:] != pivot[:-1]) | (d[1:] != d[:-1])) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), len(ids)]):
            for i in range(a, b, ANNULUS):
                j = min(b, i + ANNULUS)
                x = lists[i:j].flatten().to_numpy().reshape(j - i, int(d[a]))
                self.pivot.append(int(pivot[a]))
                self.near.append(dist[i:j].min())
                self.far.append(dist[i:j].max())
                self.square.append((x.astype(float) ** 2).sum(1).max())
                self.ids.append(ids[i:j])
                self.x.append(x)

    def bounds(self, q: list[np.ndarray]) -> np.ndarray:
        return upper_bounds(q, self.pivots, np.array(self.pivot), np.array(self.near), np.array(self.far), np.array(self.square))


def fitted(q: list[np.ndarray], d: int) -> np.ndarray:
    """Vectors cut or padded with zeros to length ``d``."""
    if all(len(v) == d for v in q):
        return np.stack(q) if q else np.zeros((0, d), np.int64)
    out = np.zeros((len(q), d), np.int64)
    for i, v in enumerate(q):
        out[i, : min(d, len(v))] = v[:d]
    return out


def upper_bounds(q: list[np.ndarray], pivots: np.ndarray, pivot: np.ndarray, near: np.ndarray, far: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Queries x annuli: no score is above.  Bounds are widened by more than rounding."""
    whole = np.sqrt(np.array([(v.astype(float) ** 2).sum() for v in q]))
    m = fitted(q, pivots.shape[1]).astype(float)
    own = (m**2).sum(1)
    dot = np.concatenate([m @ pivots.T, np.zeros((len(q), 1))], axis=1)[:, pivot]  # the last is the origin
    to = np.sqrt(np.maximum(0.0, own[:, None] - 2 * dot + np.append((pivots**2).sum(1), 0.0)[pivot]))
    gap = np.maximum(0.0, np.maximum(to - far, near - to) - 1e-6 * (1 + to + far))
    by_ball = dot + np.sqrt(own)[:, None] * far
    by_triangle = (own[:, None] + square - gap**2) / 2
    by_length = whole[:, None] * np.sqrt(square)
    bound = np.where(pivot == ORIGIN, by_length, np.minimum(np.minimum(by_ball, by_triangle), by_length))
    return bound + 1e-9 * (own[:, None] + square + 1) + 1e-3


class Search:
    """The best k of some queries so far."""

    def __init__(self, ids: np.ndarray, q: list[np.ndarray], least: np.ndarray, least_id: np.ndarray, k: int):
        self.ids, self.q, self.least, self.least_id = ids, q, least, least_id  # what has to be beaten
        self.score = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def expand(self, annuli: Annuli) -> None:
        bound = annuli.bounds(self.q)
        for a in np.argsort(-bound.max(0)).tolist():
            active = np.flatnonzero(bound[:, a] >= np.maximum(self.least, self.score[:, -1]))
            if len(active):
                self._compare(active, annuli.ids[a], annuli.x[a], annuli.square[a])

    def _compare(self, active: np.ndarray, ids: np.ndarray, x: np.ndarray, square: float) -> None:
        q = fitted([self.q[i] for i in active], x.shape[1])
        # by Cauchy and Schwarz no partial sum is larger, so doubles are exact below 2^53
        exact = square * (q.astype(float) ** 2).sum(1).max(initial=0.0) < float(1 << 53) ** 2 / 4
        score = (q.astype(float) @ x.T.astype(float)).astype(np.int64) if exact else q @ x.T
        score[self.ids[active][:, None] == ids[None, :]] = NONE
        hit = score >= np.maximum(self.score[active, -1], NONE + 1)[:, None]
        least, least_id = self.least[active, None], self.least_id[active, None]
        hit &= (score > least) | ((score == least) & (ids[None, :] < least_id))
        some = np.flatnonzero(hit.any(1))
        if not len(some):
            return
        at, k = active[some], self.score.shape[1]
        score = np.concatenate([self.score[at], np.where(hit[some], score[some], NONE)], axis=1)
        found = np.concatenate([self.found[at], np.broadcast_to(ids, (len(some), len(ids)))], axis=1)
        found = np.where(score == NONE, np.iinfo(np.int64).max, found)
        best = np.lexsort((found, -score), axis=-1)[:, :k]
        self.score[at], self.found[at] = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)


def _lists(column) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def keyed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, x, pivot, dist"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _lists(batch.column(1))
            fits = np.array([len(v) == pivots.shape[1] for v in x])
            at = np.full(len(x), ORIGIN)
            dist = np.array([0.0 if ok else np.sqrt((v.astype(float) ** 2).sum()) for ok, v in zip(fits, x)])
            if fits.any():
                at[fits], dist[fits] = nearest_pivot(np.stack([v for ok, v in zip(fits, x) if ok]).astype(float), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at), pa.array(dist)], names=["id", "x", "pivot", "dist"])

    return rows.mapInArrow(run, "id long, x array<long>, pivot long, dist double")


INDEXED = "block long, pivot long, dist double, square double, id long, x array<long>, best_score array<long>, best_id array<long>"


def indexed(rows: DataFrame, pivots: np.ndarray, n_blocks: int, every: int, k: int) -> DataFrame:
    """All rows by block; queries with the best of their own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([], pa.schema([("id", pa.int64())]))])
        if not rows.num_rows:
            return
        rows = rows.combine_chunks()
        annuli = Annuli(pivots)
        annuli.add(rows)
        x, ids = _lists(rows.column("x")), rows.column("id").to_numpy()
        asked = np.flatnonzero(ids % every == 0)
        best: list = [None] * len(ids)
        for a in range(0, len(asked), QUERY_BATCH):
            part = asked[a : a + QUERY_BATCH]
            search = Search(ids[part], [x[i] for i in part], np.full(len(part), NONE), np.zeros(len(part), np.int64), k)
            search.expand(annuli)
            for i, score, found in zip(part.tolist(), search.score, search.found):
                real = score != NONE
                best[i] = score[real], found[real]
        square = np.array([(v.astype(float) ** 2).sum() for v in x])
        block = np.full(len(ids), TaskContext.get().partitionId())
        out = pa.table(
            {
                "block": block, "pivot": rows.column("pivot"), "dist": rows.column("dist"), "square": square, "id": rows.column("id"), "x": rows.column("x"),
                **{name: pa.array([None if b is None else b[j] for b in best], pa.list_(pa.int64())) for j, name in enumerate(("best_score", "best_id"))},
            }
        )
        yield from out.to_batches(max_chunksize=4096)

    order = ("pivot", "dist", "id")
    return rows.repartitionByRange(n_blocks, *order).sortWithinPartitions(*order).mapInArrow(run, INDEXED)


def routed(queries: DataFrame, directory: pa.Table, pivots: np.ndarray, k: int) -> DataFrame:
    """block, id, x, least, least_id: the other blocks that can still hold one of a query's
    best, and the worst of those it has."""
    blocks, pivot, near, far, square = (directory.column(c).to_numpy() for c in ("block", "pivot", "near", "far", "square"))
    names, at = np.unique(blocks, return_inverse=True)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, QUERY_BATCH):
                batch = whole.slice(a, QUERY_BATCH)
                bound = upper_bounds(_lists(batch.column(2)), pivots, pivot, near, far, square)[:, order]
                bound = np.maximum.reduceat(bound, starts, axis=1)
                own = batch.column(0).to_numpy()
                least = np.array([s[-1] if len(s) >= k else NONE for s in _lists(batch.column(3))])
                least_id = np.array([b[-1] if len(b) >= k else 0 for b in _lists(batch.column(4))])
                i, j = np.nonzero((bound >= least[:, None]) & (names[None, :] != own[:, None]))
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(names[j]), batch.column(1).take(take), batch.column(2).take(take), pa.array(least[i]), pa.array(least_id[i])], names=["block", "id", "x", "least", "least_id"])

    return queries.select("block", "id", "x", "best_score", "best_id").mapInArrow(run, "block long, id long, x array<long>, least long, least_id long")


def searched(rows: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """query, score, id: what the queries find in the blocks they were sent to."""
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    sizes = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_PART).cast("long").alias("parts"))
    columns = ["block", "part", "asks", "pivot", "dist", "id", "x", "least", "least_id"]
    data = rows.join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    data = data.withColumns({"asks": F.lit(False), "least": F.lit(NONE), "least_id": F.lit(0).cast("long")}).select(*columns)
    asking = queries.join(sizes, "block").withColumns({"part": part, "asks": F.lit(True), "pivot": F.lit(0).cast("long"), "dist": F.lit(0.0)}).select(*columns)

    def answer(annuli: Annuli, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for a in range(0, rows.num_rows, QUERY_BATCH):
            some = rows.slice(a, QUERY_BATCH)
            ids = some.column("id").to_numpy()
            search = Search(ids, _lists(some.column("x")), some.column("least").to_numpy(), some.column("least_id").to_numpy(), k)
            search.expand(annuli)
            real = search.score != NONE
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(1))), pa.array(search.score[real]), pa.array(search.found[real])], names=["query", "score", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, annuli, waiting = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            cut = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()
            for a, b in zip([0, *cut], [*cut, batch.num_rows]):
                block, asks, rows = tuple(key[:2, a].tolist()), bool(key[2, a]), batch.slice(a, b - a)
                if block != at:
                    at, annuli, waiting = block, None, []
                if not asks:
                    waiting.append(rows)
                    continue
                if annuli is None:
                    annuli = Annuli(pivots)
                    if waiting:
                        annuli.add(pa.Table.from_batches(waiting).combine_chunks())
                    waiting = []
                yield from answer(annuli, pa.Table.from_batches([rows]))

    both = data.unionByName(asking).repartition("block", "part").sortWithinPartitions("block", "part", "asks", "pivot", "dist", "id")
    return both.mapInArrow(run, "query long, score long, id long")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of every row whose id is
    divisible by ``every``."""
    rows = staged(whole_vectors(vectors))
    n = rows.count()
    spark = rows.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first().d
    sample = rows.where(F.size("x") == width).orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE, SAMPLE_VALUES // max(1, width)))).select("x").toArrow()
    centres = fit_pivots(fitted(_lists(sample.column("x")), width).astype(float), pivots)
    size = max(block, min(LARGE_BLOCK, n // 256), -(-n // DIRECTORY))
    placed = staged(indexed(keyed(rows, centres), centres, -(-n // size), every, k))
    directory = placed.groupBy("block", "pivot").agg(F.min("dist").alias("near"), F.max("dist").alias("far"), F.max("square").alias("square")).toArrow()
    queries = placed.where(F.col("best_id").isNotNull())
    others = staged(routed(queries, directory, centres, k))
    own = queries.select(F.col("id").alias("query"), F.explode(F.arrays_zip(F.col("best_score").alias("score"), F.col("best_id").alias("id"))).alias("_b")).select("query", "_b.score", "_b.id")
    found = own.unionByName(searched(placed, others, centres, k))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


ORACLE = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}"""
