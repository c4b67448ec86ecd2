"""Near-duplicate embeddings: iterative quantisation and multi-index Hamming tables.

Signs of projections of the centred vector are its code, in words of 64 bits.  The first
word's rotation of the principal components is learned so that the signs are balanced
and lose little (iterative quantisation); the others are random rotations of the whole
space, independent of the data.  Tables index drawn bits of a word; near vectors agree
on some table.  Within a bucket, words too far apart are put aside; a pair is looked at
in the first table that it shares.  Only vectors with such a partner bring their
original values, and pairs are kept by cosine in double precision.

Buckets of any size are compared in pairs of blocks, so none is one task's burden, and
what leaves a task is counts and a spanning forest, not pairs.

The rotation and the mean are fitted to SAMPLE vectors (the first by a hash of the id);
every vector is indexed.  A table's key has log2(rows / BUCKET) bits, so buckets stay
small.  A random hyperplane parts two vectors with a probability that follows from their
cosine and their distance from the mean alone; from it and the key's bits follows the
number of words and tables that find RECALL of the pairs at the threshold, whatever the
number of rows.  Where over TABLES would be needed, keys get shorter instead.  The
learned word's tables come on top.

Defined results: vectors that are null, zero, hold null or non-finite components, or
whose length isn't the most common one, link with nothing; equal vectors link; repeated
rows of one id are one vector; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.graph import Forest, components, grouped, in_blocks
from runloom.operators.stage import staged

SAMPLE = 20_000
BITS = 64
BLOCK = 1024
COSINE = 0.9
RECALL = 0.95
BUCKET = 256
TABLES = 128
LEAST = 8
FAR_SD = 3  # standard deviations of the bit error that a near pair may have


@dataclass
class Quantiser:
    mean: np.ndarray
    rotation: np.ndarray  # components x bits

    def codes(self, v: np.ndarray) -> np.ndarray:
        bits = (v - self.mean) @ self.rotation > 0
        return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]


@dataclass
class Table:
    word: int
    mask: int
    far: int  # most differing bits of the word


@dataclass
class Index:
    """The words of the code and the tables over them, those of a word side by side."""

    words: list[Quantiser]
    tables: list[Table]

    def codes(self, v: np.ndarray) -> np.ndarray:
        return np.stack([q.codes(v) for q in self.words], axis=1)


def fit(v: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 3) -> Quantiser:
    """Learn the rotation: signs for a rotation, then the best rotation for the signs."""
    mean = v.mean(0)
    values, axes = np.linalg.eigh(np.cov((v - mean).T).reshape(v.shape[1], v.shape[1]))
    axes = axes[:, np.argsort(values)[::-1][:bits]]
    p = (v - mean) @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(p.shape[1], p.shape[1])))[0]
    for _ in range(rounds):
        signs = np.where(p @ r > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(p.T @ signs)
        r = left @ right
    return Quantiser(mean, axes @ r)


def random_word(mean: np.ndarray, seed: int, bits: int = BITS) -> Quantiser:
    """Signs of random rotations, as many as the bits need."""
    rng, parts = np.random.default_rng([seed, 17]), []
    while sum(x.shape[1] for x in parts) < bits:
        parts.append(np.linalg.qr(rng.normal(size=(len(mean), len(mean))))[0])
    return Quantiser(mean, np.concatenate(parts, axis=1)[:, :bits])


def bit_error(v: np.ndarray, mean: np.ndarray, cosine: float) -> float:
    """Probability that a random hyperplane through the mean parts two unit vectors at
    the threshold.  Centring keeps their distance and shortens them; nine in ten of the
    vectors are no shorter than the length that is taken."""
    short = max(1e-12, float(np.quantile(((v - mean) ** 2).sum(1), 0.1)))
    return math.acos(max(-1.0, 1 - (1 - cosine) / short)) / math.pi


def missed(error: float, width: int, tables: int, bits: int = BITS) -> float:
    """Share of the pairs at ``error`` that no table of one word finds; keys are drawn
    bits, so tables are independent given the number of differing bits."""
    out = 0.0
    for e in range(bits + 1):
        share = math.comb(bits, e) * error**e * (1 - error) ** (bits - e)
        out += share * (1 - math.comb(bits - e, width) / math.comb(bits, width)) ** tables
    return out


def far_bits(error: float, bits: int) -> int:
    return min(bits, math.ceil(bits * error + FAR_SD * math.sqrt(bits * error * (1 - error))))


def plan(rows: int, error: float, recall: float = RECALL, most: int = TABLES) -> tuple[int, int, int]:
    """Key bits, random words and tables a word that find ``recall`` of the pairs."""
    width = min(BITS, max(LEAST, math.ceil(math.log2(max(2, rows) / BUCKET))))
    for w in range(width, -1, -1):  # keys of no bits compare all
        fits = []
        for tables in range(1, most + 1):
            rest = missed(error, w, tables)
            words = 1 if rest <= 1 - recall else math.ceil(math.log(1 - recall) / math.log(rest)) if rest < 1 else most + 1
            if words * tables <= most:
                fits.append((words * (tables + 2), words, tables))  # a word costs its bits, too
        if fits:
            return (w, *min(fits)[1:])
    raise AssertionError("keys of no bits miss nothing")


def build(v: np.ndarray, rows: int, cosine: float) -> Index:
    """The index for so many rows, fitted to the sample ``v``."""
    learned = fit(v)
    error = bit_error(v, learned.mean, cosine)
    width, words, each = plan(rows, error)
    quantisers = [learned, *(random_word(learned.mean, k) for k in range(words))]
    rng, tables = np.random.default_rng(29), []
    for k, q in enumerate(quantisers):
        for _ in range(each):
            bits = rng.choice(q.bits, min(q.bits, width), replace=False)
            tables.append(Table(k, sum(1 << int(x) for x in bits), far_bits(error, q.bits)))
    return Index(quantisers, tables)


def usable(vectors: DataFrame) -> DataFrame:
    """id, v: the vectors that can link, of unit length in double precision."""
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    doubles = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where(ok)
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = doubles.withColumn("_top", top).where("_top > 0").select("id", F.expr("transform(v, x -> x / _top)").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return scaled.withColumn("_norm", norm).select("id", F.expr("transform(v, x -> x / _norm)").alias("v")).dropDuplicates(["id"])


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def encode(rows: DataFrame, index: Index) -> DataFrame:
    """id, v, words"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = index.codes(_matrix(batch.column(1))).view(np.int64)
                ends = np.arange(len(words) + 1, dtype=np.int32) * words.shape[1]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(ends), pa.array(words.ravel()))], names=["id", "v", "words"])

    return rows.mapInArrow(run, "id long, v array<double>, words array<long>")


def keyed(coded: DataFrame, tables: list[Table]) -> DataFrame:
    """id, code, t, value: every vector's key in every table, with the table's word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _matrix(batch.column(1)).view(np.uint64)
            for t, table in enumerate(tables):
                code = np.ascontiguousarray(words[:, table.word])
                value = (code & np.uint64(table.mask)).view(np.int64)
                at = np.full(len(code), t, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.view(np.int64)), pa.array(at), pa.array(value)], names=["id", "code", "t", "value"])

    return coded.select("id", "words").mapInArrow(run, "id long, code long, t int, value long")


def _pairs(code: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, tables: list[Table], t: int) -> np.ndarray:
    """Which left-right pairs are near in the word of table ``t`` and share no earlier
    table of this word."""
    x = code[left][:, None] ^ code[right][None, :]
    near = np.bitwise_count(x) <= tables[t].far
    if same:
        near &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    for earlier in tables[:t]:
        if earlier.word == tables[t].word:
            near &= (x & np.uint64(earlier.mask)) != 0
    return near


def _first(words: np.ndarray, left: np.ndarray, right: np.ndarray, tables: list[Table], t: int) -> np.ndarray:
    """Which of the pairs left[i], right[i] no table of an earlier word finds."""
    first = np.ones(len(left), bool)
    for k in range(tables[t].word):
        x = words[left, k] ^ words[right, k]
        shared = np.zeros(len(left), bool)
        for table in tables:
            if table.word == k:
                shared |= ((x & np.uint64(table.mask)) == 0) & (np.bitwise_count(x) <= table.far)
        first &= ~shared
    return first


def links(coded: DataFrame, tables: list[Table], cosine: float, block: int = BLOCK) -> DataFrame:
    """id, n, other: the number of links of id found in one place (n, other null), or an
    edge of that place's spanning forest (n 0).  ``coded`` has id, v and words."""
    keys = keyed(coded, tables)
    sizes = keys.groupBy("t", "value").agg(F.count("*").alias("size")).where("size > 1")
    keys = keys.join(sizes, ["t", "value"]).withColumn("bucket", F.xxhash64("t", "value"))
    placed = in_blocks(keys, "bucket", "size", block).select("t", "value", "lo", "hi", "mine", "id", "code")
    place = ["t", "value", "lo", "hi"]

    def sides(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, bool]:
        mine, lo, hi = table.column("mine").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        return table.column("t")[0].as_py(), np.flatnonzero(mine == lo), np.flatnonzero(mine == hi), lo == hi

    def sift(table: pa.Table) -> Iterator[pa.RecordBatch]:
        t, left, right, same = sides(table)
        code = table.column("code").to_numpy().view(np.uint64)
        keep = np.zeros(len(code), bool)
        if len(left) and len(right):
            near = _pairs(code, left, right, same, tables, t)
            keep[left[near.any(1)]] = True
            keep[right[near.any(0)]] = True
        yield from table.filter(pa.array(keep)).to_batches()

    kept = grouped(placed, place, sift, "t int, value long, lo long, hi long, mine long, id long, code long")
    full = kept.join(coded, "id").select(*place, "mine", "id", "code", "v", "words")

    def rank(table: pa.Table) -> Iterator[pa.RecordBatch]:
        t, left, right, same = sides(table)
        if not len(left) or not len(right):
            return
        code, ids, v = table.column("code").to_numpy().view(np.uint64), table.column("id").to_numpy(), _matrix(table.column("v"))
        words = _matrix(table.column("words")).view(np.uint64)
        hit = _pairs(code, left, right, same, tables, t) & (v[left] @ v[right].T >= cosine)
        i, j = np.nonzero(hit)
        hit[i, j] = _first(words, left[i], right[j], tables, t)
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, left, hit.sum(1))
        np.add.at(n, right, hit.sum(0))
        forest, a, b = Forest(len(ids)), [], []
        for i, j in zip(*np.nonzero(hit)):
            if forest.join(int(left[i]), int(right[j])):
                a.append(ids[left[i]])
                b.append(ids[right[j]])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[some], np.array(a, np.int64)])),
                pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)])),
                pa.array([*[None] * len(some), *[int(x) for x in b]], pa.int64()),
            ],
            names=["id", "n", "other"],
        )

    return grouped(full, place, rank, "id long, n long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, block: int = BLOCK, planned_rows: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.  ``planned_rows`` stands for
    the number of rows when the tables are laid out."""
    rows = staged(usable(vectors))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    everyone = vectors.select("vec_id")
    alone = everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if common is None:
        return alone
    rows = rows.where(F.size("v") == common.d)
    first = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()])
    index = build(first, planned_rows or common["count"], cosine)
    found = staged(links(staged(encode(rows, index)), index.tables, cosine, block=block))
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n_links"))
    labels = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    return (
        everyone.join(counts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .join(labels.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
