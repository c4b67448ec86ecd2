"""Connected components and grouped kernels, shared by the similarity joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.stage import staged

FILTER_WORDS = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """id, label of every end of ``edges`` (columns a, b): the label is the smallest id
    reachable.

    Contraction: every node takes the smallest label among itself and its neighbours,
    chains of such steps are shortened, and the edges are rewritten between labels.
    Edges inside a label go, so the graph shrinks by at least half of its touched nodes
    each round.  All steps are joins and aggregates; a hub is split by the adaptive join."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    labels = staged(nodes.withColumn("label", F.col("id")))
    while not edges.isEmpty():
        step = staged(
            edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .groupBy("a")
            .agg(F.min("b").alias("to"))
            .select(F.col("a").alias("at"), F.least("a", "to").alias("to"))
        )
        for _ in range(2):
            onward = step.select(F.col("at").alias("to"), F.col("to").alias("further"))
            step = step.join(onward, "to").select("at", F.col("further").alias("to"))
        step = staged(step)
        labels = staged(
            labels.join(step.withColumnRenamed("at", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        )
        to = lambda c: step.select(F.col("at").alias(c), F.col("to").alias(f"_{c}"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("_a <> _b")
        edges = staged(moved.select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct())
    return labels


class Forest:
    """Union-find over the rows of one task's group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def grouped(df: DataFrame, keys: Sequence[str], kernel: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``kernel`` on the rows of each combination of ``keys``.

    Rows are shuffled by the keys and sorted; a task walks over its groups, so small
    groups cost no call into the engine each.  Groups must fit a task; callers bound
    their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                v = batch.column(k).to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
                if rest:
                    change[0] |= rest[-1].column(k)[-1].as_py() != v[0].item()
            starts = np.flatnonzero(change).tolist()
            at = 0
            for s in starts:
                if s > at:
                    rest.append(batch.slice(at, s - at))
                if rest:
                    yield from kernel(pa.Table.from_batches(rest))
                rest, at = [], s
            rest.append(batch.slice(at))
        if rest:
            yield from kernel(pa.Table.from_batches(rest))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def in_blocks(rows: DataFrame, key: str, size: str, block: int, spread: str = "id") -> DataFrame:
    """Rows of a group of ``size`` rows go to pairs of blocks: adds lo, hi and mine (which
    of the two the row is in).  Every two rows of a group meet in exactly one pair."""
    n = F.greatest(F.ceil(F.col(size) / block), F.lit(1)).cast("long")
    rows = rows.withColumn("_n", n).withColumn("mine", F.pmod(F.xxhash64(spread, F.lit(5)), F.col("_n")))
    return (
        rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .withColumn("lo", F.least("mine", "_other"))
        .withColumn("hi", F.greatest("mine", "_other"))
        .drop("_n", "_other")
    )


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those that ``wanted`` doesn't list, so that few texts
    are shuffled for the exact join that follows.  The list is hashed to a bitmap of
    FILTER_WORDS x 64 bits, the most that is ever broadcast; a longer list only lets
    more rows through."""
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))
    word, bit = (slot / 64).cast("long"), (slot % 64).cast("int")
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    rows = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word")
    return rows.where(F.expr("(shiftrightunsigned(_bits, _bit) & 1L) = 1L")).drop("_word", "_bit", "_bits")
