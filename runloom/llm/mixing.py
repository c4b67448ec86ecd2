"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is a line of words: its documents in shuffled order, laid end to end,
twice (a word may be used twice at most).  The line is cut into blocks of equal
numbers of words.  Van der Corput points, mapped through the cumulative target
weights, give each slot of the mix its source; slots are ranked per source, and the
slot of rank r takes block r of its source.  Sources come up evenly in every stretch
of the schedule, without a generator's state, so any slot can be computed on its own.

Nothing is held per source in one task: positions on the line and ranks of slots are
sums over cells (by hash of the document, by stretch of slots) plus the offset of the
cells before.

Defined results: a null text has size 0 and is taken 0 times; a null source is a
source of its own, last in order; rows without doc_id take part like others (among
those of one size and source, which of them is taken how often is open, since nothing
tells them apart); repeated rows are separate documents; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.operators.stage import staged

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_USES = 2
BLOCK_WORDS = 4096
DOC_CELLS_LOG2 = 12
SLOTS_PER_CELL = 8192
POINT_CELLS = 4096
SEED = 17


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_uses: int = MAX_USES
) -> DataFrame:
    """Per source: src (rank by code point, null last), source, source_size, target.

    ``share`` x all words are dealt by weight (``weights`` repeat along the ranks).  A
    target stops at ``max_uses`` x the source's size and the excess is dealt again by
    weight.  Along ascending size per weight, a source is full exactly if its cap is
    within the level that the sources from it on would share, so one pass of running
    sums settles all rounds."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cap, w = F.col("source_size") * float(max_uses), F.col("_w")
    by_level = W.orderBy(cap / w, "src")
    everything = W.partitionBy()
    level = (F.col("_all") * share - F.col("_before")) / F.col("_rest")
    return (
        per.withColumn("src", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long"))
        .withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int")))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_before", F.coalesce(F.sum(cap).over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum(w).over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_fits", (cap <= level * w).cast("int"))
        # the first open source's level, the highest, holds for all open ones
        .withColumn("_open", F.max(F.when(F.col("_fits") == 0, level)).over(everything))
        .select("src", "source", "source_size", F.when(F.col("_fits") == 1, cap).otherwise(F.col("_open") * w).alias("target"))
    )


def _point(i: Column) -> Column:
    """Van der Corput point of i in base 2: its binary digits mirrored at the point."""
    digits = F.bin(i)
    return F.conv(F.reverse(digits), 2, 10).cast("double") / F.pow(F.lit(2.0), F.length(digits))


def schedule(spark, targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mix: slot, src, block.  ``targets`` has src and target.

    Source s gets ceil(target / block_words) slots.  Where the points leave a source a
    few slots short (by their discrepancy, logarithmic in the number of slots), these
    follow at the end."""
    need = F.ceil(F.round("target") / block_words).cast("long")
    edges = W.orderBy("src")
    total = F.sum("_need").over(W.partitionBy())
    cum = staged(
        targets.select("src", need.alias("_need"))
        .where("_need > 0")
        .withColumn("_hi", F.sum("_need").over(edges.rowsBetween(W.unboundedPreceding, 0)) / total)
        .withColumn("_lo", F.coalesce(F.lag("_hi").over(edges), F.lit(0.0)))
    )
    slots = cum.agg(F.coalesce(F.sum("_need"), F.lit(0))).first()[0]
    cell = lambda u: F.least(F.floor(u * POINT_CELLS), F.lit(POINT_CELLS - 1))
    by_cell = cum.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    dealt = (
        spark.range(slots)
        .select(F.col("id").alias("slot"), _point(F.col("id")).alias("_u"))
        .withColumn("_cell", cell(F.col("_u")))
        .join(by_cell, "_cell")
        .where("_lo <= _u and _u < _hi")
        .select("slot", "src", F.floor(F.col("slot") / SLOTS_PER_CELL).alias("_part"))
    )
    dealt = staged(dealt)
    parts = dealt.groupBy("src", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("src").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("src", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("src", "_part").orderBy("slot")
    ranked = dealt.join(offsets, ["src", "_part"]).select(
        "slot", "src", (F.col("_offset") + F.row_number().over(inside) - 1).alias("block")
    )
    have = parts.groupBy("src").agg(F.sum("_n").alias("_have"))
    short = cum.join(have, "src", "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    closing = short.where("_have < _need").select(
        "src", F.explode(F.sequence(F.col("_have"), F.col("_need") - 1)).alias("block")
    )
    return (
        ranked.join(cum.select("src", "_need"), "src")
        .where("block < _need")
        .select("slot", "src", "block")
        .unionByName(closing.select((F.lit(slots) + F.col("block")).alias("slot"), "src", "block"))
    )


def place(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``start`` of every row on its source's line: words of the rows before it in
    shuffled order.  ``rows`` has src, size and doc_id."""
    mixed = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = rows.withColumn("_h", mixed).withColumn("_cell", F.shiftrightunsigned("_h", 64 - DOC_CELLS_LOG2))
    cells = rows.groupBy("src", "_cell").agg(F.sum("size").alias("_words"))
    before = W.partitionBy("src").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select("src", "_cell", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("src", "_cell").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(offsets, ["src", "_cell"])
        .withColumn("start", F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .drop("_h", "_cell", "_offset")
    )


def block_pieces(placed: DataFrame, block_words: int = BLOCK_WORDS, max_uses: int = MAX_USES) -> DataFrame:
    """One row per document, use and block of its source's line that it reaches into:
    block, words.  ``placed`` has start, size, source_size and target."""
    limit = F.round("target").cast("long")
    uses = F.sequence(F.lit(0), F.lit(max_uses - 1))
    return (
        placed.where("size > 0")
        .withColumn("_use", F.explode(uses))
        .withColumn("_from", F.col("start") + F.col("_use") * F.col("source_size"))
        .withColumn("_to", F.least(F.col("_from") + F.col("size"), limit))
        .where("_to > _from")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("_from") / block_words), F.floor((F.col("_to") - 1) / block_words))))
        .withColumn(
            "words",
            F.least("_to", (F.col("block") + 1) * block_words) - F.greatest("_from", F.col("block") * block_words),
        )
        .drop("_use", "_from", "_to")
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    max_uses: int = MAX_USES,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Words each document gives to the mix: doc_id, size, source_size, target, taken.

    A document's words are taken ``max_uses`` times at most, each source's words add up
    to its target (rounded to a word).  Equal inputs give equal results, whatever the
    partitioning."""
    sizes = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = staged(source_targets(sizes, weights, share, max_uses))
    rows = sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop(
        "source", "_source"
    )
    placed = staged(place(rows, seed))
    slots = schedule(docs.sparkSession, targets, block_words)
    taken = (
        block_pieces(placed, block_words, max_uses)
        .join(slots, ["src", "block"])
        .groupBy("src", "start", "size")
        .agg(F.sum("words").alias("taken"))
    )
    # of the rows with words no two begin at one place of their source's line
    return (
        placed.join(taken, ["src", "start", "size"], "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
