"""Running totals, ranks and exact percentiles without a one-task window.

Prefix sums over range partitions: rows are range-partitioned by (keys, position), and
each partition is a cell; so there are as many cells as partitions, they hold about as
many rows each whatever the spread of the values, and a group that holds most rows is
just several cells.  The cells are staged once with their number, each is summed on its
own, and the small table of cell totals supplies offset and total of the keys.  Cell
numbers grow with the position, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.operators.stage import staged

_POS, _CELL = "_rt_pos", "_rt_cell"


def _join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Null-safe equi-join on ``on``."""
    renamed = right.select([F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = None
    for c in on:
        part = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition).drop(*[f"_r_{c}" for c in on])


def in_cells(df: DataFrame, position: Column, keys: Sequence[str] = (), order_by: Sequence[Column] = (), cells: int | None = None) -> DataFrame:
    """Rows by range of (keys, position, order_by), staged with the number of their cell.
    Without ``cells`` the planner's partition size decides on their number."""
    rows = df.withColumn(_POS, position.cast("double"))
    by = [*[F.col(k) for k in keys], F.col(_POS), *order_by]
    ranged = rows.repartitionByRange(cells, *by) if cells else rows.repartitionByRange(*by)
    return staged(ranged.withColumn(_CELL, F.spark_partition_id()))


def running_totals(
    df: DataFrame,
    position: Column,
    measures: Sequence[str],
    keys: Sequence[str] = (),
    order_by: Sequence[Column] = (),
    cells: int | None = None,
) -> DataFrame:
    """Add, per measure ``m``, ``m_upto`` = its sum over the rows of the same keys
    up to and including this row, ascending by ``position`` (ties by ``order_by``),
    and ``m_total`` = its sum over all rows of the keys.

    ``position`` is a non-null double that never decreases along the wanted order.
    Rows with equal position and no ``order_by`` share the same total (and a cell, so
    callers count equal values first)."""
    keys, at = list(keys), [*keys, _CELL]
    rows = in_cells(df, position, keys, order_by, cells)
    sums = rows.groupBy(*at).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = group.orderBy(_CELL).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *at,
        *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_c_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(group).alias(f"{m}_total") for m in measures],
    )
    w = W.partitionBy(*at).orderBy(_POS, *order_by)
    inside = (w.rowsBetween if order_by else w.rangeBetween)(W.unboundedPreceding, 0)
    upto = [(F.sum(m).over(inside) + F.col(f"_c_{m}")).alias(f"{m}_upto") for m in measures]
    return _join(rows, offsets, at).select(*df.columns, *[f"{m}_total" for m in measures], *upto)


def hash_position(*parts: Column) -> Column:
    """Stable shuffle key: md5 of the parts joined by ``|``, hex text."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def shuffled_rank(df: DataFrame, ident: str, seed: int, keys: Sequence[str] = (), name: str = "rank", cells: int | None = None) -> DataFrame:
    """1-based place of each row in a seeded, reproducible shuffle within keys."""
    rows = df.withColumn("_md5", hash_position(F.col(ident), F.lit(seed))).withColumn("_one", F.lit(1).cast("long"))
    # 13 hex digits are 52 bits: exact in a double and in md5 order
    position = F.conv(F.substring("_md5", 1, 13), 16, 10).cast("double")
    ranked = running_totals(rows, position, ["_one"], keys, [F.col("_md5"), F.col(ident)], cells)
    return ranked.withColumnRenamed("_one_upto", name).drop("_md5", "_one", "_one_total")


def exact_percentiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), totals: dict[str, Column] | None = None,
    cells: int | None = None,
) -> DataFrame:
    """Linear-interpolated percentiles of ``value`` (NULLs skipped), one row per
    keys, next to any additive ``totals`` (aggregates that may be summed again).
    Equal values are counted first, so heavy repeats cost nothing."""
    keys, totals = list(keys), totals or {}
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_w"), *[c.alias(n) for n, c in totals.items()])
    # rows without a value weigh nothing; they only carry the totals
    seen = running_totals(counts, F.coalesce(F.col(value), F.lit(0.0)), ["_w", *totals], keys, cells=cells)
    picks = []
    for name, p in probs.items():
        rank = (F.col("_w_total") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (F.col("_w_upto") > at) & (F.col("_w_upto") - F.col("_w") <= at)
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}"))
    carried = [F.max(f"{n}_total").alias(n) for n in totals]
    out = seen.groupBy(*keys).agg(F.max("_w_total").alias("_w_total"), *carried, *picks)
    final = []
    for name, p in probs.items():
        rank = (F.col("_w_total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        final.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return out.select(*keys, *totals, *final)


def first_by_hash(df: DataFrame, ident: str, n: int, seed: int, cells: int = 1 << 16) -> DataFrame:
    """The ``n`` rows with the smallest md5 of id and seed, ties by id (all, if fewer).

    Distributed bottom-k: one pass counts rows by the leading bits of the hash, in
    ``cells`` cells; the cell in which the count passes ``n`` is the border.  A second
    pass takes all rows before it, and only rows of the border cell are ranked."""
    if cells & (cells - 1) or not 1 < cells <= 1 << 24:
        raise ValueError("cells must be a power of two up to 2^24")
    rows = df.withColumn("_md5", hash_position(F.col(ident), F.lit(seed)))
    rows = rows.withColumn(_CELL, F.shiftright(F.conv(F.substring("_md5", 1, 6), 16, 10).cast("int"), 25 - cells.bit_length()))
    upto = F.sum("_n").over(W.orderBy(_CELL).rowsBetween(W.unboundedPreceding, 0))  # one row a cell
    counts = rows.groupBy(_CELL).agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", upto)
    border = counts.where(F.col("_upto") >= n).agg(F.min(F.struct(_CELL, (F.col("_upto") - F.col("_n")).alias("before"))).alias("b")).first().b
    if border is None:
        return rows.drop("_md5", _CELL)
    near = staged(rows.where(F.col(_CELL) <= border[0]))
    place = F.row_number().over(W.partitionBy(_CELL).orderBy("_md5", ident))
    last = near.where(F.col(_CELL) == border[0]).withColumn("_place", place).where(F.col("_place") <= n - border["before"])
    return near.where(F.col(_CELL) < border[0]).unionByName(last.drop("_place")).drop("_md5", _CELL)


def number_samples(
    df: DataFrame, run: str, time: str, ties: Sequence[str] = (), name: str = "sample_idx", rows_per_slice: int = 1_000_000,
) -> DataFrame:
    """Dense 0-based position of each row inside its run by (time, ties).

    A run of up to ``rows_per_slice`` rows is numbered as it is.  The time axis of a
    longer run is cut into slices, four times as many as its rows ask for; rows are
    numbered inside (run, slice) and shifted by the count of the earlier slices.  Only
    long runs appear in the two small tables, so ordinary runs cost one shuffle."""
    rows = df.withColumn("_us", F.expr(f"unix_micros(cast(`{time}` as timestamp))"))
    n, slices = F.col("_n"), F.ceil(F.col("_n") * 4 / F.lit(rows_per_slice))
    long = staged(
        rows.groupBy(run)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_from"), F.max("_us").alias("_to"))
        .where(n > rows_per_slice)
        .select(run, "_from", F.ceil((F.col("_to") - F.col("_from") + 1) / slices).cast("long").alias("_width"))
    )
    cut = F.coalesce(F.floor((F.col("_us") - F.col("_from")) / F.col("_width")), F.lit(0)).cast("long")
    rows = rows.join(long, run, "left").withColumn("_slice", cut)
    earlier = W.partitionBy(run).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.where(F.col("_width").isNotNull())
        .groupBy(run, "_slice")
        .agg(F.count(F.lit(1)).alias("_in"))
        .select(run, "_slice", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = W.partitionBy(run, "_slice").orderBy("_us", *ties)
    place = F.coalesce("_before", F.lit(0)) + F.row_number().over(inside) - 1
    # named here so that the rows are spread by slice, not by run alone
    joined = rows.repartition(run, "_slice").join(offsets, [run, "_slice"], "left")
    return joined.select(*df.columns, place.cast("long").alias(name))
