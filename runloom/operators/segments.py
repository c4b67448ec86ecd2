"""Windows over runs of any length.

A window partitioned by run alone puts a whole run into one task, and one run may
hold a third of the data.  Here each run is cut into segments of ``size`` samples
and every segment is given copies of the neighbouring samples its frames reach
(``back`` before it, ``ahead`` after it).  A frame then never leaves its segment, so
the result equals the whole-run window while no window partition exceeds
``size + back + ahead`` rows.  The copies are dropped at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT_ROWS = 8192
SEG, OWN = "_seg", "_own"


def cut(
    df: DataFrame, back: int, ahead: int, run: str = "run_id", order: str = "sample_idx", size: int = SEGMENT_ROWS
) -> DataFrame:
    """Rows with their segment; border rows are repeated in the segments that
    need them.  ``order`` must be the dense 0-based sample position."""
    pos = F.col(order).cast("long")

    def segment_of(p):
        return F.floor(p / F.lit(size))

    first = F.greatest(segment_of(pos - ahead), F.lit(0).cast("long"))
    return (
        df.withColumn(SEG, F.explode(F.sequence(first, segment_of(pos + back))))
        .withColumn(OWN, F.col(SEG) == segment_of(pos))
        # named here so that an earlier shuffle on the run alone is not reused
        .repartition(F.col(run), F.col(SEG))
    )


def per_segment(constants: DataFrame, size: int = SEGMENT_ROWS) -> DataFrame:
    """Per-run values repeated for every segment of the run (its last sample is
    ``n_samples - 1``), to join without moving the samples."""
    last = F.floor((F.col("n_samples") - 1) / F.lit(size))
    return constants.withColumn(SEG, F.explode(F.sequence(F.lit(0).cast("long"), last + 1))).drop("n_samples")


def over_runs(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    run: str = "run_id",
    order: str = "sample_idx",
    size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Apply ``build(rows, window)``; its frames may reach ``back`` samples into
    the past and ``ahead`` into the future, and each sample comes out once."""
    rows = cut(df, back, ahead, run, order, size)
    window = W.partitionBy(run, SEG).orderBy(order)
    return build(rows, window).where(F.col(OWN)).drop(SEG, OWN)
