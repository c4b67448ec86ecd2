"""Features and alarms of a live sample stream, equal to the batch results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.api.indexers import BaseIndexer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.dims import ALL_TAGS, SETPOINT_TAGS
from runloom.functions.numeric import finite_or_null
from runloom.operators import features as feat
from runloom.operators.segments import SEG, SEGMENT_ROWS
from runloom.operators.stage import discard, staged
from runloom.settings import RunSpec
from runloom.sources.commits import Folder
from runloom.streaming.ordered import ordered_stream


class _Trailing(BaseIndexer):
    """Windows from the given first rows up to each row."""

    def __init__(self, first: np.ndarray):
        super().__init__()
        self.first = first

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.first.astype(np.int64), np.arange(1, num_values + 1, dtype=np.int64)


def windowed_stream(samples: DataFrame, spec: RunSpec, size: int = SEGMENT_ROWS, stamp: str | None = None, **gaps) -> DataFrame:
    """Samples past the warm-up with rates and trailing statistics, all that the features
    need of a run's past.  ``stamp`` names a timestamp column to carry along."""
    values = ["t_min", *ALL_TAGS, *SETPOINT_TAGS, "bw_dev_pct", "bw_abs_dev_pct"]
    at = {v: i for i, v in enumerate(values)}
    steps = {which: (spec.steps(m), m, tags) for which, (m, tags) in feat.LOOKBACKS.items()}
    wide = spec.steps(2.0)

    def block(positions: np.ndarray, table: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        row = np.arange(len(table))
        for which, (n, minutes, tags) in steps.items():
            past = np.maximum(np.where(positions >= n, row - n, 0), begins)
            for tag in tags:
                x = table[:, at[tag]]
                out[f"_{which}_{tag}"] = (x - x[past]) / minutes
        trailing = _Trailing(np.maximum(row - wide + 1, begins))
        dev = pd.Series(table[:, at["bw_dev_pct"]]).rolling(trailing, min_periods=1)
        high = pd.Series(table[:, at["bw_abs_dev_pct"]]).rolling(trailing, min_periods=1)
        out["bw_dev_max_2min"] = high.max().to_numpy()
        out["bw_dev_mean_2min"] = dev.mean().to_numpy()
        out["bw_dev_std_2min"] = np.nan_to_num(dev.std().to_numpy())
        return out

    output = ", ".join(f"{name} double" for name in [*feat.RATES, *feat.TRAILING])
    rows = feat.with_deviation(samples)
    if stamp is not None:
        # micros of our time are exact in a double
        rows, values = rows.withColumn("_us", F.unix_micros(F.col(stamp).cast("timestamp")).cast("double")), [*values, "_us"]
    out = finite_or_null(ordered_stream(rows, values, wide, block, output, size=size, many=True, **gaps)).where(F.col("sample_idx") >= spec.warmup)
    return out.withColumn("_us", F.timestamp_micros(F.col("_us").cast("long"))).withColumnRenamed("_us", stamp) if stamp is not None else out


def stream_features(
    samples: DataFrame, meta: DataFrame, grades: DataFrame, spec: RunSpec, size: int = SEGMENT_ROWS, **gaps,
) -> DataFrame:
    """The feature table of a sample stream, without the forward labels, which
    need samples that have not come yet.  ``meta`` and ``grades`` are static; a run that
    ``meta`` lacks stops the stream with its name, as it stops the batch.  Where metadata
    comes as a stream, maybe after the samples, use :func:`match_metadata`."""
    return with_context(windowed_stream(samples, spec, size, **gaps), feat.run_context(meta, grades), spec)


def with_context(rows: DataFrame, context: DataFrame, spec: RunSpec) -> DataFrame:
    """The features of :func:`windowed_stream`'s rows: stateless, so a stream may end with
    it, or store the narrower rows and leave this to the reader."""
    context = context.withColumn("_known", F.lit(True))
    told = F.raise_error(F.concat(F.lit("unknown run: "), F.col("run_id").cast("string"))).cast("long")
    return (
        rows.join(context, "run_id", "left")
        .withColumn("run_id", F.when(F.col("_known"), F.col("run_id")).otherwise(told))
        .select(*feat.IDENTIFIERS, *feat.as_columns(feat.feature_expressions(spec)))
    )


META_COLUMNS = ("from_grade", "to_grade", "primary_cause", "plan_ramp_min", "plan_lead_scale", "plan_tau_c_scale", "plan_trim_enabled", "plan_start_min")


def _first_told(meta: DataFrame, meta_time: str, wait: str) -> DataFrame:
    """Run, stamp and columns of the metadata; of repeated metadata of a run the first counts."""
    told = meta.select(F.col("run_id").alias("_run"), F.col(meta_time).alias("_at"), F.struct(*META_COLUMNS).alias("_meta"))
    return told.withWatermark("_at", wait).dropDuplicatesWithinWatermark(["_run"])


def match_metadata(windowed: DataFrame, meta: DataFrame, time: str, meta_time: str, wait: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Rows of :func:`windowed_stream` (read back as a stream) with their run's metadata
    in ``_meta``, whichever comes first.

    An outer join of the two streams: rows wait for metadata stamped within ``span`` of
    them.  Once the watermark, which lags by ``wait``, says that none can come any more,
    a row goes on with ``_meta`` null.  Of repeated metadata of a run the first counts.
    Rows without a run_id match nothing; they may serve as heartbeats of a quiet source.
    The state holds whole rows; where they are stored, :func:`match_stretches` holds less."""
    near = F.expr(f"_at BETWEEN `{time}` - INTERVAL {span} AND `{time}` + INTERVAL {span}")
    right = _first_told(meta, meta_time, wait)
    return windowed.withWatermark(time, wait).join(right, (F.col("run_id") == F.col("_run")) & near, "left_outer").drop("_run", "_at")


STRETCH = "run_id long, _from long, _to long, _first long, _last long, _rows long"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one run, segment and slice of time that follow each other, as one entry."""
    for batch in batches:
        if not len(batch):
            continue
        known = pc.is_valid(batch["run_id"]).to_numpy(zero_copy_only=False)
        run = pc.fill_null(batch["run_id"], 0).to_numpy()
        at, us, part = (batch[c].to_numpy() for c in ("sample_idx", "_us", "_slice"))
        order = np.lexsort((at, part, run, known))
        known, run, at, us, part = (x[order] for x in (known, run, at, us, part))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(at // SEGMENT_ROWS) != 0)
        for x in (known, run, part):
            new[1:] |= x[1:] != x[:-1]
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(order))
        columns = [at[start], at[end - 1], np.minimum.reduceat(us, start), np.maximum.reduceat(us, start), end - start]
        names = [c.split()[0] for c in STRETCH.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(run[start], mask=~known[start]), *[pa.array(c) for c in columns]], names)


def match_stretches(windowed: DataFrame, meta: DataFrame, time: str, meta_time: str, wait: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """:func:`match_metadata` for rows that stay stored: the state of the join holds one
    entry per stretch of a run (``_from`` to ``_to`` of ``sample_idx``, ``_rows`` rows), not
    the rows.  ``windowed`` needs run_id, sample_idx, each pair once, and ``time``.

    An entry meets the metadata that lies within ``span`` of any of its rows; of these
    rows, those stamped from ``_low`` to ``_high`` match, all of them where ``_whole``.
    An entry covers at most half a span, so no metadata falls between its rows."""
    us, width = F.unix_micros(F.col(time)), F.expr(f"greatest(unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {span}) DIV 2, 1L)")
    rows = windowed.where(F.col(time).isNotNull()).select("run_id", F.col("sample_idx").cast("long"), us.alias("_us"), F.floor(us / width).alias("_slice"))
    entries = rows.mapInArrow(_stretches, STRETCH).withColumns({c: F.timestamp_micros(c) for c in ("_first", "_last")})
    # the second bound follows from the first; it tells the watermark when metadata is done
    near = F.expr(f"_at <= _last + INTERVAL {span} AND _at >= _first - INTERVAL {span} AND _at >= _last - INTERVAL {span} - INTERVAL {span}")
    matched = entries.withWatermark("_last", wait).join(_first_told(meta, meta_time, wait), (F.col("run_id") == F.col("_run")) & near, "left_outer")
    low, high = F.expr(f"_at - INTERVAL {span}"), F.expr(f"_at + INTERVAL {span}")
    whole = F.col("_meta").isNull() | ((F.col("_first") >= low) & (F.col("_last") <= high))
    return matched.select("run_id", "_from", "_to", "_rows", low.alias("_low"), high.alias("_high"), whole.alias("_whole"), "_meta")


def track_features(
    matched: DataFrame, grades: DataFrame, spec: RunSpec, path: str, checkpoint: str, stored: DataFrame | None = None, time: str = "ts", **trigger,
) -> StreamingQuery:
    """Write the features of matched rows under ``path``/features and the others, with
    run, number of rows and reason, under ``path``/rejects.  Batches appear whole and by
    number, so a repeated batch adds nothing.  For :func:`match_stretches`, ``stored`` is the
    table that its rows came from and ``time`` their stamp."""

    def of_stretches(entries: DataFrame) -> DataFrame:
        """Stored rows of the entries, moved once, by (run, segment)."""
        rows = (stored if not entries.isEmpty() else stored.limit(0)).withColumn(SEG, F.floor(F.col("sample_idx") / F.lit(SEGMENT_ROWS)))
        keyed = entries.withColumn(SEG, F.floor(F.col("_from") / F.lit(SEGMENT_ROWS)))
        return rows.join(keyed, ["run_id", SEG]).where(F.col("sample_idx").between(F.col("_from"), F.col("_to")))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = staged(batch.where(F.col("run_id").isNotNull()))
        meta = rows.where(F.col("_meta").isNotNull()).groupBy("run_id").agg(F.first("_meta").alias("_m")).select("run_id", "_m.*")
        meta = staged(meta)
        strange = staged(feat.grade_rejects(meta, grades).select("run_id").distinct())
        context = feat.run_context(meta.join(strange, "run_id", "left_anti"), grades)
        reason = F.when(F.col("_meta").isNull(), "no metadata").otherwise("unknown grade")
        lost = rows.join(strange.withColumn("_s", F.lit(True)), "run_id", "left").where(F.col("_meta").isNull() | F.col("_s").isNotNull())
        if stored is None:
            told = rows.drop("_meta").join(context, "run_id")
            lost = lost.groupBy("run_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
        else:
            near = F.col(time).between(F.col("_low"), F.col("_high"))
            entries = staged(rows.where(F.col("_meta").isNotNull()).drop("_meta", "_rows").join(context, "run_id"))
            told = of_stretches(entries).where(near)
            lost = lost.where("_whole").select("run_id", reason.alias("reason"), "_rows")
            torn = rows.where(~F.col("_whole")).join(strange.withColumn("_s", F.lit(True)), "run_id", "left")
            if not torn.isEmpty():
                why = F.when(~near, "no metadata").when(F.col("_s"), "unknown grade")
                rest = of_stretches(torn.drop("_meta", "_rows")).select("run_id", why.alias("reason"), F.lit(1).cast("long").alias("_rows"))
                lost = lost.unionByName(rest.where(F.col("reason").isNotNull()))
            lost = lost.groupBy("run_id", "reason").agg(F.sum("_rows").alias("n_rows"))
        features = told.select(*feat.IDENTIFIERS, *feat.as_columns(feat.feature_expressions(spec)))
        for name, table in (("features", features), ("rejects", lost)):
            folder = Folder(spark, f"{path}/{name}")
            hidden = folder.fresh()
            table.write.parquet(folder.at(hidden))
            folder.publish(hidden, f"batch-{number}")
        for table in (rows, meta, strange, *([entries] if stored is not None else [])):
            discard(table)

    return matched.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_tracked(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``features`` or ``rejects`` of :func:`track_features`."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{path}/{name}")


def stream_alarms(
    scored: DataFrame, threshold: float, delay: int, start: int = 0, size: int = SEGMENT_ROWS, **gaps
) -> DataFrame:
    """``alarm`` once the score has reached the threshold ``delay`` times in a
    row; ``delay=1`` means no on-delay.  ``scored``: run_id, sample_idx, proba."""

    def block(positions: np.ndarray, table: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        place = np.arange(len(table))
        # the row before a run is as good as quiet
        last_quiet = np.maximum.accumulate(np.where(table[:, 0] >= threshold, begins - 1, place))
        return {"alarm": place - last_quiet >= delay}

    return ordered_stream(scored, ["proba"], max(delay - 1, 0), block, "alarm boolean", size=size, start=start, many=True, **gaps)
