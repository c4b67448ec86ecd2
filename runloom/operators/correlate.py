"""Lagged correlations between the tags of all runs.

Runs are cut into segments that carry the next ``max_lag`` samples, each segment is
packed into one bounded row, and every task adds up the pair sums of its segments
by fast Fourier transforms, all lags at once.  Only tasks x pairs x lags partial rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.segments import OWN, SEG, cut, over_runs
from runloom.operators.stage import staged

SEGMENT = 4096
LEAST_SPREAD = 1e-12


def series_long(samples: DataFrame, tags: Sequence[str]) -> DataFrame:
    """One row per sample and tag."""
    return samples.unpivot(["run_id", "sample_idx"], list(tags), "tag", "value")


def lagged_pairs(samples: DataFrame, cause: str, effect: str, lag: int) -> DataFrame:
    """(cause now, effect ``lag`` samples later) within a run; runs that leave
    one pair or none are skipped."""
    rows = over_runs(
        samples.select("run_id", "sample_idx", F.col(cause).alias("x"), F.col(effect).alias("y")),
        lambda r, w: r.withColumn("y", F.lead("y", lag).over(w)).withColumn(
            "_next", F.lead("sample_idx", lag + 1).over(w).isNotNull() | (F.col("sample_idx") > 0)
        ),
        ahead=lag + 1,
    )
    # a first sample without a successor pair means the run has a single pair
    return rows.where(F.col("y").isNotNull() & F.col("_next")).drop("_next")


def _packed(samples: DataFrame, tags: Sequence[str], ahead: int, size: int) -> DataFrame:
    """One row per segment: tag values in order (own samples, then up to
    ``ahead`` following ones) and how many of them are its own."""
    values = F.array(*[F.col(t).cast("double") for t in tags])
    rows = cut(samples.select("run_id", "sample_idx", values.alias("_v")), 0, ahead, size=size)
    packed = rows.groupBy("run_id", SEG).agg(
        F.array_sort(F.collect_list(F.struct("sample_idx", "_v"))).alias("_rows"),
        F.count_if(F.col(OWN)).alias("_own_n"),
    )
    return packed.where(F.col("_own_n") > 0).select(
        F.flatten(F.col("_rows._v")).alias("v"), F.col("_own_n").cast("int").alias("own"),
        # rows that exist before this segment: a pair of an earlier segment
        # proves that the run leaves more than one pair at any lag
        (F.col(SEG) > 0).alias("later"),
    )


def _pair_sums(batches: Iterator[pd.DataFrame], k: int, max_lag: int, center: np.ndarray) -> Iterator[pd.DataFrame]:
    """Sums of all pairs at all lags.  A segment carries the ``max_lag`` samples after its
    own, so its circular cross-correlation at a length that leaves room for the lags is
    the plain one (overlap-save): one transform a tag and one back a pair give all lags.
    The one-sided sums are differences of running sums."""
    lags = np.arange(max_lag + 1)
    n = np.zeros(max_lag + 1, np.int64)
    sums = {name: np.zeros((max_lag + 1, k, k)) for name in ("sx", "sy", "sxx", "syy", "sxy")}

    def running(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((1, k)), np.cumsum(x, axis=0)])

    for batch in batches:
        for flat, own, later in zip(batch["v"], batch["own"], batch["later"]):
            x = np.asarray(flat, dtype=float).reshape(-1, k) - center
            m = np.minimum(own, len(x) - lags)
            use = np.flatnonzero((m > 0) & ((m > 1) | bool(later)))
            if not len(use):
                continue
            m, lag = m[use], lags[use]
            n[use] += m
            one, two = running(x), running(x * x)
            sums["sx"][use] += one[m][:, :, None]
            sums["sxx"][use] += two[m][:, :, None]
            sums["sy"][use] += (one[lag + m] - one[lag])[:, None, :]
            sums["syy"][use] += (two[lag + m] - two[lag])[:, None, :]
            size = 1 << int(len(x) + max_lag).bit_length()
            ahead = np.fft.rfft(x, size, axis=0)
            here = np.conj(np.fft.rfft(x[:own], size, axis=0))
            for i in range(k):  # one cause at a time bounds the memory
                sums["sxy"][use, i] += np.fft.irfft(here[:, i : i + 1] * ahead, size, axis=0)[lag]
    i, j = np.nonzero(~np.eye(k, dtype=bool))
    for lag in lags[n > 0].tolist():
        out = {"ci": i, "ej": j, "lag": lag, "n": int(n[lag])}
        out |= {name: s[lag][i, j] for name, s in sums.items()}
        yield pd.DataFrame(out)


def _center(samples: DataFrame, tags: Sequence[str]) -> np.ndarray:
    """Tag means (one bounded row); sums around them keep r accurate."""
    row = samples.agg(*[F.avg(t) for t in tags]).first()
    return np.array([v if v is not None else 0.0 for v in row], dtype=float)


def pair_correlations(samples: DataFrame, tags: Sequence[str], max_lag: int, size: int = SEGMENT) -> DataFrame:
    """Pooled Pearson r of every ordered tag pair at every lag 0..max_lag; 0 for
    fewer than three pairs or a constant side."""
    tags, k = list(tags), len(tags)
    center = _center(samples, tags)
    parts = _packed(samples, tags, max_lag, size).mapInPandas(
        lambda it: _pair_sums(it, k, max_lag, center),
        "ci int, ej int, lag int, n long, sx double, sy double, sxx double, syy double, sxy double",
    )
    total = parts.groupBy("ci", "ej", "lag").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    vx = F.col("sxx") / n - (F.col("sx") / n) * (F.col("sx") / n)
    vy = F.col("syy") / n - (F.col("sy") / n) * (F.col("sy") / n)
    cov = F.col("sxy") / n - (F.col("sx") / n) * (F.col("sy") / n)
    floor = F.lit(LEAST_SPREAD**2)
    r = F.when((n >= 3) & (vx >= floor) & (vy >= floor), cov / F.sqrt(vx * vy)).otherwise(0.0)
    names = F.array(*[F.lit(t) for t in tags])
    return total.select(
        names[F.col("ci")].alias("cause"), names[F.col("ej")].alias("effect"), "lag", F.col("n").alias("n_samples"),
        F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)).alias("correlation"),
    )


def strongest_lags(pairs: DataFrame, min_abs: float, digits: int = 12) -> DataFrame:
    """Per pair the lag with the largest |r| (the smallest lag wins a tie) if it
    reaches ``min_abs``, strongest pair first."""
    strength = F.round(F.abs("correlation"), digits)
    best = pairs.where(F.col("correlation") != 0).groupBy("cause", "effect").agg(
        F.max_by(F.struct("lag", "correlation", "n_samples"), F.struct(strength, -F.col("lag"))).alias("_b")
    )
    return (
        best.select("cause", "effect", "_b.*")
        .where(F.abs("correlation") >= min_abs)
        .orderBy(F.desc(F.abs("correlation")), "cause", "effect")
    )


def mark_known(found: DataFrame, loops: DataFrame) -> DataFrame:
    """Flag links the control system already models, in either direction."""
    both = loops.select("cause", "effect").union(loops.select("effect", "cause")).distinct()
    return found.join(both.withColumn("_k", F.lit(True)), ["cause", "effect"], "left").select(
        *found.columns, F.coalesce("_k", F.lit(False)).alias("is_known")
    )


def novel(found: DataFrame, loops: DataFrame) -> DataFrame:
    """Links no known loop explains."""
    both = loops.select("cause", "effect").union(loops.select("effect", "cause")).distinct()
    return found.join(both, ["cause", "effect"], "left_anti")


def _bin_counts(
    batches: Iterator[pd.DataFrame], k: int, bins: int, lo: np.ndarray, width: np.ndarray, pairs: list[tuple[int, int, int]]
) -> Iterator[pd.DataFrame]:
    counts = np.zeros((len(pairs), bins, bins), dtype=np.int64)
    for batch in batches:
        for flat, own, later in zip(batch["v"], batch["own"], batch["later"]):
            x = np.asarray(flat, dtype=float).reshape(-1, k)
            cell = np.clip(np.floor((x - lo) / width * bins), 0, bins - 1).astype(int)
            for p, (i, j, lag) in enumerate(pairs):
                m = min(own, len(x) - lag)
                if m <= 0 or (m <= 1 and not later):
                    continue
                np.add.at(counts[p], (cell[:m, i], cell[lag : lag + m, j]), 1)
    p, a, b = np.nonzero(counts)
    yield pd.DataFrame({"p": p, "bx": a, "by": b, "c": counts[p, a, b]})


def mutual_information(
    samples: DataFrame, tags: Sequence[str], links: DataFrame, bins: int = 12, size: int = SEGMENT
) -> DataFrame:
    """Binned mutual information (nats) of each (cause, effect, lag) in ``links``,
    over all pairs.  ``links`` has at most tags x tags rows and is read as a list."""
    tags, k = list(tags), len(tags)
    wanted = [(r.cause, r.effect, r.lag) for r in links.select("cause", "effect", "lag").distinct().collect()]
    pairs = [(tags.index(c), tags.index(e), int(lag)) for c, e, lag in wanted]
    ends = samples.agg(*[F.min(t) for t in tags], *[F.max(t) for t in tags]).first()
    lo = np.array([v or 0.0 for v in ends[:k]], dtype=float)
    width = np.array([v or 0.0 for v in ends[k:]], dtype=float) - lo
    width[width <= 0] = 1.0
    ahead = max([lag for _, _, lag in pairs], default=0)
    parts = _packed(samples, tags, ahead, size).mapInPandas(
        lambda it: _bin_counts(it, k, bins, lo, width, pairs), "p int, bx int, by int, c long"
    )
    # at most links x bins x bins rows from here on
    joint = staged(parts.groupBy("p", "bx", "by").agg(F.sum("c").alias("c")))
    total = joint.groupBy("p").agg(F.sum("c").alias("n"))
    left = joint.groupBy("p", "bx").agg(F.sum("c").alias("cx"))
    right = joint.groupBy("p", "by").agg(F.sum("c").alias("cy"))
    share = F.col("c") / F.col("n")
    mi = F.sum(share * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy"))))
    scored = (
        joint.join(total, "p").join(left, ["p", "bx"]).join(right, ["p", "by"]).groupBy("p").agg(mi.alias("mutual_information"))
    )
    names = samples.sparkSession.createDataFrame(
        [(p, c, e, int(lag)) for p, (c, e, lag) in enumerate(wanted)], "p int, cause string, effect string, lag int"
    )
    return names.join(scored, "p", "left").select(
        "cause", "effect", "lag", F.coalesce("mutual_information", F.lit(0.0)).alias("mutual_information")
    )


def discover(
    samples: DataFrame, tags: Sequence[str], max_lag: int, min_abs: float, loops: DataFrame, step_min: float
) -> DataFrame:
    """The finished table: best lag, r, mutual information, known or novel."""
    links = staged(strongest_lags(pair_correlations(samples, tags, max_lag), min_abs))
    mi = mutual_information(samples, tags, links)
    return (
        mark_known(links.join(mi, ["cause", "effect", "lag"]), loops)
        .select(
            "cause", "effect", F.round(F.col("lag") * step_min, 3).alias("best_lag_min"),
            F.bround("correlation", 4).alias("correlation"), F.bround("mutual_information", 4).alias("mutual_information"),
            "n_samples", "is_known", (~F.col("is_known")).alias("novel"), F.lit("CORRELATION_DISCOVERY").alias("source"),
        )
        .orderBy(F.desc(F.abs("correlation")), "cause", "effect")
    )
