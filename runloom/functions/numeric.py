"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def clip(x: Column, lo, hi) -> Column:
    """``x`` held inside [lo, hi]; NULL stays NULL."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def flag(condition: Column) -> Column:
    return condition.cast("double")


def ratio(num: Column, den: Column, empty: float | None = None) -> Column:
    """``num / den``; ``empty`` (or NULL) where the denominator is zero."""
    value = F.try_divide(num.cast("double"), den.cast("double"))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column."""

    def clean(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            return F.when(~bad, c).alias(field.name)
        return c

    return df.select([clean(f) for f in df.schema.fields])


# Identifiers and labels that are never model inputs.
NOT_INPUTS = (
    "y_breach",
    "y_time_to_breach_min",
    "run_id",
    "from_grade",
    "to_grade",
    "primary_cause",
    "sample_idx",
    "t_min",
)


def model_inputs(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns that may feed a model: identifiers, labels, forward
    targets and anything in ``exclude`` are left out."""
    skip = set(NOT_INPUTS) | set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NUMERIC) and f.name not in skip and not f.name.startswith("y_fwd_")
    ]


def narrow_doubles(df: DataFrame, keep: Iterable[str] = ("run_id", "sample_idx", "y_breach")) -> DataFrame:
    """Doubles to floats, for a smaller cache on disk; ``keep`` stays as is."""
    keep = set(keep)
    return df.select(
        [
            F.col(f.name).cast("float").alias(f.name)
            if isinstance(f.dataType, T.DoubleType) and f.name not in keep
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rounded(df: DataFrame, digits: int = 6, only: Iterable[str] | None = None) -> DataFrame:
    """Round floating columns for output."""
    only = set(only) if only is not None else None

    def text(f: T.StructField) -> str:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (only is None or f.name in only):
            return f"round(cast(`{f.name}` as double), {digits}) AS `{f.name}`"
        return f"`{f.name}`"

    return df.selectExpr(*[text(f) for f in df.schema.fields])
