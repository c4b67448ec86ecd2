"""Why a score is high: linear attribution, surrogate, permutation, consensus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.models import input_stages
from runloom.operators.ordered import hash_position
from runloom.operators.scores import ranking_scores
from runloom.operators.splits import seeded_sample
from runloom.operators.stage import staged

RIDGE_ALPHA = 1.0
BLOCK_ROWS = 512
STEP = 7919  # places between the donors of one repeat and the next, round the block


def linear_attribution(rows: DataFrame, weights: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """Exact attribution of a linear score: ``phi`` (array of feature, phi) sums,
    with ``base``, to the score.  Feature means are one bounded row."""
    means = rows.agg(F.struct(*[F.avg(f).alias(f) for f in weights]).alias("m")).scalar()
    phi = [F.struct(F.lit(f).alias("feature"), (F.lit(w) * (F.col(f) - F.col("_m")[f])).alias("phi")) for f, w in weights.items()]
    base = F.lit(float(intercept))
    for f, w in weights.items():
        base = base + F.lit(w) * F.col("_m")[f]
    return rows.withColumn("_m", means).select(*rows.columns, base.alias("base"), F.array(*phi).alias("phi"))


def logistic_weights(model: PipelineModel, features: Sequence[str]) -> tuple[dict[str, float], float]:
    """Raw-space weights and intercept of a scaler + logistic pipeline."""
    scaler, logit = model.stages[-2], model.stages[-1]
    mean, std, coef = scaler.mean.toArray(), scaler.std.toArray(), logit.coefficients.toArray()
    raw = {f: float(c / s) if s else 0.0 for f, c, s in zip(features, coef, std)}
    return raw, float(logit.intercept) - sum(raw[f] * m for f, m in zip(features, mean))


def surrogate_attribution(
    scored: DataFrame, features: Sequence[str], proba: str = "proba", max_rows: int | None = None,
    ident: str = "run_id", seed: int = 0,
) -> DataFrame:
    """Approximate attribution: a ridge fit of the model's own scores on
    standardised features.  ``exact`` is false to say so.  ``max_rows`` explains a
    seeded sample instead of all rows."""
    if max_rows is not None:
        scored = seeded_sample(scored, ident, max_rows, seed)
    # the solver scales the label to a deviation of one, and so the penalty by its inverse
    n, spread = scored.agg(F.count(F.lit(1)), F.stddev_pop(proba)).first()
    penalty = RIDGE_ALPHA / max(n, 1) * (spread or 1.0)
    model = Pipeline(
        stages=[
            *input_stages(features),
            StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True),
            LinearRegression(featuresCol="z", labelCol=proba, elasticNetParam=0.0, regParam=penalty, standardization=False),
        ]
    ).fit(scored)
    ridge = model.stages[-1]
    z = vector_to_array("z")
    phi = [
        F.struct(F.lit(f).alias("feature"), (F.lit(float(ridge.coefficients[i])) * z[i]).alias("phi"))
        for i, f in enumerate(features)
    ]
    return model.transform(scored.drop("prediction")).select(
        *scored.columns, F.lit(float(ridge.intercept)).alias("base"), F.array(*phi).alias("phi"), F.lit(False).alias("exact")
    )


def attribution_long(attributed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attributed.select(*keys, F.explode("phi").alias("_p")).select(*keys, "_p.feature", "_p.phi")


def mean_abs(attributed: DataFrame) -> DataFrame:
    return attribution_long(attributed, []).groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def top_drivers(phi: Column, k: int = 8) -> Column:
    """The k largest contributions of a row, strongest first, inside the row: no
    shuffle.  Equal strengths go by feature name."""
    strength = F.transform(phi, lambda p: F.struct((-F.abs(p["phi"])).alias("s"), p["feature"].alias("feature"), p["phi"].alias("phi")))
    return F.transform(
        F.slice(F.array_sort(strength), 1, k),
        lambda p: F.struct(
            p["feature"].alias("feature"), p["phi"].alias("phi"),
            F.when(p["phi"] > 0, "increases risk").otherwise("reduces risk").alias("direction"),
        ),
    )


def by_columns(scorer: Callable[[dict[str, Column]], Column], features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """A scorer of frames from one of columns."""
    return lambda rows: rows.withColumn("proba", scorer({f: F.col(f) for f in features}))


def permuted_rows(
    rows: DataFrame, ident: str, features: Sequence[str], repeats: int, seed: int = 0, y: str = "y_breach", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """feature, repeat, y and the features: all rows as they are (feature "", repeat 0),
    and per feature and repeat all rows with that feature of another row.

    Rows are dealt to blocks of about ``block_rows`` by a seeded hash of the id and
    ordered by it; in repeat r each row's donor is a fixed number of places further on in
    its block, round and round, so every row gives once.  One shuffle forms the blocks;
    the permuted rows are made from them in place."""
    md5 = hash_position(F.col(ident), F.lit(seed))
    n_blocks = F.greatest(F.ceil(F.col("_n") / F.lit(block_rows)), F.lit(1)).cast("long")
    n = rows.agg(F.count(F.lit(1))).scalar()
    member = F.struct(md5.alias("_md5"), F.col(ident).alias("_id"), F.col(y).alias("y"), *features)
    block = F.conv(F.substring("_m._md5", 1, 15), 16, 10).cast("long") % n_blocks
    blocks = (
        rows.select(member.alias("_m")).withColumn("_n", n).groupBy(block.alias("_block")).agg(F.array_sort(F.collect_list("_m")).alias("_b"))
    )
    m = F.size("_b")
    far = [1 + F.pmod(F.lit(r * STEP), F.greatest(m - 1, F.lit(1))) for r in range(1, repeats + 1)]
    places = F.transform(
        F.sequence(F.lit(0), m - 1),
        lambda i: F.struct(F.get("_b", i).alias("own"), F.array(*[F.get("_b", F.pmod(i + d, m)) for d in far]).alias("donors")),
    )
    each = blocks.select(F.explode(places).alias("_p")).select("_p.*").withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(len(features) * repeats))))
    which, repeat = F.pmod(F.col("_v") - 1, F.lit(len(features))), F.floor((F.col("_v") + (len(features) - 1)) / len(features)).cast("int")
    each = each.select("own", F.get("donors", repeat - 1).alias("_d"), repeat.alias("repeat"), F.when(F.col("_v") > 0, which).alias("_w"))
    values = [F.when(F.col("_w") == j, F.col("_d")[f]).otherwise(F.col("own")[f]).alias(f) for j, f in enumerate(features)]
    name = F.coalesce(F.get(F.array(*[F.lit(f) for f in features]), F.col("_w")), F.lit(""))
    return each.select(name.alias("feature"), "repeat", F.col("own.y").alias("y"), *values)


def permutation_importance(
    rows: DataFrame, ident: str, features: Sequence[str], score: Callable[[DataFrame], DataFrame], repeats: int = 5, seed: int = 0,
    y: str = "y_breach", max_rows: int | None = None, digits: int = 4, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Drop in average precision when one feature is shuffled: mean and standard
    deviation over repeats, on held-out rows.  ``score`` adds ``proba`` to rows with the
    features, such as ``models.score`` of a fitted model or ``by_columns``.

    Rows travel once, into blocks of strangers.  Each task counts its positives and rows
    by (feature, repeat, score rounded to ``digits``), so what is shuffled for the scores
    is bounded by their number, whatever the number of rows.  ``max_rows`` takes a seeded
    sample instead of all rows."""
    if max_rows is not None:
        rows = seeded_sample(rows, ident, max_rows, seed)
    scored = score(permuted_rows(rows, ident, features, repeats, seed, y, block_rows))
    cells = scored.groupBy("feature", "repeat", F.round("proba", digits).alias("p"), "y").agg(F.count(F.lit(1)).alias("_n"))
    ap = staged(ranking_scores(cells, y="y", proba="p", by=["feature", "repeat"], n=F.col("_n")).select("feature", "repeat", "average_precision"))
    whole = ap.where(F.col("repeat") == 0).select("average_precision").scalar()
    drop = whole - F.col("average_precision")
    return (
        ap.where(F.col("repeat") > 0)
        .withColumn("_d", drop)
        .groupBy("feature")
        .agg(F.avg("_d").alias("importance"), F.stddev_pop("_d").alias("std"))
    )


def consensus(**views: DataFrame) -> DataFrame:
    """Merge importance views (feature, importance), each normalised by the sum
    of its absolute values; a feature a view lacks counts 0 there.  One row per
    feature with the mean of all views, best first."""
    merged = None
    for name, view in views.items():
        total = view.agg(F.sum(F.abs("importance"))).scalar()
        part = view.select(
            "feature", F.coalesce(F.try_divide(F.col("importance"), total), F.lit(0.0)).alias(f"{name}_norm")
        )
        merged = part if merged is None else merged.join(part, "feature", "full_outer")
    merged = merged.na.fill(0.0)
    share = sum((F.col(f"{n}_norm") for n in views), F.lit(0.0)) / len(views)
    return merged.withColumn("consensus", share).orderBy(F.desc("consensus"), "feature")
