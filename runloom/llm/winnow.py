"""Document fingerprints by winnowing, in DataFrame functions alone.

A text's words (runs without white space) are hashed; a polynomial hash of every k
words is rolled up by doubling (k = 4: twice).  In every window of w hashes the
smallest is kept, on a tie the rightmost, with its position.  Two texts that share
k + w - 1 words in a row share a fingerprint entry; matches under k words never count.

A hash and its position travel as one number, hash first and position descending, so
that a plain minimum picks the rightmost smallest, and minima of windows double as
well: three steps for w = 8.

Defined results: a null text is an empty one and has an empty fingerprint; with fewer
than k words, all words together are the one hash; with fewer than w hashes, all of
them are the one window.  A null doc_id comes last in the order, equal ids go by text.  Two empty fingerprints are alike (1), an empty one is unlike
any other (0).  Repeated rows repeat; extra columns are ignored or carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.operators.stage import staged

GRAM_DOUBLINGS = 2  # k = 4 words
WINDOW_DOUBLINGS = 3  # w = 8 hashes
_PRIME = (1 << 31) - 1
_BASE = 1_000_003
_POSITIONS = 1 << 31
ROWS_PER_CELL = 500
CELLS = 512
ROWS_PER_SUBCELL = 20_000


def _joined(values: str, ahead: int):
    """Hash of a run and of the run ``ahead`` words later, as one."""
    lift = pow(_BASE, ahead, _PRIME)
    return lambda x, at: F.pmod(x * F.lit(lift) + F.coalesce(F.get(values, at + ahead), F.lit(0)), F.lit(_PRIME))


def _smaller(values: str, ahead: int):
    """The smaller of an entry and the one ``ahead`` later; past the end get() is null,
    which least() leaves out."""
    return lambda x, at: F.least(x, F.get(values, at + ahead))


def with_winnowed(df: DataFrame, text: str, out: str, grams: int = GRAM_DOUBLINGS, windows: int = WINDOW_DOUBLINGS) -> DataFrame:
    """Add ``out``: the kept entries of column ``text``, hash * 2^31 + (2^31 - 1 - position)."""
    k, w, tmp = 1 << grams, 1 << windows, f"_{out}"
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn(tmp, F.transform(words, lambda x: F.pmod(F.hash(x).cast("long"), F.lit(_PRIME))))
    for i in range(grams):
        df = df.withColumn(tmp, F.transform(tmp, _joined(tmp, 1 << i)))
    whole = F.greatest(F.size(tmp) - (k - 1), F.least(F.size(tmp), F.lit(1)))
    df = df.withColumn(tmp, F.transform(F.slice(tmp, F.lit(1), whole), lambda x, at: x * F.lit(_POSITIONS) + (F.lit(_POSITIONS - 1) - at)))
    for i in range(windows):
        df = df.withColumn(tmp, F.transform(tmp, _smaller(tmp, 1 << i)))
    full = F.greatest(F.size(tmp) - (w - 1), F.least(F.size(tmp), F.lit(1)))
    return df.withColumn(out, F.array_distinct(F.slice(tmp, F.lit(1), full))).drop(tmp)


def hashes(kept: str) -> Column:
    """Distinct hashes of the kept entries."""
    return F.array_distinct(F.transform(kept, lambda x: F.shiftright(x, 31)))


def rendered(kept: str) -> Column:
    """``hash:position`` of every entry, in order of position."""
    return F.array_join(
        F.transform(
            kept,
            lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit(":"), (F.lit(_POSITIONS - 1) - x.bitwiseAND(F.lit(_POSITIONS - 1))).cast("string")),
        ),
        " ",
    )


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two sets of hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def with_next(docs: DataFrame, values: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Add ``next_<value>`` from the next row by descending doc_id (null last, ties by
    text; after the last row the first).  ``docs`` has doc_id and text; ``derive`` adds further
    values behind the shuffle, so that only texts travel.

    Ids are cut into cells at their approximate percentiles (a bounded list), large
    cells again by equal steps, so a window only ever orders one cell.  The last row of
    a cell gets its values from the first row of the next cell."""
    ids = docs.select("doc_id")
    n = ids.count()
    cells = max(1, min(CELLS, n // ROWS_PER_CELL))
    steps = 1 + n // (CELLS * ROWS_PER_SUBCELL)
    points = [i / cells for i in range(1, cells)]
    found = ids.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.percentile_approx("doc_id", points or [0.5], F.lit(10_000)).alias("cut")).first()
    cuts = sorted({*(found.cut or [])[: len(points)]} - {found.lo})
    bounds = [found.lo or 0, *cuts, found.hi or 0]
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    cell = F.size(F.filter(F.slice(edges, F.lit(1), F.lit(len(bounds) - 1)), lambda b: b <= F.col("doc_id")))
    low, high = F.get(edges, F.col("_cell") - 1).cast("double"), F.get(edges, F.col("_cell")).cast("double")
    # doubles: ids may lie further apart than a long reaches; rounding keeps the order
    sub = F.floor((F.col("doc_id").cast("double") - low) * steps / F.greatest(high - low, F.lit(1.0)))

    def celled(df: DataFrame) -> DataFrame:
        df = df.withColumn("_cell", cell)
        return df.withColumn("_cell", F.coalesce(F.col("_cell") * F.lit(steps).cast("long") + sub, F.lit(-1).cast("long")))

    down = W.orderBy(F.col("_cell").desc())
    top = celled(ids).groupBy("_cell").agg(F.max("doc_id").alias("_top"))
    chain = staged(
        top.withColumn("_first", F.max("_top").over(W.partitionBy())).select(
            "_cell", "_top", F.when(F.lead("_cell").over(down).isNull(), F.col("_first")).otherwise(F.lead("_top").over(down)).alias("_next_top")
        )
    )
    by_text = W.partitionBy("doc_id").orderBy("text")
    heads = (
        docs.join(chain.select("_top"), F.col("doc_id").eqNullSafe(F.col("_top")))
        .drop("_top")
        .withColumn("_rank", F.row_number().over(by_text))
        .where("_rank = 1")
        .transform(derive)
        .select(F.col("doc_id").alias("_next_top"), *[F.col(v).alias(f"_head_{v}") for v in values])
        .withColumnRenamed("_next_top", "_head")
        .join(chain.select("_cell", "_next_top"), F.col("_head").eqNullSafe(F.col("_next_top")))
        .drop("_next_top", "_head")
    )
    inside = W.partitionBy("_cell").orderBy(F.col("doc_id").desc(), "text")
    rows = celled(docs).repartition("_cell").transform(derive)
    after = rows.withColumn("_after", F.lead(F.struct(*values)).over(inside))
    return (
        after.join(heads, "_cell", "left")
        .select(*[c for c in rows.columns if c != "_cell"], *[F.when(F.col("_after").isNotNull(), F.col("_after")[v]).otherwise(F.col(f"_head_{v}")).alias(f"next_{v}") for v in values])
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text (the last third of the code
    points replaced by as many of the next document's first), with their likeness to
    each other and to the next document."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, ["text", "kept"], lambda df: with_winnowed(df, "text", "kept")).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn(
        "edited",
        F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)),
    )
    rows = with_winnowed(rows.drop("text", "next_text"), "edited", "edited_kept")
    sets = {"_own": "kept", "_edited": "edited_kept", "_next": "next_kept"}
    rows = rows.withColumns({k: hashes(v) for k, v in sets.items()})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        rendered("kept").alias("fingerprint"),
        rendered("edited_kept").alias("edited_fingerprint"),
        likeness("_own", "_edited").alias("near_edited"),
        likeness("_own", "_next").alias("near_next"),
    )
