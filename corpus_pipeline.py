"""Training corpus from ``documents``: quality, line dedup, near duplicates, mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
all but the last return the columns of ``documents``.

1. quality: documents that the classifier rejects go.
2. line_dedup: of lines that repeat (up to two edits) the first stays; a document that
   loses all its lines goes, since earlier documents hold them.
3. near_duplicates: of each class at Jaccard 0.8 on five words the smallest doc_id stays.
4. mix: documents come as often as the mix takes them, rounded to whole documents.
5. pack: pieces of token sequences.

Null texts count as empty in every stage; empty tables pass through; other columns are
dropped in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import jaccard, lines, mixing, packing, quality
from runloom.llm.tables import table
from runloom.operators.stage import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORDS, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("quality_score") >= quality.ACCEPT).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = lines.remove_repeats(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    return done.where(~emptied).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.classes(docs, WORDS, PERCENT)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept, "doc_id").dropDuplicates(["doc_id"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(docs).withColumn("uses", F.round(F.try_divide("taken", "size")).cast("int")).where("uses > 0")
    taken = taken.groupBy("doc_id").agg(F.max("uses").alias("uses"))
    return docs.join(taken, "doc_id").withColumn("_use", F.explode(F.sequence(F.lit(1), F.col("uses")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: A fitted classifier decides in the first stage, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
