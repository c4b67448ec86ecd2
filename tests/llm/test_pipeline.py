import corpus_pipeline
from runloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas(), docs.schema)
        assert set(docs.columns) == set(corpus_pipeline.COLUMNS), name
        counts.append(docs.count())
    assert counts[1] < counts[0] and 0 < counts[3] <= counts[2] <= counts[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "Stone walls stand under green light. " * 20, "en", "a", 1), (3, "Stone walls stand under green light. " * 20, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() >= 0, name
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name


def test_every_operator_is_registered():
    numbers = sorted(int(q.split("_")[0][2:]) for q in QUERIES)
    assert numbers == list(range(1, 14))
