"""Null and extreme ids, repeated rows, empty tables and clashing names, operator by
operator, and lists without a bound."""

import random
import time

import pytest
from pyspark.sql import functions as F

from runloom.llm import lines, mixing, toxicity, urls, winnow

ENDS = (-(2**63), 2**63 - 1)


def test_next_rows_with_ids_at_both_ends_of_long(spark, monkeypatch):
    monkeypatch.setattr(winnow, "ROWS_PER_CELL", 4)
    ids = [*ENDS, -(2**63) + 1, 2**63 - 2, -1, 0, 1, 2**62, -(2**62), 5, 6, 7, 8]
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "n1"), (None, "n2")], "doc_id long, text string")
    got = {r.text: r.next_text for r in winnow.with_next(frame, ["text"]).collect()}
    down = [f"t{i}" for i in sorted(ids, reverse=True)] + ["n1", "n2"]  # null ids last, by text
    assert got == dict(zip(down, down[1:] + down[:1]))


@pytest.mark.parametrize("rows", [[(None, "a b c")], [(3, "x")], [(3, "x"), (3, "y")], [(None, None), (None, None)], []])
def test_fingerprints_of_few_rows(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, kept int, _cell int")
    got = winnow.fingerprints(frame.select("doc_id", "text", "kept", "_cell")).collect()
    assert len(got) == len(rows) and all(r.edited_sha256 and r.near_next is not None for r in got)


def test_line_dedup_of_odd_rows(spark):
    shared = "this line stands in every one of the documents"
    rows = [(1, f"{shared}\nfirst"), (None, f"{shared}\nnobody's"), (2, f"second\n{shared}"), (None, f"{shared}\nnobody's"), (ENDS[0], "other"), (2**53 + 1, shared), (2**53 + 3, None)]
    frame = spark.createDataFrame([(*r, "kept", 7) for r in rows], "doc_id long, text string, _gone string, _lines int").repartition(3)
    got = lines.remove_repeats(frame).collect()
    texts = {(r.doc_id, r.text) for r in got}
    assert texts == {(1, f"{shared}\nfirst"), (None, f"{shared}\nnobody's"), (2, "second"), (ENDS[0], "other"), (2**53 + 1, ""), (2**53 + 3, "")}
    assert len(got) == len(rows) and {(r._gone, r._lines) for r in got} == {("kept", 7)}
    assert {r.doc_id: r.n_removed for r in got}[2**53 + 1] == 1


def test_line_dedup_of_a_document_with_very_many_lines(spark):
    long = "\n".join(f"a line of a long document, number {i % 500} of five hundred" for i in range(20_000))
    got = lines.remove_repeats(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    # numbers within two edits of each other are one class, so few lines stay
    assert got.n_lines == 20_000 and got.n_removed + len(got.text.split("\n")) == 20_000 and got.n_removed >= 19_500


def test_mix_of_rows_without_ids(spark):
    rng = random.Random(2)
    rows = [(None if i % 3 == 0 else i, "w " * rng.randint(0, 40), rng.choice(["a", "b", None])) for i in range(300)]
    rows += [(5, "x y z", "a")] * 4
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, start int").repartition(4)
    got = mixing.mix(frame, block_words=32).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r["size"] for r in got)
    per = {}
    for r in got:
        per.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(sum(taken) == round(target) for (_, target), taken in per.items())
    assert mixing.mix(frame.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "", "a"), (None, None, None)], "doc_id long, text string, source string")).collect()] == [0, 0]


def test_rules_of_a_thousand_path_lengths(spark):
    rules = [("h.org", "/" + "a" * n, "block" if n % 2 else "allow") for n in range(1000)]
    pages = [(n, f"http://www.h.org/{'a' * n}b", "x") for n in (0, 1, 7, 500, 999, 1500)] + [(9999, "http://h.org/" + "a" * 100_000, "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, key string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(frame, urls.rule_table(spark, rules)).collect()}
    for n, *_ in pages:
        k = min(n, 999)
        assert got[n] == ("h.org/" + "a" * k, "block" if k % 2 else "allow")
    assert urls.judge(frame.limit(0), urls.rule_table(spark)).count() == 0


def test_mix_is_the_same_however_rows_lie(spark):
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"), (F.col("id") % 4).cast("string").alias("source"))
    a, b = (sorted(mixing.mix(frame.repartition(n), block_words=64).collect()) for n in (1, 7))
    assert a == b


def test_long_runs_of_letters_are_sifted_once():
    run = "abcdefghij" * 20_000
    for text, hidden in ((f"{run} b4d", ["b4d"]), (f"{run}_1 b4d", ["b4d"]), (f"{run}zzz", [f"{run}zzz"]), ("a" * 200_000, ["a" * 200_000])):
        begun = time.monotonic()
        assert [m[0] for m in toxicity.SUSPICIOUS.finditer(text)] == hidden
        assert time.monotonic() - begun < 10
    assert [m[0] for m in toxicity.SUSPICIOUS.finditer("_booo 1soo0 sooo_x fffa-bbb 3zzz")] == ["booo", "1soo0", "sooo", "fffa", "bbb", "3zzz"]
