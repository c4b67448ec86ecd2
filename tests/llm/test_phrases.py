"""Collocations against a plain recount of small texts."""

import random
import re
from collections import Counter

import pytest

from runloom.llm import phrases

DOCS = "doc_id long, text string, lang string"


def brute(rows, support, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    f = {p: a for p, a in f.items() if a >= support}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        inside = [
            b for (other, q), b in f.items()
            if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a
        ]
        if inside:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    }


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "été", "A", "b", "10", "—", "x"]
    rows = [(None, "en"), ("", "en"), (" \t ", None), ("one", "fr"), (".,;", "fr")]
    for _ in range(120):
        words = rng.choices(vocabulary, weights=range(10, 0, -1), k=rng.randint(1, 60))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ? "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    rows += [("New York New York new york", "fr")] * 9  # repeated rows count each time
    rows.append(("the of " * 3000, "de"))  # a long text
    return rows


@pytest.mark.parametrize(("support", "top", "shard_words"), [(30, 2000, 200), (7, 5, 50), (4, 2000, 1 << 18)])
def test_collocations_equal_brute_force(spark, support, top, shard_words):
    rows = texts(support)
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], DOCS + ", phrase string, k int").repartition(5)
    got = phrases.collocations(docs, support, top, shard_words).collect()
    want = brute(rows, support, top)
    assert len(got) == len(want)
    assert {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == want


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], DOCS)).count() == 0


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    """A bitmap that lets everything through costs counts, not results."""
    rows = texts(3)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    monkeypatch.setattr(phrases, "bitmap", lambda mined, support: phrases.np.full(phrases.BITS >> 6, ~phrases.np.uint64(0)))
    got = phrases.collocations(docs, 6, 50, 100).collect()
    assert {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == brute(rows, 6, 50)


def test_local_support_follows_the_share(spark):
    """Whatever is frequent in all texts is a candidate; a phrase below its share in
    every shard is not."""
    rows = [("a b", "en")] * 40 + [("c d", "en")] * 4 + [("e f", "en")] * 400
    random.Random(1).shuffle(rows)
    frame = phrases.texts_of(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).coalesce(1))
    mined = phrases.locally_frequent(frame, (2,), {"en": 2 * len(rows)}, 30, None, 400)
    keys = {r.key for r in mined.collect()}
    assert len(keys) == 2
    assert phrases.counted(frame, {2: phrases.bitmap(mined, 30)}, 30, 400).count() == 2
