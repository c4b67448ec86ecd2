"""Packing, mixing, fingerprints, URL rules, wrappers and the two classifiers."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runloom.llm import mixing, packing, quality, toxicity, urls, winnow, wrappers
from runloom.llm.tokens import public_encoder

DOCS = "doc_id long, text string, source string"
TEXTS = [None, "", " ", "a", "it's  <|endoftext|> we'll\n\n go", "ça été 123 000\t\t$$ x", "word " * 3000, "word " * 3000, "\n \n", "αβγ—x’s\u2028 y\x85z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 4 == 3 else f"s{i % 4}") for i, t in enumerate(TEXTS * 6)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in TEXTS] + ["x  y", "  lead", "trail  ", "a\n\nb \n c", "I'LL i'll '' 's", "١٢٣ ½ x²", "日本語 テスト", "\u00a0\u00a0x"]
    got = list(public_encoder().encode(texts))
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_over_many_stretches_and_resets(monkeypatch):
    """Small stretches and a small cache: words are kept, added and forgotten."""
    import random

    from runloom.llm import tokens

    monkeypatch.setattr(tokens, "CHARS_PER_CHUNK", 300)
    monkeypatch.setattr(tokens, "CACHED_WORDS", 90)
    rng = random.Random(3)
    texts = [" ".join(f"wö{rng.randint(0, 150)}x" for _ in range(rng.randint(0, 40))) for _ in range(200)]
    encoder = public_encoder()
    got = list(encoder.encode(texts))
    assert [g.tolist() for g in got] == [encoder._whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_takes_about_the_least_sequences(spark):
    """No more than 1 % over the lower bound on one partition, and no more than a plain
    best fit over all pieces plus the bins it keeps open."""
    import random

    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.choice([3, 40, 200, 500, 700, 900, 1400])), "s") for i in range(1500)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    least = -(-sum(r.length for r in got) // packing.SEQUENCE)
    used = len({r.sequence_id for r in got})
    free = []  # plain best fit, the longest first
    for r in sorted((r for r in got), key=lambda r: -r.length):
        fits = [i for i, f in enumerate(free) if f >= r.length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= r.length
        else:
            free.append(packing.SEQUENCE - r.length)
    assert least <= used <= max(1.01 * least, len(free))


def test_packing_of_nothing_and_of_repeats(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    twice = spark.createDataFrame([(7, "one two", "a"), (7, "one two", "a")], DOCS)
    rows = packing.pack(twice.withColumns({"piece": F.lit("x"), "offset": F.lit(1)})).collect()
    assert len(rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == 2


def test_packing_is_gapless_and_tight(docs):
    rows = packing.pack(docs).collect()
    by_doc = Counter(r.doc_id for r in rows)
    assert set(by_doc) == set(range(len(TEXTS) * 6))
    encoder = public_encoder()
    for i, text in enumerate(TEXTS):
        ids = np.append(next(iter(encoder.encode([text or ""]))), packing.END_ID).astype("<u4")
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(p.length for p in pieces) == len(ids)
        assert all(p.length == packing.SEQUENCE for p in pieces[1:])
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE


def test_best_fit_closes_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.add(n) for n in (6, 7, 3, 9, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    bins = packing.OpenBins(10, 2)
    for n in (6, 7, 8):
        bins.add(n)
    assert sorted(bins.bins) == [2, 4]


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i % 50), ["b", "a", None, "é", "z"][min(4, i % 9)]) for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, block_words=64).collect()
    again = mixing.mix(docs.repartition(7), block_words=64).collect()
    assert sorted(got) == sorted(again)
    source = {i: s for i, _, s in rows}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    weights = dict(zip(["a", "b", "z", "é", None], [3.0, 1.0, 2.0, 3.0, 1.0]))
    total, open_, want = 1.5 * sum(size.values()), set(weights), {}
    while True:
        level = (total - sum(want.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 2 * size[s]}
        if not full:
            break
        want |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    want |= {s: level * weights[s] for s in open_}
    for s in weights:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 1


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([(0, 600.0), (1, 300.0), (2, 100.0)], "src long, target double")
    slots = mixing.schedule(spark, targets, 1).toPandas().sort_values("slot")
    assert slots.groupby("src").size().tolist() == [600, 300, 100]
    for src in (0, 1, 2):
        assert sorted(slots[slots.src == src].block) == list(range(len(slots[slots.src == src])))
    head = slots.head(100).groupby("src").size()
    assert abs(head[0] - 60) <= 4 and abs(head[2] - 10) <= 4


def brute_winnow(text, k=4, w=8):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return words, max(0, len(words) - k + 1) or min(1, len(words)), w


def test_fingerprints(spark, docs):
    unique = docs.where(F.col("doc_id") < len(TEXTS))
    rows = {r.doc_id: r for r in winnow.fingerprints(unique).collect()}
    n = len(TEXTS)
    for i in range(n):
        text, after = TEXTS[i] or "", TEXTS[(i - 1) % n] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].n_chars == len(text)
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[6].fingerprint == rows[7].fingerprint != ""
    assert rows[7].near_next == 1.0
    assert rows[0].fingerprint == rows[1].fingerprint == ""


def test_winnowing_keeps_rightmost_minima_and_finds_shared_runs(spark):
    rng = np.random.default_rng(4)
    words = [f"x{i}" for i in range(50)]
    shared = " ".join(rng.choice(words, 11))
    texts = [" ".join(rng.choice(words, 40)) + " " + shared + " " + " ".join(rng.choice(words, 30)) for _ in range(6)] + ["same " * 30]
    frame = winnow.with_winnowed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", "kept")
    frame = winnow.with_winnowed(frame, "text", "all", windows=0)
    rows = frame.withColumn("own", winnow.hashes("kept")).orderBy("doc_id").collect()
    for r in rows:
        every = [(x >> 31, (1 << 31) - 1 - (x & ((1 << 31) - 1))) for x in r["all"]]
        want = []
        for s in range(max(1, len(every) - 7)):
            best = min(every[s : s + 8], key=lambda p: (p[0], -p[1]))
            if best not in want:
                want.append(best)
        assert [(x >> 31, (1 << 31) - 1 - (x & ((1 << 31) - 1))) for x in r.kept] == want
    assert all(set(rows[0].own) & set(rows[i].own) for i in range(1, 6))


def test_next_rows_over_cells(spark, monkeypatch):
    monkeypatch.setattr(winnow, "ROWS_PER_CELL", 3)
    ids = [1, 2, 3, 50, 51, 1000, 1001, 1002, 5000, 10**12, -7]
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in winnow.with_next(frame, ["text"]).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(down, down[1:] + down[:1])}


URLS = [
    None, "", "no scheme", "http://", "https://example.org/es/x", "https://A.Example.ORG/es/", "http://xexample.org/es/", "http://example.org/en/12?q#f",
    "http://example.org", "http://example.org?x=/es/", "http://www.shop.com/de/a#b", "http://com/fr/", "http://.com/fr/x", "http://net/fr/", "x://h.org:80/a", "http://h.org./a",
]


def test_url_rules_equal_brute_force(spark):
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in urls.judge(frame, urls.rule_table(spark)).collect()}
    for i, url in enumerate(URLS + URLS):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        want = (host, path, best and best[0] + best[1], best[2] if best else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want
    assert urls.judge(frame, urls.rule_table(spark).limit(0)).where("verdict = 'allow'").count() == len(URLS) * 2


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav>"
    "<div class='cookie-notice'>We bake</div>{main}<aside>Side</aside><script>var t='</p><p>no';</script><footer>&copy; {i}</footer>"
)


def test_wrappers_find_the_article(spark):
    article = "<article><h1>Head &amp; {i}</h1><p><b>First <i>li</i>ne<br>goes on<p>Second  &lt;x&gt;\n{i}<div class='comments'><p>Reader says</p></div><form>Name</form></article>"
    plain = "<div class=content><p>Long story number {i} with many words in it<p>and <a href=/x>more</a> of it {i}</div><div class=links><a href=/y>All the other stories of this site {i}</a></div>"
    rows = []
    for i in range(12):
        rows.append((i, f"http://a.example/{i}", PAGE.replace("{main}", article).replace("{i}", str(i)), "k"))
        rows.append((100 + i, f"http://b.example/{i}", PAGE.replace("{main}", plain).replace("{i}", str(i)), "k"))
    rows += [(200, None, None, "k"), (201, "http://a.example/x", "", "k"), (202, "http://c.example", "<article><p>broken < 3 <!-- open", "k")]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(4)).collect()}
    for i in range(12):
        assert got[i].text == f"Head & {i}\nFirst line goes on\nSecond <x> {i}"
        assert got[100 + i].text == f"Long story number {i} with many words in it\nand more of it {i}"
        assert got[i].n_chars == len(got[i].text)
    assert got[200].text == got[201].text == "" and got[202].text == "broken < 3"


def extracted(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_an_article_element_is_no_veto_on_other_pages(spark):
    rows = [(i, None, f"<article><h1>T{i}</h1><p>Story {i} goes on<p>and ends {i}</p><h6>All rights stay here</h6></article>") for i in range(4)]
    rows += [(10 + i, None, f"<div class=content><p>Other page {i}<p>goes on {i}</div>") for i in range(4)]
    got = extracted(spark, rows)
    for i in range(4):
        assert got[i] == f"T{i}\nStory {i} goes on\nand ends {i}"  # the template's line is gone
        assert got[10 + i] == f"Other page {i}\ngoes on {i}"


def test_templates_and_copies_of_a_host(spark):
    rows = [(i, "http://t.example/a", f"<div class=content><h1>Long {i}</h1><p>A much longer story number {i}</div>") for i in range(6)]
    rows += [(10 + i, "http://t.example/b", f"<div class=entry><p>Short {i}</div>") for i in range(3)]
    rows += [(20 + i, "http://copy.example/c", "<div class=content><h1>Title</h1><p>Only one paragraph</div>") for i in range(5)]
    rows += [(30 + i, "http://d.example/c", f"<div class=content><h1>Title</h1><p>Only one paragraph</p><h6>{i}</h6></div>") for i in range(5)]
    rows += [(40, "http://e.example/c", "<div class=content><p>Intro<blockquote><p>A quotation longer than all the rest</blockquote></div><div class=content2><p>no</div>")]
    got = extracted(spark, rows)
    assert [got[i] for i in range(6)] == [f"Long {i}\nA much longer story number {i}" for i in range(6)]
    assert [got[10 + i] for i in range(3)] == [f"Short {i}" for i in range(3)]
    assert all(got[20 + i] == "Title\nOnly one paragraph" for i in range(5))
    assert all(got[30 + i] == f"Title\nOnly one paragraph\n{i}" for i in range(5))
    assert got[40].startswith("Intro\nA quotation")


def test_alignment_makes_slots_options_and_repeats():
    one = wrappers.stream(wrappers.blocks("<h1>A</h1><p>x</p><footer>same</footer>"))
    two = wrappers.stream(wrappers.blocks("<h1>B</h1><p>x</p><p>y</p><aside>ad</aside><footer>same</footer>"))
    merged = {g["key"]: g for g in wrappers.align(one, two)}
    assert merged["h1"]["const"] is None and not merged["h1"]["opt"]
    assert merged["p"]["rep"] and merged["aside"]["opt"] and merged["footer"]["const"] == "same"


def test_hidden_words_are_read():
    rng = np.random.default_rng(0)
    text = " ".join(["you are such an idiot and a stupid loser said the clown in the trash", "the dot on the list is here and there it goes again"] * 50)
    table = toxicity._symbol_table()
    s = table[np.frombuffer(f"  {text}  ".encode("utf-32-le"), np.uint32)].astype(int)
    cube = np.bincount((s[:-2] * 64 + s[1:-1]) * 64 + s[2:], minlength=64**3).reshape(64, 64, 64).astype(float)
    restore = toxicity.Restorer(toxicity.char_costs(cube))
    model = toxicity.Model(-2.0, {w: 6.0 for w in ("idiot", "stupid", "loser", "clown", "trash")})
    for hidden in ("1d10t", "i d i o t", "I.D.I.O.T", "stuuupid", "$tup1d", "l-o-s-e-r", "cl0wn", "tr@sh", "idi07", "st*pid"):
        assert model.scores([f"here is {hidden} again"], restore)[0] > 0.9, hidden
    clean = ["the dot is here", None, "", "50% of 1000 lists, e.g. a.b.c. on 3rd May", "x" * 5000]
    assert (model.scores(clean, restore) < 0.5).all()
    assert rng is not None


def test_every_suspicious_match_lies_in_a_span():
    rng = np.random.default_rng(12)
    signs = list("aabbcdeilost1035$@!|+(*#%_.-  ,;)\n\xa0") + ["é", "²", "€", "٣", "日", "--", ". ", "- ", "ooo"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 40)))) for _ in range(4000)]
    texts += ["a loser5, said", "an idiot$.", "(l0ser)", "i--d--i--o--t", "i. d. i. o. t", "so i- d- i- o- t!", "x", "", None, "a_b_c", "1 2 3"]
    seen = 0
    for a, _, lines in toxicity.read_lines(texts):
        start, end = lines.spans()
        assert (start[1:] >= end[:-1]).all()
        spans = list(zip(start.tolist(), end.tolist()))
        want = [(m.start(), m[0]) for m in toxicity.SUSPICIOUS.finditer(lines.joined)]
        got = [(s + m.start(), m[0]) for s, e in spans for m in toxicity.SUSPICIOUS.finditer(lines.joined[s:e])]
        assert got == want
        seen += len(want)
    assert seen > 2000


def test_hidden_words_before_punctuation_and_with_wide_joints():
    text = "you are such an idiot and many losers here say that " * 50
    s = toxicity._symbol_table()[np.frombuffer(f"  {text}  ".encode("utf-32-le"), np.uint32)].astype(int)
    cube = np.bincount((s[:-2] * 64 + s[1:-1]) * 64 + s[2:], minlength=64**3).reshape(64, 64, 64).astype(float)
    model = toxicity.Model(-2.0, {w: 6.0 for w in ("idiot", "losers")})
    restore = toxicity.Restorer(toxicity.char_costs(cube))
    for hidden in ("loser5,", "loser$.", "i--d--i--o--t", "i. d. i. o. t", "i- d- i- o- t"):
        assert model.scores([f"here is {hidden} again"], restore)[0] > 0.9, hidden


def labelled(spark, make, column):
    rows = [(i, make(i), "s") for i in range(400)]
    labels = [(i, int(i % 3 == 0)) for i in range(400)]
    return spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, f"doc_id long, {column} int")


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(8)
    words = ["stone", "river", "house", "green", "walks", "under", "light", "seven"]

    def make(i):
        text = rng.choice(words, 30).tolist()
        if i % 3 == 0:
            text[int(rng.integers(30))] = ["grubbit", "gr0bbit".replace("0", "u"), "g r u b b i t", "grubb1t"][i % 4]
        return " ".join(text)

    docs, labels = labelled(spark, make, "toxic")
    got = {r.doc_id: r for r in toxicity.judged(docs, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in held]) > 0.9
    none = toxicity.judged(docs.limit(5), labels.limit(0)).collect()
    assert len(none) == 5 and all(0 <= r.score < 0.5 for r in none)
    assert toxicity.judged(docs.limit(0), labels).count() == 0


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(9)
    words = ["stone", "river", "house", "green", "walks", "under", "light", "seven"]

    def make(i):
        text = rng.choice(words, int(rng.integers(8, 60))).tolist()
        return " ".join(text) if i % 3 == 0 else " ".join(w.upper() + "!!" if i % 3 == 1 else w + "###" for w in text)

    docs, labels = labelled(spark, make, "quality")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in held]) > 0.95
    odd = spark.createDataFrame([(1, None, "s"), (1, "", "s"), (2, "x" * 100_000, None)], DOCS)
    assert quality.judged(odd, labels.limit(0)).where("score between 0 and 1").count() == 3
    assert quality.judged(odd.limit(0), labels).count() == 0


def test_risk_is_never_negative():
    x = quality.features(pa.array([None, "", "ab", "A B!!", "a b " * 100]))
    assert x.shape[0] == 5 and np.isfinite(x).all()
    model = quality.fit_nnpu(x[:2], x, 0.9, hidden=4, epochs=5)
    assert np.isfinite(model.score(x)).all()
