"""The similarity joins against brute force, on odd inputs and on small region sizes."""

import itertools
import random
import re

import numpy as np
import pytest

from runloom.llm import graph, jaccard, lines, vectors

DOCS = "doc_id long, text string"
random.seed(5)
VOCABULARY = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]


def edited(words, share):
    return [random.choice(VOCABULARY) if random.random() < share else w for w in words]


def near_texts():
    out = [None, "", " \t ", "one", "ONE", "one two", "one two three four", "One two\nthree FOUR", "One two three four five"]
    for _ in range(6):
        base = random.choices(VOCABULARY, k=random.choice([6, 20, 90, 300]))
        out += [" ".join(base)] * 3
        out += [" ".join(edited(base, share)) for share in (0.002, 0.005, 0.01, 0.03, 0.08) for _ in range(4)]
    shared = " ".join(random.choices(VOCABULARY, k=60))
    out += [f"{shared} {' '.join(random.choices(VOCABULARY, k=40))}" for _ in range(20)]
    return out


def brute_classes(texts, k, percent):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("k", "percent", "region"), [(4, 85, 512), (5, 80, 4)])
def test_classes_equal_brute_force(spark, k, percent, region):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS + ", component_id string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, k, percent, region).collect()}
    assert got == brute_classes(texts, k, percent)


@pytest.mark.parametrize(("region", "shingles"), [(64, 10**6), (10**6, 3000)])
@pytest.mark.parametrize("hub", [True, False])
def test_large_groups_equal_brute_force(spark, region, shingles, hub):
    """A group around one text, or round no text: many pairs at the very border."""
    rng = random.Random(8)
    fresh = iter(range(10**6))
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)] if hub else []
    for _ in range(300):
        copy = list(base)
        for at in rng.sample(range(3, 117), rng.choice([1, 2, 2, 3, 4])):
            copy[at] = f"x{next(fresh)}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, 4, 85, region, shingles).collect()}
    assert got == brute_classes(texts, 4, 85)


def test_intersections_from_differences():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 90, 60).astype(np.uint64)) for _ in range(12)]
    third = np.unique(rng.integers(0, 120, 70).astype(np.uint64))
    size = np.array([len(s) for s in sets])
    short = [np.setxor1d(s, third) for s in sets]
    got = jaccard._common(short[:5], short, size[:5], size)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:5]]


def test_sketches_of_any_width_bound_the_difference():
    rng = np.random.default_rng(3)
    whole = np.unique(rng.integers(0, 1 << 63, 9000).astype(np.uint64))
    sets = [whole[:n] for n in (0, 3, 900, 1024, 1025, 1150, 4000, 4200, 8100, 8300)] + [whole[4500:8600]]
    offsets = np.cumsum([0] + [len(s) for s in sets])
    found = [np.frombuffer(b, np.uint64) for b in jaccard.sketches(offsets, np.concatenate(sets))]
    assert [len(f) * 64 for f in found] == [1024] * 4 + [2048] * 2 + [4096, 8192, 8192, 16384, 8192]
    for (a, x), (b, y) in itertools.combinations(zip(sets, found), 2):
        width = min(len(x), len(y))
        differ = int(np.bitwise_count(jaccard._folded(x[None], width) ^ jaccard._folded(y[None], width)).sum())
        assert differ <= len(np.setxor1d(a, b))
    # long sets without a shingle in common don't pass for near
    assert 185 * int(np.bitwise_count(found[6][:] ^ jaccard._folded(found[10][None], 64)[0]).sum()) > 15 * (4000 + 4100)


def test_sift_keeps_every_linked_set_across_widths(spark):
    rng = np.random.default_rng(4)
    whole = np.unique(rng.integers(0, 1 << 63, 2600).astype(np.uint64))
    other = np.unique(rng.integers(0, 1 << 63, 2048).astype(np.uint64))
    sets = [whole[:2000], whole[:2200], whole[200:2300], other, whole[:1000], whole[:1100]]
    offsets = np.cumsum([0] + [len(s) for s in sets])
    names = jaccard.sketches(offsets, np.concatenate(sets))
    rows = [(1, i, len(sets), len(s), bytearray(b)) for i, (s, b) in enumerate(zip(sets, names))]
    members = spark.createDataFrame(rows, "region long, id long, size long, n_shingles long, sketch binary")
    for block in (2, 2048):
        found = {r.id for r in jaccard.sift(members, 85, block).collect()}
        assert found == {0, 1, 2, 4, 5}


def test_classes_of_rows_without_ids_and_of_repeated_rows(spark):
    base = " ".join(f"u{i}" for i in range(200))
    near, alone, other = base + " more", "quite another text of a few words", "nobody names this text either way"
    long = " ".join(f"v{i % 5003}" for i in range(60_000))
    rows = [(None, base), (9, near), (None, near), (4, alone), (4, alone), (4, near), (7, alone), (None, other), (None, other + " x"), (None, None), (None, ""), (5, long), (6, long)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS + ", region int, id int, n_shingles int").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()), key=str)
    want = [(None, 197, 4), (9, 198, 4), (None, 198, 4), (4, 4, 4), (4, 4, 4), (4, 198, 4), (7, 4, 4), (None, 3, None), (None, 4, None), (None, 0, None), (None, 0, None), (5, 5003, 5), (6, 5003, 5)]
    assert got == sorted(want, key=str)


def test_classes_of_nothing(spark):
    assert jaccard.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_local_region_equals_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**60, 200).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(200) > cut], rng.integers(0, 2**60, int(200 * cut)).astype(np.uint64)]) for cut in rng.random(60) * 0.3]
    ids = rng.permutation(60).astype(np.int64)
    forest = graph.Forest(60)
    for a, b in jaccard.join_region(ids, sets, 80):
        forest.join(int(a), int(b))
    truth = graph.Forest(60)
    for i, j in itertools.combinations(range(60), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            truth.join(int(ids[i]), int(ids[j]))
    assert [forest.root(i) for i in range(60)] == [truth.root(i) for i in range(60)]


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(300, i) for i in range(301, 340)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 181)} == {100}
    assert {got[i] for i in range(300, 340)} == {300}
    assert {got[i] for i in (500, 501, 502)} == {500}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_equals_plain():
    for _ in range(3000):
        a = "".join(random.choices("abé", k=random.randint(0, 8)))
        b = "".join(random.choices("abé", k=random.randint(0, 8)))
        assert [lines.within(a, b, k) for k in (1, 2, 3)] == [plain_distance(a, b) <= k for k in (1, 2, 3)]


def test_lines_equal_brute_force(spark):
    words = [w for w in VOCABULARY]

    def noisy(line):
        line = list(line)
        for _ in range(random.randint(0, 3)):
            i = random.randrange(len(line))
            line[i : i + 1] = random.choice([[], [line[i], "x"], ["y"]])
        return "".join(line)

    bases = [" ".join(random.choices(words, k=random.randint(5, 12))) for _ in range(25)]
    texts = [None, "", "\n\n", "short line\nshort line"]
    texts += ["\n".join(noisy(random.choice(bases)) + random.choice(["", " ", "\r"]) for _ in range(random.randint(1, 6))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", n_removed int").repartition(4)
    got = {r.doc_id: r for r in lines.remove_repeats(docs, block=8).collect()}
    flat = [(i, n, line.strip(" \t\n\r\v\f\xa0")) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n"))]
    long = [(i, n, s) for i, n, s in flat if len(s) >= lines.SHORT]
    forest = graph.Forest(len(long))
    for x, y in itertools.combinations(range(len(long)), 2):
        if abs(len(long[x][2]) - len(long[y][2])) <= 2 and plain_distance(long[x][2], long[y][2]) <= 2:
            forest.join(x, y)
    gone = {long[x][:2] for x in range(len(long)) if forest.root(x) != x}
    for i, t in enumerate(texts):
        kept = [line for n, line in enumerate((t or "").split("\n")) if (i, n) not in gone]
        assert got[i].text == "\n".join(kept)
        assert got[i].n_removed == sum(g[0] == i for g in gone)


def test_lines_of_nothing(spark):
    assert lines.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_embeddings_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    # noise that puts pairs around the threshold
    v = np.concatenate([c + rng.normal(size=(12, 32)) * 0.05 * rng.random() for c in centres])
    rows = [(i, [float(x) for x in u], 0) for i, u in enumerate(v)]
    n = len(rows)
    odd = [None, [], [0.0] * 32, [float("nan"), *[1.0] * 31], [float("inf"), *[1.0] * 31], [None, *[1.0] * 31], [1.0, 2.0]]
    rows += [(n + i, u, 0) for i, u in enumerate(odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in vectors.near_duplicates(frame, block=64).collect()}
    assert len(got) == len(rows)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = unit @ unit.T >= vectors.COSINE
    np.fill_diagonal(true, False)
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= true.sum(1)).all()
    assert found.sum() >= 0.9 * true.sum()
    assert all(got[n + i].n_links == 0 and got[n + i].component_id == n + i and got[n + i].kept for i in range(len(odd)))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("dims", [32, 64, 200])
def test_embeddings_recall_does_not_fall_with_rows(dims):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4000, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    off = rng.normal(size=v.shape)
    off -= (off * v).sum(1, keepdims=True) * v
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    partner = vectors.COSINE * v + np.sqrt(1 - vectors.COSINE**2) * off  # at the threshold, the hardest pairs
    for rows in (700, 10**6, 10**7, 10**8):
        index = vectors.build(v, rows, vectors.COSINE)
        x = index.codes(v) ^ index.codes(partner)
        found = np.zeros(len(v), bool)
        for t in index.tables:
            found |= ((x[:, t.word] & np.uint64(t.mask)) == 0) & (np.bitwise_count(x[:, t.word]) <= t.far)
        assert found.mean() >= 0.92, (dims, rows, found.mean())
        if rows == 10**8:
            assert min(t.mask.bit_count() for t in index.tables) >= 16  # keys are as long as so many rows need


def test_embeddings_with_the_tables_of_many_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    v = np.concatenate([c + rng.normal(size=(8, 64)) * 0.04 for c in centres])  # cosines about 0.9
    frame = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame, block=64, planned_rows=10**8).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = (unit @ unit.T >= vectors.COSINE).sum(1) - 1
    found = np.array([got[i] for i in range(len(v))])
    assert (found <= true).all()
    assert found.sum() >= 0.9 * true.sum() > 100
