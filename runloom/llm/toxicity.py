"""Toxicity scores on deobfuscated text.

Noisy channel: hidden writing is seen as clean writing sent through leetspeak, spacing
and repetition.  A suspicious span becomes a lattice of characters (a symbol may stand
for a letter, a separator for nothing, a run for one or two letters), and Viterbi
decoding finds its cheapest reading under a trigram model of characters.  The model is
counted over all documents, each task counting its own texts; the alphabet bounds the
table.  The restored words are scored by a logistic model over a lexicon, both learned
from labelled rows.

The fit uses bounded samples of labelled rows (PER_CLASS of each class, the first by a
hash of the id); the character model and the scores cover every row and whole texts.

Defined results: a null text is scored like an empty one; without labels of both
classes every score is the share of toxic labels (0 without labels); an empty table
gives no rows; repeated rows repeat; labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.arrays import mixed, powers

PER_CLASS = 5000
LEXICON = 800
FOLDS, HELD_OUT = 5, 0
TOXIC = 0.5

SYMBOLS = 64
_BORDER, _OTHER = 0, 60
_LETTERS = {chr(97 + i): 1 + i for i in range(26)} | {chr(0xE0 + i): 27 + i for i in range(32)} | {"ß": 59}
_LETTERS.pop("÷", None)
CHARS_PER_CHUNK = 500_000

#: What a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "(": "c",
    "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
_L = r"[^\W\d_]"
SUSPICIOUS = re.compile(
    rf"(?<!\w)(?:[0-9@$!|+€£(]{{1,2}})?{_L}+(?:[0-9@$!|+€£¢(*#%]{{1,3}}{_L}+)+[0-9@$+]{{0,2}}(?!\w)"
    rf"|(?<!\w)[0-9@$!|€£(]{{1,2}}{_L}{{2,}}[0-9@$+]{{0,2}}(?!\w)"
    rf"|(?<!\w){_L}{{2,}}[0-9@$+]{{1,2}}(?![\w@$+])"
    rf"|(?<![^\W_])(?:[^\W_][ .\-_*]{{1,2}}){{2,}}[^\W_](?![^\W_])"
    rf"|(?<!{_L}){_L}*({_L})\1\1{_L}*"  # once per run of letters: no match ends inside one
)
WORD = re.compile(rf"{_L}+")
_SUBSTITUTED, _MASKED, _DROPPED, _JOINED, _SPLIT, _SHORTENED = 0.7, 2.0, 9.0, 0.3, 1.0, 0.5
_SINGLED = 3.0  # a double letter read as a single one


def _symbol_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x2000):
        if chr(c).isalpha():
            out[c] = _LETTERS.get(chr(c), _OTHER)
    out[0x2C00:0xD800] = _OTHER
    return out


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all documents, as a cube of the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _symbol_table(), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            while texts:
                n = size = 0
                while n < len(texts) and size < CHARS_PER_CHUNK:
                    size += len(texts[n])
                    n += 1
                joined = "  ".join(["", *texts[:n], ""]).lower()
                texts = texts[n:]
                s = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    counted = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    cube = np.zeros(SYMBOLS**3)
    for gram, n in counted.collect():  # the alphabet bounds the rows
        cube[gram] = n
    return cube.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def char_costs(cube: np.ndarray) -> np.ndarray:
    """-log P(third | first two), interpolated over orders."""
    three = cube / np.maximum(cube.sum(2, keepdims=True), 1)
    pairs = cube.sum(0)
    two = pairs / np.maximum(pairs.sum(1, keepdims=True), 1)
    one = pairs.sum(0) / max(1.0, pairs.sum())
    return -np.log(0.8 * three + 0.17 * two[None] + 0.02 * one[None, None] + 0.01 / SYMBOLS).astype(np.float32)


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """Readings of every character or run of the span, with their channel costs."""
    out: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", span, re.S):
        c, n = m[1], len(m[0])
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c, _SINGLED if n == 2 else 0.0), (c * 2, 0.0 if n == 2 else _SHORTENED)])
        elif c in LEET:
            cost = _MASKED if len(LEET[c]) > 2 else _SUBSTITUTED
            out += [[*((x, cost) for x in LEET[c]), *((x * 2, cost + _SHORTENED) for x in LEET[c] if n > 1), (" ", _DROPPED), ("", _DROPPED)]]
        else:
            out.append([("", _JOINED), (" ", _SPLIT)])
    return out


def decode(span: str, costs: np.ndarray) -> str:
    """Cheapest reading of a span: Viterbi over pairs of last characters."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(_BORDER, _BORDER): (0.0, None)}
    for options in [*lattice(span), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in best.items():
            for letters, channel in options:
                x, y, total = a, b, cost + channel
                for c in letters:
                    code = _LETTERS.get(c, _OTHER if c.isalpha() else _BORDER)
                    total += float(costs[x, y, code])
                    x, y = y, code
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (letters, path))
        best = after
    path = min(best.values(), key=lambda v: v[0])[1]
    letters = []
    while path:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters)).strip()


def squeezed(word: str) -> str:
    """The word without doubled letters: repetition hides which letters were double."""
    return re.sub(r"(.)\1+", r"\1", word)


@dataclass
class Restorer:
    """Decodes suspicious spans; remembers those it has seen."""

    costs: np.ndarray
    most: int = 100_000
    known: dict[str, str] = field(default_factory=dict)

    def span(self, m: re.Match) -> str:
        s = m[0]
        if s not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            read = decode(s, self.costs)
            short = squeezed(read)
            self.known[s] = read if short == read else f"{read} {short}"
        return self.known[s]

    def __call__(self, text: str | None) -> str:
        return SUSPICIOUS.sub(self.span, (text or "").lower())


@dataclass
class Lines:
    """Lower-case texts of a batch as one array of code points, with a line break after
    each, and what may be hidden writing in them."""

    joined: str
    points: np.ndarray
    letter: np.ndarray
    border: np.ndarray  # first code point of each text

    def rows(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.border, at, side="right") - 1

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of tokens, or of chains of single characters with the tokens
        that they touch, that may hide a word.  Every match of SUSPICIOUS lies in one
        span, and none reaches over a span's border."""
        p = self.points
        code = np.minimum(p, 255).astype(np.uint8)
        code[p > 255] = 0
        leet, last, joint = _IS_LEET[code] | (p == 0x20AC), _IS_LAST[code], _IS_JOINT[code]
        alnum, letter = _alnum()[p], _alnum()[p] & ~_decimal()[p]  # as the expression has them
        solid = ~_IS_SPACE[code]
        start = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
        end = np.flatnonzero(solid & ~np.r_[solid[1:], False]) + 1
        if not len(start):
            return start, end
        after = lambda x, k: np.r_[x[k:], np.zeros(min(k, len(x)), x.dtype)]
        goes_on = alnum | last | (p == 95)
        same = letter & (p == after(p, 1))
        odd = leet & after(letter, 1)
        odd |= letter & after(last, 1) & (~after(goes_on, 2) | (after(last, 2) & ~after(goes_on, 3)))
        odd |= same & after(same, 1)
        token = np.unique(np.searchsorted(start, np.flatnonzero(odd), side="right") - 1)
        single = np.flatnonzero(alnum & ~np.r_[False, alnum[:-1]] & ~after(alnum, 1))
        linked = (np.diff(single) <= 3) & joint[single[:-1] + 1] & joint[single[1:] - 1]
        head = np.flatnonzero(linked & ~np.r_[False, linked[:-1]])
        tail = np.flatnonzero(linked & ~np.r_[linked[1:], False]) + 1
        long = tail - head >= 2
        first = np.r_[token, np.searchsorted(start, single[head[long]], side="right") - 1]
        final = np.r_[token, np.searchsorted(start, single[tail[long]], side="right") - 1]
        if not len(first):
            return first, final
        order = np.argsort(first, kind="stable")
        first, final = first[order], np.maximum.accumulate(final[order])
        new = np.flatnonzero(np.r_[True, first[1:] > final[:-1]])
        return start[first[new]], end[final[np.r_[new[1:] - 1, len(final) - 1]]]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(self.letter & ~np.r_[False, self.letter[:-1]])
        end = np.flatnonzero(self.letter & ~np.r_[self.letter[1:], False]) + 1
        return start, end


def _byte_set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_IS_LEET = _byte_set("".join(c for c in LEET if ord(c) < 256))
_IS_LAST = _byte_set("0123456789@$+")
_IS_JOINT = _byte_set(" .-_*")
_IS_SPACE = _byte_set(" \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    every = np.zeros(0x110000, bool)
    every[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return every


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


@lru_cache(maxsize=1)
def _decimal() -> np.ndarray:
    return np.array([chr(c).isdecimal() for c in range(0x110000)])


def read_lines(texts: list[str | None]) -> Iterator[tuple[int, int, Lines]]:
    """Stretches of whole texts of about CHARS_PER_CHUNK characters."""
    at = 0
    while at < len(texts):
        n = size = 0
        part = []
        while at + n < len(texts) and (not n or size < CHARS_PER_CHUNK):
            part.append((texts[at + n] or "").lower())
            size += len(part[-1])
            n += 1
        joined = "\n".join([*part, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        border = np.cumsum([0, *(len(t) + 1 for t in part[:-1])])
        yield at, at + n, Lines(joined, points, _letters()[points], border)
        at += n


def hidden_words(lines: Lines, restore: Restorer) -> Iterator[tuple[int, str]]:
    """(row of the stretch, word) for the words read out of suspicious spans."""
    start, end = lines.spans()
    for row, s, e in zip(lines.rows(start).tolist(), start.tolist(), end.tolist()):
        found = lines.joined[s:e]
        read = restore(found)
        if read != found:
            for word in WORD.findall(read):
                yield row, word


def word_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * up[:-1], dtype=np.uint64, out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def one_hash(word: str) -> int:
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    return int(word_hashes(points, np.array([0]), np.array([len(points)]))[0])


@dataclass
class Model:
    bias: float
    weights: dict[str, float]

    def scores(self, texts: list[str | None], restore: Restorer) -> np.ndarray:
        """A text's lexicon words count once each, written openly or hidden."""
        lexicon = list(self.weights)
        keys = np.array([one_hash(w) for w in lexicon], np.uint64)
        order = np.argsort(keys)
        keys, weight = keys[order], np.array([self.weights[w] for w in lexicon])[order]
        place = {lexicon[i]: k for k, i in enumerate(order.tolist())}
        z = np.full(len(texts), self.bias)
        for a, b, lines in read_lines(texts) if lexicon else ():
            start, end = lines.words()
            h = word_hashes(lines.points, start, end)
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            used = [lines.rows(start[hit]) * len(keys) + k[hit]]
            hidden = [row * len(keys) + place[w] for row, w in hidden_words(lines, restore) if w in place]
            used = np.unique(np.concatenate([*used, np.array(hidden, np.int64)]))
            np.add.at(z, a + used // len(keys), weight[used % len(keys)])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_sets(texts: list[str | None], restore: Restorer) -> list[list[str]]:
    """Distinct restored words of each text."""
    out = [set(WORD.findall((t or "").lower())) for t in texts]
    for a, _, lines in read_lines(texts):
        for row, word in hidden_words(lines, restore):
            out[a + row].add(word)
    return [sorted(w) for w in out]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with an L2 penalty, by Adam on the whole sample."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        r = (p - y) * weight
        g = np.append(r @ x + ridge * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, costs: np.ndarray, per_class: int = PER_CLASS, lexicon: int = LEXICON) -> Model:
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.where((fold != HELD_OUT) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    order = F.xxhash64("doc_id", F.lit(3))
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(per_class)
    ids = ids.unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(costs)
        for batch in batches:
            words = word_sets(batch.column(0).to_pylist(), restore)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), batch.column(1)], names=["words", "toxic"])

    # the list of ids is bounded by its limits, so a broadcast is safe
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic").mapInArrow(run, "words array<string>, toxic int")
    sample = sample.select(F.monotonically_increasing_id().alias("row"), "words", "toxic").persist()
    n1, n0 = (sample.where(F.col("toxic") == k).count() for k in (1, 0))
    if not n1 or not n0:
        sample.unpersist()
        p = min(1 - 1e-6, max(1e-6, float(share or 0.0)))
        return Model(math.log(p / (1 - p)), {})
    in_toxic = F.sum("toxic").alias("in_toxic")
    words = sample.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(in_toxic, F.count("*").alias("n"))
    gain = F.log((F.col("in_toxic") + 0.5) / (n1 + 1) / ((F.col("n") - F.col("in_toxic") + 0.5) / (n0 + 1)))
    top = words.where(F.col("in_toxic") >= max(2, n1 // 400)).withColumn("gain", gain * F.col("in_toxic")).where(gain > 1)
    chosen = [r.word for r in top.orderBy(F.desc("gain"), "word").limit(lexicon).select("word").collect()]
    at = {w: i for i, w in enumerate(chosen)}
    listed = F.array(*map(F.lit, chosen)) if chosen else F.expr("cast(array() AS array<string>)")
    rows = sample.select(F.array_intersect("words", listed).alias("words"), "toxic").collect()  # the sample is bounded
    sample.unpersist()
    x, y = np.zeros((len(rows), len(chosen)), np.float32), np.array([r.toxic for r in rows], float)
    for i, r in enumerate(rows):
        x[i, [at[w] for w in r.words]] = 1
    w, b = fit_logistic(x, y, np.where(y == 1, 0.5 / n1, 0.5 / n0))
    weights = {c: float(v) for c, v in zip(chosen, w) if v > 0}
    return Model(b, {squeezed(c): v for c, v in weights.items()} | weights)


def score(docs: DataFrame, model: Model, costs: np.ndarray) -> DataFrame:
    """``docs`` with toxicity, every row by its whole restored text."""
    names = [c for c in docs.columns if c != "toxicity"]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(costs)
        for batch in batches:
            s = model.scores(batch.column(at).to_pylist(), restore)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*names, "toxicity"])

    return docs.select(*names).mapInArrow(run, docs.select(*names).schema.add("toxicity", "double"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    costs = char_costs(trigram_counts(docs))
    scored = score(docs.select("doc_id", "text"), train(docs, labels, costs), costs)
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC).cast("int").alias("predicted"),
    )
