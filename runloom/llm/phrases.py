"""Phrase collocation mining by SON partitioning.

A shard is a stretch of a task's texts of about SHARD_WORDS words.  Each shard is mined
completely, by 64-bit keys of its phrases, at the support times the shard's share of the
language's words, rounded up: a phrase that stays below that in every shard stays below
the support in all.  The union of the locally frequent phrases is a bitmap of BITS bits,
the only thing sent back to the tasks; a longer union only lets more phrases through to
the count.  Then every candidate is counted over all texts by language and phrase text,
so neither keys nor bitmap can change a result.  Phrases of three and four words are
mined after those of one and two, of which all their parts must be candidates.

Where a language's words are so many that every shard's local support is one, local
counts are exact and their sum decides on the candidates.  Shares are known for the LANGS
languages with the most words; shards of others are mined at a local support of one.

Defined results: null texts are empty, a null lang is ``und``, an empty table gives no
rows; repeated rows count as often as they come; texts of any length are read whole; ties
end with the phrase in byte order; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.arrays import LOWER, chunks, mixed, span_hashes, words
from runloom.operators.stage import staged

# Fixed values of the contract.
LENGTHS, SUPPORT, TOP, SCALE, COVER = 4, 30, 2000, 2_000_000, 80
NO_LANG = "und"

SHARD_WORDS = 1 << 17
BITS = 1 << 26
LANGS = 4096

#: lower-cases A-Z and turns what ends a piece into a line feed, which ends a word, too
_PLAIN = LOWER.copy()
_PLAIN[[ord(c) for c in ".,;:!?"]] = 0x0A
_ENDS = np.zeros(256, bool)
_ENDS[0x0A:0x0E] = True
_TURN = np.uint64(0xD6E8FEB86659FD93)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def words_per_lang(texts: DataFrame) -> DataFrame:
    """lang, n: all word occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = {}
        for batch in batches:
            for a, b, flat, offsets in chunks(batch.column(1)):
                per_row = np.diff(words(_PLAIN[flat], offsets)[2])
                for lang, count in zip(batch.column(0)[a:b].to_pylist(), per_row.tolist()):
                    n[lang] = n.get(lang, 0) + count
            if len(n) > LANGS:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], names=["lang", "n"])
                n = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "n"])

    return texts.mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")


class Shard:
    """Words of some stretches of text, in their order."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.langs: list[str] = []
        self.place: dict[str, int] = {}
        self.seeds = np.zeros(0, np.uint64)
        self.n_words = self.n_bytes = 0

    def add(self, langs: Sequence[str], flat: np.ndarray, offsets: np.ndarray) -> None:
        flat = _PLAIN[flat]
        start, end, first = words(flat, offsets)
        code = np.fromiter((self._code(x) for x in langs), np.int32, len(langs))
        per_row = np.diff(first)
        lang = np.repeat(code, per_row)
        ends = np.cumsum(_ENDS[flat], dtype=np.int32)[start]
        joined = np.zeros(len(start), bool)
        joined[:-1] = ends[1:] == ends[:-1]
        last = first[1:][per_row > 0] - 1
        joined[last] = False
        key = mixed(span_hashes(flat, start, end) ^ self.seeds[lang])
        self.parts.append((flat, start + self.n_bytes, end + self.n_bytes, lang, joined, key))
        self.n_words += len(start)
        self.n_bytes += len(flat)

    def _code(self, lang: str) -> int:
        if lang not in self.place:
            self.place[lang] = len(self.langs)
            self.langs.append(lang)
            seed = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")
            self.seeds = np.append(self.seeds, np.uint64(seed))
        return self.place[lang]

    def close(self) -> None:
        self.flat, self.start, self.end, self.lang, self.joined, key = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        self.keys = [key]  # of the phrases of 1, 2, ... words that begin at a word
        self.fits = [np.ones(len(key), bool)]
        for k in range(1, LENGTHS):
            longer, fits = np.zeros(len(key), np.uint64), np.zeros(len(key), bool)
            if len(key) > k:
                longer[:-k] = mixed(self.keys[-1][:-k] * _TURN + key[k:] + np.uint64(k))
                fits[:-k] = self.fits[-1][:-k] & self.joined[k - 1 : -1]
            self.keys.append(longer)
            self.fits.append(fits)

    def phrases(self, k: int, allowed: np.ndarray | None, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, first word, occurrences) of the shard's distinct phrases of ``k`` words
        that the bitmap ``allowed`` holds and whose every two words ``pairs`` holds."""
        fits = self.fits[k - 1].copy()
        if pairs is not None:
            two = held(pairs, self.keys[1])
            for j in range(k - 1):
                fits[: len(fits) - j] &= two[j:]
        if allowed is not None:
            fits &= held(allowed, self.keys[k - 1])
        at = np.flatnonzero(fits)
        key = self.keys[k - 1][at]
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        return key[new], at[order[new]], np.diff(np.r_[new, len(key)])

    def spelled(self, first: np.ndarray, k: int) -> pa.Array:
        """The phrases of ``k`` words from the words ``first`` on, joined by blanks."""
        # words and the gaps between them take turns
        borders = np.empty(2 * len(self.start) + 1, np.int64)
        borders[0:-1:2], borders[1::2], borders[-1] = self.start, self.end, len(self.flat)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(self.flat)])
        each = [parts.take(pa.array(2 * (first + j))) for j in range(k)]
        joined = each[0] if k == 1 else pc.binary_join_element_wise(*each, pa.scalar(b" ", pa.large_binary()))
        return joined.cast(pa.binary()).cast(pa.string())


def held(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    slot = key & np.uint64(BITS - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Shard]:
    shard = Shard()
    for batch in batches:
        for a, b, flat, offsets in chunks(batch.column(1)):
            shard.add(batch.column(0)[a:b].to_pylist(), flat, offsets)
            if shard.n_words >= size:
                shard.close()
                yield shard
                shard = Shard()
    if shard.n_words:
        shard.close()
        yield shard


def locally_frequent(
    texts: DataFrame, lengths: Sequence[int], totals: dict[str, int], support: int = SUPPORT, pairs: np.ndarray | None = None,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """key, n: phrases that are frequent in a shard.  ``n`` is the local count where the
    language's shards all have a local support of one, else ``support``: such a phrase is
    a candidate by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_words):
            share = np.bincount(shard.lang, minlength=len(shard.langs)).tolist()
            least = np.ones(len(shard.langs), np.int64)
            proof = np.ones(len(shard.langs), np.int64)
            for code, lang in enumerate(shard.langs):
                n = totals.get(lang)
                if n is not None and n < support * shard_words:
                    least[code] = max(1, -(-support * share[code] // n))
                    proof[code] = support
            for k in lengths:
                key, first, n = shard.phrases(k, None, pairs)
                lang = shard.lang[first]
                keep = n >= least[lang]
                n = np.maximum(n, proof[lang])[keep]
                yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(n)], names=["key", "n"])

    return texts.mapInArrow(run, "key long, n long")


def bitmap(mined: DataFrame, support: int = SUPPORT) -> np.ndarray:
    """The union of the locally frequent phrases that can reach the support, BITS bits."""
    slot = F.col("key").bitwiseAND(F.lit(BITS - 1))
    rows = (
        mined.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
        .groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(key & 63 as int))")).alias("bits"))
    )
    found, out = rows.toArrow(), np.zeros(BITS >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def counted(texts: DataFrame, allowed: dict[int, np.ndarray], support: int = SUPPORT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase, k, a: the exact counts of all phrases with the support."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_words):
            for k, held_keys in allowed.items():
                _, first, n = shard.phrases(k, held_keys)
                lang = pa.DictionaryArray.from_arrays(pa.array(shard.lang[first]), pa.array(shard.langs, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([lang, shard.spelled(first, k), pa.array(np.full(len(n), k, np.int32)), pa.array(n)], names=["lang", "phrase", "k", "a"])

    rows = texts.mapInArrow(run, "lang string, phrase string, k int, a long")
    return rows.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where(F.col("a") >= support)


def frequent(texts: DataFrame, n: DataFrame, support: int = SUPPORT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase, k, a of all phrases of up to LENGTHS words with the support."""
    totals = {r.lang: r.n for r in n.orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    short = bitmap(locally_frequent(texts, (1, 2), totals, support, None, shard_words), support)
    long = bitmap(locally_frequent(texts, (3, 4), totals, support, short, shard_words), support)
    return counted(texts, {1: short, 2: short, 3: long, 4: long}, support, shard_words)


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of two words and more, by their
    lowest-scoring cut."""
    w, j = F.split("_p", " "), F.col("_j")
    cuts = found.where("k > 1").select("lang", F.col("phrase").alias("_p"), "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("_j"), "k")
    cuts = cuts.select("lang", "_p", "a", "_j", F.array_join(F.slice(w, F.lit(1), j), " ").alias("_left"), F.array_join(F.slice(w, j + 1, F.col("k") - j), " ").alias("_right"))
    one = found.select("lang", F.col("phrase").alias("_left"), F.col("a").alias("l"))
    two = found.select("lang", F.col("phrase").alias("_right"), F.col("a").alias("r"))
    cuts = cuts.join(one, ["lang", "_left"]).join(two, ["lang", "_right"])
    # decimals: the product may pass 64 bits
    score = F.expr(f"cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + r)")
    best = cuts.groupBy("lang", "_p").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "_j", "l", "r")).alias("_c"))
    return best.select("lang", F.col("_p").alias("phrase"), "a", "_c.l", "_c.r", F.col("_c.score").cast("long").alias("score"))


def covered(found: DataFrame) -> DataFrame:
    """lang, phrase, most: the highest count of a phrase one word longer that holds it.
    Still longer ones count no more than those."""
    w, k = F.split("phrase", " "), F.col("k")
    inner = F.array(F.array_join(F.slice(w, F.lit(1), k - 1), " "), F.array_join(F.slice(w, F.lit(2), k - 1), " "))
    return found.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best ``top`` phrases."""
    texts = texts_of(docs)
    n = staged(words_per_lang(texts))
    found = staged(frequent(texts, n, support, shard_words))
    rows = scored(found).join(covered(found), ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < COVER * F.col("a")))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("rank", place).where(F.col("rank") <= top)
    return rows.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""WITH piece AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
grams AS (SELECT lang, k, list_reduce(w[i:i + k - 1], lambda x, y: x || ' ' || y) AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LENGTHS + 1}) ks(k)) q),
f AS (SELECT lang, phrase, CAST(k AS INTEGER) AS k, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {SUPPORT}),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
cuts AS (SELECT lang, phrase, a, j, array_to_string(s[1:j], ' ') AS lp, array_to_string(s[j + 1:], ' ') AS rp
  FROM (SELECT *, string_split(phrase, ' ') AS s, unnest(range(1, k)) AS j FROM f WHERE k > 1) q),
scores AS (SELECT c.lang, c.phrase, c.a, fl.a AS l, fr.a AS r, CAST({SCALE}::HUGEINT * c.a // (fl.a + fr.a) AS BIGINT) AS score, j
  FROM cuts c JOIN f fl ON fl.lang = c.lang AND fl.phrase = c.lp JOIN f fr ON fr.lang = c.lang AND fr.phrase = c.rp),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
holds AS (SELECT b.lang, b.phrase FROM f b JOIN f o ON o.lang = b.lang AND o.k > b.k AND 100 * o.a >= {COVER} * b.a AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') WHERE b.k > 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM holds))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}"""
