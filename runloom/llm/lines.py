"""Line deduplication by a segment-partition edit join.

Two lines within EDITS edits, cut into EDITS + 1 segments, agree on a segment.  Every
distinct line indexes its segments by length and number, and probes the substrings at
which a segment of an equally long or slightly shorter line can lie (positions that
several matches could explain are left out).  Lines that meet at a key are first
sifted by a sketch (parities of character counts, of which an edit changes two at
most), then verified on their texts by a banded bit-parallel edit distance.

Large meetings are verified in pairs of blocks; what leaves a task is a spanning forest.
Linked lines and their copies are a class.  The first line of a class, by document and
line number, stays; later ones are removed.

Lines are what stands between line breaks, without white space at both ends.  Lines
under SHORT characters are left alone: they are common by chance.

Defined results: a null text is an empty one; a document that loses all lines has an
empty text; repeated rows of one doc_id count as its copies and keep what the first
keeps; a row without doc_id has no place in the order: it keeps its lines and takes none
from others; an empty table gives no rows; other columns are kept by ``remove_repeats``,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.arrays import mixed, powers
from runloom.llm.graph import Forest, components, grouped, in_blocks, likely
from runloom.operators.stage import staged

EDITS = 2
SHORT = 24
CHARS_PER_CHUNK = 500_000
KEYS_PER_BUCKET = 2_000_000
BLOCK = 512
SIFTED = 4096
_BLANK = np.zeros(0x110000, bool)
_BLANK[[0x20, *range(0x09, 0x0E), 0xA0]] = True


class Chunk:
    """Lines of a stretch of texts, as spans of one array of code points."""

    def __init__(self, texts: list[str | None]):
        self.joined = "\n".join([*((t or "") for t in texts), ""])
        self.points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.flatnonzero(self.points == 10)
        starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        border = np.cumsum([0, *(len(t or "") + 1 for t in texts[:-1])])
        self.row = np.searchsorted(border, starts, side="right") - 1
        first = np.searchsorted(self.row, np.arange(len(texts)))
        self.number = np.arange(len(starts)) - first[self.row]
        solid = ~_BLANK[self.points]
        at = np.flatnonzero(solid)
        low, high = np.searchsorted(at, starts), np.searchsorted(at, ends)
        some = high > low
        self.start, self.end = starts.copy(), starts.copy()
        if len(at):
            self.start[some] = at[low[some]]
            self.end[some] = at[high[some] - 1] + 1
        up, self.down = powers(len(self.points) + 1)
        self.total = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum((self.points + np.uint64(1)) * up[:-1], dtype=np.uint64, out=self.total[1:])
        self.id = self.hashes(self.start, self.end)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def distinct(self, short: int) -> np.ndarray:
        """The first of equal lines of at least ``short`` characters."""
        long = np.flatnonzero(self.end - self.start >= short)
        return long[np.unique(self.id[long], return_index=True)[1]]

    def sketches(self, at: np.ndarray) -> np.ndarray:
        bit = np.uint64(1) << (mixed(self.points.astype(np.uint64)) % np.uint64(64))
        both = np.stack([self.start[at], self.end[at]], 1).ravel()
        order = np.argsort(self.start[at], kind="stable")
        both = np.stack([self.start[at][order], self.end[at][order]], 1).ravel()
        out = np.empty(len(at), np.uint64)
        if len(at):
            out[order] = np.bitwise_xor.reduceat(np.r_[bit, np.uint64(0)], both)[::2]
        return out


def read_chunks(texts: list[str | None]) -> Iterator[tuple[int, Chunk]]:
    at = 0
    while at < len(texts):
        n = size = 0
        while at + n < len(texts) and (not n or size < CHARS_PER_CHUNK):
            size += len(texts[at + n] or "")
            n += 1
        yield at, Chunk(texts[at : at + n])
        at += n


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i of lines of ``length``; the last ones are longer."""
    short, longer = length // parts, length % parts
    return i * short + np.maximum(0, i - (parts - longer)), short + (i >= parts - longer)


def keys(chunk: Chunk, at: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(position in ``at``, key, indexed): the keys under which lines meet."""
    start, length, parts = chunk.start[at], chunk.end[at] - chunk.start[at], edits + 1
    everyone = np.arange(len(at))

    def key(which, size, i, place, long):
        tag = (size.astype(np.uint64) << np.uint64(8)) + np.uint64(i + 1)
        return mixed(chunk.hashes(start[which] + place, start[which] + place + long) ^ mixed(tag))

    for less in range(edits + 1):
        size = length - less
        for i in range(parts):
            place, long = segment(size, i, parts)
            if not less:
                yield everyone, key(everyone, size, i, place, long), True
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                if less or shift:
                    to = place + shift
                    fits = np.flatnonzero((to >= 0) & (to + long <= length))
                    yield fits, key(fits, size[fits], i, to[fits], long[fits]), False


def within(a: str, b: str, edits: int) -> bool:
    """Is the edit distance ``edits`` at most?  Row e holds, as bits, the diagonals of
    the band on which e edits have sufficed so far."""
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    s = 0
    while s < n and a[s] == b[s]:
        s += 1
    t = 0
    while t < n - s and a[-1 - t] == b[-1 - t]:
        t += 1
    a, b = a[s : len(a) - t], b[s : len(b) - t]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + edits)
    band = (1 << (2 * edits + 1)) - 1
    rows = [((1 << (e + 1)) - 1) << edits & band for e in range(edits + 1)]
    for j, c in enumerate(b):
        match = places.get(c, 0) >> j & band
        before, rows[0] = rows[0], rows[0] & match
        for e in range(1, edits + 1):
            now = rows[e]
            rows[e] = (now & match | before | before >> 1 | rows[e - 1] << 1) & band
            before = now
        if not rows[edits]:
            return False
    return bool(rows[edits] >> (len(a) - len(b) + edits) & 1)


def meetings(docs: DataFrame, edits: int, short: int, buckets: int) -> DataFrame:
    """region, id, indexed, size: lines that meet at a key with a partner alike in sketch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, chunk in read_chunks(batch.column(0).to_pylist()):
                at = chunk.distinct(short)
                ids, sketch = chunk.id[at], chunk.sketches(at)
                found = list(keys(chunk, at, edits))
                who, key = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                indexed = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                who, key, indexed, bucket = who[order], key[order], indexed[order], bucket[order]
                edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() if len(who) else []
                spans = list(zip(edges, [*edges[1:], len(who)]))
                columns = [key, ids[who], sketch[who], indexed.astype(np.uint8)]
                arrays = [pa.array([c[s:e].tobytes() for s, e in spans], pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[s]) for s, _ in spans], pa.int64()), *arrays], names=["bucket", "key", "id", "sketch", "indexed"]
                )

    def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
        read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        key, ids, sketch, indexed = read("key", np.uint64), read("id", np.int64), read("sketch", np.uint64), read("indexed", np.uint8)
        order = np.lexsort((ids, 1 - indexed, key))
        key, ids, sketch, indexed = key[order], ids[order], sketch[order], indexed[order].astype(bool)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids, sketch, indexed = key[new], ids[new], sketch[new], indexed[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[start, len(key)])
        keep = np.zeros(len(key), bool)
        for s, n in zip(start[count > 1].tolist(), count[count > 1].tolist()):
            mine = indexed[s : s + n]
            if not mine.any():
                continue
            if n > SIFTED:
                keep[s : s + n] = True
                continue
            own = np.flatnonzero(mine)
            for k in range(0, len(own), 512):
                part = own[k : k + 512]
                near = np.bitwise_count(sketch[s + part][:, None] ^ sketch[s : s + n][None, :]) <= 2 * edits
                near[np.arange(len(part)), part] = False
                keep[s + part[near.any(1)]] = True
                keep[s : s + n] |= near.any(0)
        number = np.repeat(np.arange(len(start)), count)
        left = np.bincount(number[keep], minlength=len(start))[number[keep]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[keep].view(np.int64)), pa.array(ids[keep]), pa.array(indexed[keep]), pa.array(left)], names=["region", "id", "indexed", "size"]
        )

    packed = docs.select("text").mapInArrow(pack, "bucket long, key binary, id binary, sketch binary, indexed binary")
    return grouped(packed, ["bucket"], meet, "region long, id long, indexed boolean, size long")


def line_texts(docs: DataFrame, wanted: DataFrame, short: int) -> DataFrame:
    """id, line of the wanted ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, chunk in read_chunks(batch.column(0).to_pylist()):
                at = chunk.distinct(short)
                lines = [chunk.joined[s:e] for s, e in zip(chunk.start[at].tolist(), chunk.end[at].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(chunk.id[at].view(np.int64)), pa.array(lines, pa.string())], names=["id", "line"])

    every = docs.select("text").mapInArrow(run, "id long, line string")
    return likely(every, wanted, "id").join(wanted, "id").dropDuplicates(["id"])


def line_classes(docs: DataFrame, edits: int = EDITS, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """id, label of every line that is linked to a different line."""
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = 1 << max(6, math.ceil(math.log2(1 + size / 16 / KEYS_PER_BUCKET)))
    met = staged(meetings(docs, edits, short, buckets))
    texts = staged(line_texts(docs, met.select("id").distinct(), short))

    def verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, lines = table.column("id").to_numpy(), table.column("line").to_pylist()
        indexed = table.column("indexed").to_numpy(zero_copy_only=False)
        mine, lo, hi = table.column("mine").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sketch = np.array([_sketch(x) for x in lines], np.uint64)
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        forest, a, b = Forest(len(ids)), [], []
        if len(left) and len(right):
            near = np.bitwise_count(sketch[left][:, None] ^ sketch[right][None, :]) <= 2 * edits
            near &= indexed[left][:, None] | indexed[right][None, :]
            if lo == hi:
                near &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
            for i, j in zip(*np.nonzero(near)):
                x, y = int(left[i]), int(right[j])
                if forest.root(x) != forest.root(y) and within(lines[x], lines[y], edits):
                    forest.join(x, y)
                    a.append(ids[x])
                    b.append(ids[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = in_blocks(met, "region", "size", block).join(texts, "id")
    edges = grouped(rows.select("region", "lo", "hi", "mine", "indexed", "id", "line"), ["region", "lo", "hi"], verify, "a long, b long")
    return components(edges)


def _sketch(line: str) -> int:
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return int(np.bitwise_xor.reduce(np.uint64(1) << (mixed(points) % np.uint64(64)))) if len(points) else 0


def occurrences(docs: DataFrame, short: int) -> DataFrame:
    """doc_id, number, id of every line that isn't short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, chunk in read_chunks(batch.column(1).to_pylist()):
                long = np.flatnonzero(chunk.end - chunk.start >= short)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(a + chunk.row[long])), pa.array(chunk.number[long]), pa.array(chunk.id[long].view(np.int64))],
                    names=["doc_id", "number", "id"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, number long, id long")


def remove_repeats(docs: DataFrame, edits: int = EDITS, short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """``docs`` with repeated lines removed, and n_lines and n_removed added."""
    named = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    labels = staged(line_classes(named, edits, short, block))
    lines = staged(occurrences(named, short))
    place = F.struct("doc_id", "number")
    per_line = lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    per_line = staged(per_line.join(labels, "id", "left").select("id", "first", "n", F.coalesce("label", "id").alias("label")))
    firsts = per_line.groupBy("label").agg(F.min("first").alias("kept"), F.sum("n").alias("all")).where(F.col("all") > 1)
    repeated = per_line.select("id", "label").join(firsts, "label").select("id", "kept")
    gone = lines.join(repeated, "id").where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("number") != F.col("kept.number")))
    gone = gone.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("number").alias("_gone"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # the rows travel as one column, whatever theirs are named
    rows = docs.select(F.col("doc_id").alias("_of"), F.struct(*[F.col(c) for c in own]).alias("_row")).join(gone, F.col("_of") == F.col("_doc"), "left")
    whole = F.coalesce(F.col("_row.text"), F.lit(""))
    rows = rows.withColumn("_lines", F.split(whole, "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("_lines").cast("long") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), whole).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i.cast("int"))), "\n"))
    return rows.select(
        *[text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in own],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
