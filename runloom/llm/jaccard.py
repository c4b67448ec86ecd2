"""Exact Jaccard join of documents by pivots in the metric space of shingle sets.

Jaccard distance d = 1 - similarity is a metric.  With r = 1 - threshold:

1. Cells.  A document's shingles are dealt into segments by hash.  Two sets within r
   differ in fewer shingles than there are non-empty segments, so they agree on a whole
   segment.  A cell is one segment's content; linked documents share a cell.
2. Pivots and regions.  The first document of a cell (by set id, a hash) is its pivot.
   The documents that measure a pivot form its region; a document lies in the regions
   of all its cells' pivots, so linked documents share a region.
   Regions with common members are merged, so that a set travels once.
3. Small regions are joined in one task: documents within r of the pivot are one
   component; by the triangle inequality another document can only link to those whose
   distance to the pivot differs from its own by r at most, and only these are compared.
4. Large regions (by sets or by shingles) measure some of their members as new pivots:
   those with the most likely partners, and some by hash.  Links with a pivot are found
   there, and pivots are done.  The others fall into the pivots' Voronoi regions; a
   document also enters the region of each pivot q with d(x, q) <= d(x, nearest) + 2 r:
   the window that a partner of its can be in.  Only those go on that can link to one
   not yet known to be in their component: some such document's distance to q differs
   from theirs by r at most.  Around a pivot near to all, nobody is left.
   Their sets go on as differences from what most pivots hold, since two sets differ
   by just what their differences from any third set differ by: near copies are short.
   What is left is joined in the same way: in one task where it is small, else by parts.
   Where windows hold nearly everybody (pivots do not part the region), it is compared
   in pairs of blocks instead; the result is the same.

Before any set travels, a sketch (parities of the shingles in at least as many slots as
the set has shingles; two sketches, the wider folded to the other's width, differ in at
most as many slots as the sets differ in shingles) and the sizes tell who can have a
partner in a region at all; the others leave it.  A sketch is a 32nd of its set at most,
or 128 bytes.

Only edges of a spanning forest leave a task, never all pairs of a group.  Equal sets
are one member, whatever the number of their documents.

Defined results: a null text or one without words has an empty set, which links with
nothing; with fewer than ``k`` words the whole sequence is the one shingle; every row
gives a row, and rows of one doc_id with differing texts are linked by their texts only;
rows without doc_id link like others, and their component_id is the smallest doc_id that
they reach, null if there is none; texts of any length are read whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.arrays import LOWER, chunks, mixed, span_hashes, words
from runloom.llm.graph import Forest, components, grouped, in_blocks, likely
from runloom.operators.stage import discard, staged

WORDS, PERCENT = 4, 85
#: Most sets, and about the most shingles, that a task holds of a region or of a block.
REGION, REGION_SHINGLES = 2048, 2_000_000
#: Pivots of a large region: by number of likely partners, and by hash.
HUBS, FAN_OUT = 8, 8
STEPS = 8
#: More sets than this can't each hold a thousandth of all documents.
HOT_SHARE = 1000
CELLS_PER_BUCKET = 500_000
SIFT_BLOCK = 2048
#: Least and most slots of a sketch; sets of more shingles have the next power of two.
#: The most bounds a task's memory; longer sets only pass more easily.
SKETCH_BITS, MOST_BITS = 1024, 1 << 17
MEMBERS = ("region", "id", "size", "weight", "partners", "n_shingles")
PARTED = ("region", "part", "id", "label", "step", "n_shingles", "partners", "length")
LINK, SET = -1, -2
_GROWTH = 1.3
_SLACK = 1.42


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, hashes): the distinct shingles of a stretch of rows, sorted
    within each row."""
    for a, b, flat, offsets in chunks(column):
        flat = LOWER[flat]
        start, end, first = words(flat, offsets)
        key = span_hashes(flat, start, end)
        count = np.diff(first)
        row = np.repeat(np.arange(b - a), count)
        place = np.arange(len(key)) - first[row]
        left = count[row] - place  # words from here on
        gram = np.zeros(len(key), np.uint64)
        for j in range(k):
            ahead = np.zeros(len(key), np.uint64)
            ahead[: len(key) - j] = key[j:]
            ahead[left <= j] = 0  # past the text's end: a short text is padded
            gram = mixed(gram * np.uint64(3) + ahead + np.uint64(1))
        whole = (left >= k) | (place == 0)
        row, gram = row[whole], gram[whole]
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        row, gram = row[new], gram[new]
        yield a, np.searchsorted(row, np.arange(b - a + 1)), gram


def set_ids(offsets: np.ndarray, grams: np.ndarray) -> np.ndarray:
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mixed(grams), dtype=np.uint64, out=total[1:])
    return mixed(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def _class_table(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per size class: largest size, most differing shingles of a linked pair whose
    smaller set is in the class, number of segments."""
    top = []
    n = 1
    while not top or top[-1] < most:
        top.append(n)
        n = max(n + 1, int(n * _GROWTH))
    top = np.array(top)
    differ = (100 - percent) * top // percent
    segments = np.where(differ == 0, 1, np.maximum(differ + 2, np.ceil(_SLACK * differ).astype(np.int64)))
    return top, differ, segments


def cells(offsets: np.ndarray, grams: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of every cell of the sets."""
    size = np.diff(offsets)
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    top, differ, segments = _class_table(percent, int(size.max()))
    own = np.searchsorted(top, size)
    low = np.searchsorted(top, np.maximum(-(-size * percent // 100), 1))
    out_row, out_cell = [], []
    spread = np.repeat(np.arange(len(size)), size)
    for back in range(int((own - low).max()) + 1):
        cls = own - back
        rows = np.flatnonzero((cls >= low) & (size > 0))
        m, k = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        m[rows], k[rows] = segments[cls[rows]], differ[cls[rows]]
        base = np.zeros(len(size) + 1, np.int64)
        np.cumsum(m, out=base[1:])
        here = m[spread] > 0
        gram, at = grams[here], spread[here]
        slot = base[at] + (gram % m[at].astype(np.uint64)).astype(np.int64)
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, slot, mixed(gram + np.uint64(11)))
        filled = np.zeros(base[-1], bool)
        filled[slot] = True
        slot = np.flatnonzero(filled)
        row = np.searchsorted(base, slot, side="right") - 1
        tag = (cls[row].astype(np.uint64) << np.uint64(40)) + (slot - base[row]).astype(np.uint64)
        out_row.append(row)
        out_cell.append(mixed(total[slot] ^ mixed(tag + np.uint64(1))))
        # too few non-empty segments for the argument: single shingles are cells as well
        few = np.bincount(row, minlength=len(size)) <= k
        few[m == 0] = False
        few[k == 0] = False
        if few.any():
            lone = few[at]
            out_row.append(at[lone])
            out_cell.append(mixed(gram[lone] ^ mixed(cls[at[lone]].astype(np.uint64) + np.uint64(77))))
    return np.concatenate(out_row), np.concatenate(out_cell)


def sketches(offsets: np.ndarray, grams: np.ndarray) -> list[bytes]:
    """Per set, one bit per slot: is the number of its shingles there odd?

    Short of a slot per shingle the parities of long sets would be coin tosses, and
    any two of them would pass for near."""
    size = np.diff(offsets)
    bits = np.left_shift(1, np.ceil(np.log2(np.clip(size, SKETCH_BITS, MOST_BITS))).astype(np.int64))
    base = np.zeros(len(size) + 1, np.int64)
    np.cumsum(bits, out=base[1:])
    slot = (mixed(grams + np.uint64(5)) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(base[:-1], size) + slot, minlength=base[-1]) & 1
    flat = np.packbits(odd.astype(np.uint8))
    return [flat[a // 8 : b // 8].tobytes() for a, b in zip(base[:-1], base[1:])]


def _folded(sketch: np.ndarray, width: int) -> np.ndarray:
    """Sketches (a row each) as they would be with ``width`` words."""
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row_key, set_id, n_shingles, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, offsets, grams in shingle_sets(batch.column(2), k):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(a, n) for c in (0, 1)),
                        pa.array(set_ids(offsets, grams)),
                        pa.array(np.diff(offsets)),
                        pa.array(sketches(offsets, grams), pa.binary()),
                    ],
                    names=["doc_id", "row_key", "set_id", "n_shingles", "sketch"],
                )

    return docs.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id long, row_key long, set_id long, n_shingles long, sketch binary")


def sift(members: DataFrame, percent: int, block: int = SIFT_BLOCK) -> DataFrame:
    """region, id, partners: the members (region, id, size, n_shingles, sketch) that may
    have a partner in their region, by sizes and sketches, with the number of these."""

    def kernel(table: pa.Table) -> Iterator[pa.RecordBatch]:
        mine, lo, hi = table.column("mine").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        n = table.column("n_shingles").to_numpy()
        sketch = [np.frombuffer(b, np.uint64) for b in table.column("sketch").to_pylist()]
        width = np.array([len(b) for b in sketch])
        partners = np.zeros(len(n), np.int64)
        sides = [{w: np.flatnonzero((mine == side) & (width == w)) for w in np.unique(width)} for side in (lo, hi)]
        for (wide, left), (other, right) in product(*(side.items() for side in sides)):
            # sizes alone part sets whose widths are further apart than sizes of partners
            if not len(left) or not len(right) or 100 * n[left].max() < percent * n[right].min() or 100 * n[right].max() < percent * n[left].min():
                continue
            a, b = (_folded(np.stack([sketch[i] for i in rows]), min(wide, other)) for rows in (left, right))
            for s in range(0, len(left), 64):
                part = left[s : s + 64]
                differ = np.zeros((len(part), len(right)), np.int64)
                for w in range(a.shape[1]):
                    differ += np.bitwise_count(a[s : s + 64, w][:, None] ^ b[:, w][None, :])
                x, y = n[part][:, None], n[right][None, :]
                may = ((100 + percent) * differ <= (100 - percent) * (x + y)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
                may &= part[:, None] != right[None, :]
                partners[part] += may.sum(1)
                if lo != hi:
                    partners[right] += may.sum(0)
        found = table.select(["region", "id"]).append_column("partners", pa.array(partners)).filter(pa.array(partners > 0))
        yield from found.combine_chunks().to_batches()

    rows = in_blocks(members, "region", "size", block).select("region", "lo", "hi", "mine", "id", "n_shingles", "sketch")
    found = grouped(rows, ["region", "lo", "hi"], kernel, "region long, id long, partners long")
    return found.groupBy("region", "id").agg(F.sum("partners").alias("partners"))


def region_members(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """pivot, id (a set's), shared: the sets that share a cell with a pivot.

    A task packs its cells by bucket, so that the shuffle moves a few large values."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, offsets, grams in shingle_sets(batch.column(1), k):
                ids = set_ids(offsets, grams)
                first = np.zeros(len(ids), bool)
                first[np.unique(ids, return_index=True)[1]] = True
                row, cell = cells(offsets, grams, percent)
                keep = first[row]
                row, cell = row[keep], cell[keep]
                bucket = (cell % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                row, cell, bucket = row[order], cell[order], bucket[order]
                edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(row) else []
                groups = list(zip(edges, [*edges[1:], len(row)]))
                names, uses, which = [], [], []
                for s, e in groups:
                    used, inverse = np.unique(row[s:e], return_inverse=True)
                    names.append(ids[used].tobytes())
                    uses.append(inverse.astype(np.uint32).tobytes())
                    which.append(cell[s:e].tobytes())
                arrays = [pa.array([int(bucket[s]) for s, _ in groups], pa.int64()), *[pa.array(v, pa.binary()) for v in (names, uses, which)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "names", "uses", "cells"])

    def meet(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, cell = [], []
        for names, uses, which in zip(*(table.column(c).to_pylist() for c in ("names", "uses", "cells"))):
            ids.append(np.frombuffer(names, np.int64)[np.frombuffer(uses, np.uint32)])
            cell.append(np.frombuffer(which, np.uint64))
        ids, cell = np.concatenate(ids), np.concatenate(cell)
        order = np.lexsort((ids, cell))
        ids, cell = ids[order], cell[order]
        new = np.r_[True, cell[1:] != cell[:-1]]
        start = np.flatnonzero(new)
        pivot = np.repeat(ids[start], np.diff(np.r_[start, len(ids)]))
        other = ids != pivot
        pair, shared = np.unique(np.stack([pivot[other], ids[other]], 1), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(shared)], names=["pivot", "id", "shared"])

    packed = docs.select("row_key", "text").mapInArrow(pack, "bucket long, names binary, uses binary, cells binary")
    met = grouped(packed, ["bucket"], meet, "pivot long, id long, shared long")
    return met.groupBy("pivot", "id").agg(F.sum("shared").alias("shared"))


def with_grams(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """MEMBERS and grams: the shingle hashes of the sets of ``wanted`` (MEMBERS and the
    row_key of a document), from the texts of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, offsets, grams in shingle_sets(batch.column(0), k):
                rest = pa.Table.from_batches([batch]).slice(a, len(offsets) - 1).select(list(MEMBERS))
                # a row_key with several texts brings those along that aren't asked for
                found = np.flatnonzero(set_ids(offsets, grams) == rest.column("id").to_numpy())
                rows = [grams[offsets[i] : offsets[i + 1]].tobytes() for i in found]
                yield from rest.take(pa.array(found)).append_column("grams", pa.array(rows, pa.binary())).to_batches()

    texts = likely(docs.select("row_key", "text"), wanted, "row_key").join(wanted, "row_key").select("text", *MEMBERS)
    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in MEMBERS) + ", grams binary")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set.

    Shingles with the same members count as one with a weight, so the product is as wide
    as there are different memberships."""
    both = [*left, *right]
    row = np.repeat(np.arange(len(both)), [len(g) for g in both])
    gram = np.concatenate(both)
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    count = np.diff(np.r_[start, len(gram)])
    start, count = start[count > 1], count[count > 1]
    out = np.zeros((len(left), len(right)))
    if not len(start):
        return out
    tag = mixed(np.arange(1, len(both) + 1, dtype=np.uint64))
    total = np.zeros(len(row) + 1, np.uint64)
    np.cumsum(tag[row], dtype=np.uint64, out=total[1:])
    _, sample, weight = np.unique(total[start + count] - total[start], return_index=True, return_counts=True)
    start, count = start[sample], count[sample]
    for s in range(0, len(start), 4096):
        st, ct, w = start[s : s + 4096], count[s : s + 4096], weight[s : s + 4096]
        member = np.zeros((len(both), len(st)), np.float32)
        column = np.repeat(np.arange(len(st)), ct)
        at = np.arange(ct.sum()) - np.repeat(np.cumsum(ct) - ct, ct) + np.repeat(st, ct)
        member[row[at], column] = 1
        out += (member[: len(left)] * w.astype(np.float32)) @ member[len(left) :].T
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets of ``a`` and ``b`` shingles, given by their
    differences from one third set."""
    more_a, more_b = (n - np.array([len(s) for s in sets], np.int64) for n, sets in ((a, left), (b, right)))
    return _overlaps(left, right) + (more_a[:, None] + more_b[None, :]) / 2


def _linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    inter = np.rint(inter).astype(np.int64)
    return 100 * inter >= percent * (a[:, None] + b[None, :] - inter)


def _distance(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - inter / np.maximum(a[:, None] + b[None, :] - inter, 1)


def join_region(ids: np.ndarray, sets: list[np.ndarray], percent: int, size: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Forest edges of the links within one region.  Where ``sets`` are differences from
    a third set, ``size`` tells the sets' own sizes."""
    size, radius = np.array([len(s) for s in sets]) if size is None else size, 1 - percent / 100
    p = int(np.argmin(ids))
    inter = _common([sets[p]], sets, size[[p]], size)
    inner = _linked(inter, size[[p]], size, percent)[0]
    inner[p] = True
    edges = [(int(ids[i]), int(ids[p])) for i in np.flatnonzero(inner) if i != p]
    outer = np.flatnonzero(~inner)
    if not len(outer):
        return edges
    d = _distance(inter, size[[p]], size)[0]
    near = np.flatnonzero(inner & (d >= d[outer].min() - radius - 1e-9))
    near = near[near != p]
    forest = Forest(len(ids))
    for i in np.flatnonzero(inner):
        forest.join(int(i), p)
    others = np.concatenate([outer, near])
    for s in range(0, len(outer), 256):
        mine = outer[s : s + 256]
        hit = _linked(_common([sets[i] for i in mine], [sets[i] for i in others], size[mine], size[others]), size[mine], size[others], percent)
        hit &= np.abs(d[mine][:, None] - d[others][None, :]) <= radius + 1e-9
        for i, j in zip(*np.nonzero(hit)):
            if forest.join(int(mine[i]), int(others[j])):
                edges.append((int(ids[mine[i]]), int(ids[others[j]])))
    return edges


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _distinct(table: pa.Table) -> pa.Table:
    """One row per set: repeated rows of a document bring its set several times."""
    return table.take(pa.array(np.sort(np.unique(table.column("id").to_numpy(), return_index=True)[1])))


def _sets(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return table.column("id").to_numpy(), [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]


def _blocks(region: int, shingles: int) -> Column:
    """Number of parts of a region of ``size`` sets with ``weight`` shingles."""
    return F.greatest(F.ceil(F.col("size") / region), F.ceil(F.col("weight") / shingles), F.lit(1)).cast("long")


def _join_small(members: DataFrame, percent: int) -> DataFrame:
    def kernel(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = _distinct(table)
        yield _edge_batch(join_region(*_sets(table), percent, table.column("n_shingles").to_numpy()))

    return grouped(members.select("region", "id", "n_shingles", "grams"), ["region"], kernel, "a long, b long")


def _join_blocks(members: DataFrame, percent: int, region: int, shingles: int) -> DataFrame:
    """Links of regions that pivots do not part, in pairs of blocks."""

    def kernel(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = _distinct(table)
        ids, sets = _sets(table)
        mine = table.column("mine").to_numpy()
        size, forest, edges = table.column("n_shingles").to_numpy(), Forest(len(ids)), []
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        if len(left) and len(right):
            for s in range(0, len(left), 256):
                part = left[s : s + 256]
                hit = _linked(_common([sets[i] for i in part], [sets[i] for i in right], size[part], size[right]), size[part], size[right], percent)
                for i, j in zip(*np.nonzero(hit)):
                    if forest.join(int(part[i]), int(right[j])):
                        edges.append((int(ids[part[i]]), int(ids[right[j]])))
        yield _edge_batch(edges)

    rows = in_blocks(members.withColumn("blocks", _blocks(region, shingles)), "region", "blocks", 1)
    return grouped(rows.select("region", "lo", "hi", "mine", "id", "n_shingles", "grams"), ["region", "lo", "hi"], kernel, "a long, b long")


def _part_region(members: DataFrame, percent: int, region: int, shingles: int, level: int) -> DataFrame:
    """PARTED and grams: members in the Voronoi regions of their region's new pivots and
    in the windows of others.

    ``label`` is the smallest known member of a member's component, ``step`` its distance
    to the part's pivot in STEPS-ths of the radius.  Rows with step LINK are links of
    ``id`` with the pivot that ``part`` names; rows with step SET, one a member, have its
    grams as the difference, of ``length`` shingles, from those that most pivots hold."""
    radius = 1 - percent / 100
    width = max(radius, 0.01) / STEPS
    members = members.withColumn("blocks", _blocks(region, shingles))
    lean = members.select("region", "id", "size", "partners")
    rank = F.row_number().over(W.partitionBy("region").orderBy(F.desc("partners"), "id"))
    hubs = lean.withColumn("rank", rank).where(F.col("rank") <= HUBS).select("region", "id")
    spread = lean.where(F.pmod(F.xxhash64("id", F.lit(100 + level)), F.col("size")) < FAN_OUT).select("region", "id")
    chosen = staged(hubs.union(spread).distinct())
    rows = members.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(level)), F.col("blocks"))).withColumn("is_pivot", F.lit(False))
    pivots = (
        members.join(chosen, ["region", "id"])
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("is_pivot", F.lit(True))
    )

    def kernel(table: pa.Table) -> Iterator[pa.RecordBatch]:
        is_pivot = table.column("is_pivot").to_numpy(zero_copy_only=False)
        heads = _distinct(table.filter(pa.array(is_pivot)))
        rest = table.filter(pa.array(~is_pivot))
        rest = _distinct(rest.filter(pa.array(~np.isin(rest.column("id").to_numpy(), heads.column("id").to_numpy()))))
        (head, head_sets), (ids, sets) = _sets(heads), _sets(rest)
        head_size, size = (t.column("n_shingles").to_numpy() for t in (heads, rest))
        group = table.column("region")[0].as_py()

        def out(x, step, part=0, label=0, n=0, partners=0, length=0, grams=None):
            ints = [np.broadcast_to(np.asarray(v, np.int64), len(x)) for v in (group, part, x, label, step, n, partners, length)]
            return pa.RecordBatch.from_arrays([*map(pa.array, ints), pa.array(grams or [None] * len(x), pa.binary())], names=[*PARTED, "grams"])

        forest, pairs = Forest(len(head)), []
        order = np.argsort(head)  # roots are the smallest ids
        both = [head_sets[i] for i in order]
        for i, j in zip(*np.nonzero(np.triu(_linked(_common(both, both, head_size[order], head_size[order]), head_size[order], head_size[order], percent), 1))):
            if forest.join(int(i), int(j)):
                pairs.append((head[order[i]], head[order[j]]))
        known = np.zeros(len(head), np.int64)
        known[order] = [head[order[forest.root(i)]] for i in range(len(head))]
        yield out(np.array([b for _, b in pairs], np.int64), LINK, np.array([a for a, _ in pairs], np.int64))
        if not len(ids):
            return
        inter = _common(sets, head_sets, size, head_size)
        link, d = _linked(inter, size, head_size, percent), _distance(inter, size, head_size)
        i, j = np.nonzero(link)
        yield out(ids[i], LINK, head[j])
        label = np.where(link.any(1), known[link.argmax(1)], ids)
        i, j = np.nonzero(d <= d.min(1, keepdims=True) + 2 * radius + 1e-9)
        part = mixed(head.view(np.uint64) ^ mixed(np.array([group], np.int64).view(np.uint64))).view(np.int64)[j]
        gram, holders = np.unique(np.concatenate(head_sets), return_counts=True)
        most = gram[2 * holders > len(head)]
        short = [np.setxor1d(g, most, assume_unique=True) for g in sets]
        length = np.array([len(g) for g in short])
        yield out(ids[i], d[i, j] // width, part, label[i], size[i], rest.column("partners").to_numpy()[i], length[i])
        yield out(ids, SET, grams=[g.tobytes() for g in short])

    columns = ["region", "chunk", "is_pivot", "id", "partners", "n_shingles", "grams"]
    both = rows.select(*columns).unionByName(pivots.select(*columns))
    return grouped(both, ["region", "chunk"], kernel, ", ".join(f"{c} long" for c in PARTED) + ", grams binary")


def _undecided(parts: DataFrame) -> DataFrame:
    """Rows of ``parts`` that can link to a member of another label: one is within the
    radius (and the steps' width) of their own distance to the part's pivot."""
    per_step = parts.groupBy("region", "part", "step").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    reach = W.partitionBy("region", "part").orderBy("step").rangeBetween(-STEPS - 1, STEPS + 1)
    per_step = per_step.select("region", "part", "step", F.min("least").over(reach).alias("least"), F.max("most").over(reach).alias("most"))
    return parts.join(per_step.where("least < most"), ["region", "part", "step"]).select("region", "part", "id", "n_shingles", "partners", "length")


def link_edges(
    small: DataFrame, large: DataFrame | None, percent: int, region: int = REGION, shingles: int = REGION_SHINGLES, most_levels: int = 12
) -> DataFrame:
    """a, b: forest edges of all links inside regions.  Both inputs have MEMBERS (region,
    id, partners, n_shingles, and the region's size and weight in shingles) and grams; the regions of
    ``large`` have more than ``region`` members or ``shingles`` shingles."""
    edges = _join_small(small, percent)
    fits = (F.col("size") <= region) & (F.col("weight") <= shingles)
    sums = [F.count("*").alias("size"), F.sum("length").alias("weight")]
    for level in range(most_levels):
        if large is None or large.isEmpty():
            return edges
        found = staged(_part_region(large, percent, region, shingles, level))
        edges = edges.unionByName(found.where(F.col("step") == LINK).select(F.col("id").alias("a"), F.col("part").alias("b")))
        left = staged(_undecided(found.where("step >= 0")))
        if left.isEmpty():
            return edges
        sets = found.where(F.col("step") == SET).select("region", "id", "grams")
        parts = left.groupBy("region", "part").agg(*sums)
        work = parts.groupBy("region").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("work"))
        rest = left.select("region", "id", "n_shingles", "partners", "length").distinct()
        judged = rest.groupBy("region").agg(*sums).join(work, "region")
        together = fits | (F.col("work") > 0.7 * F.col("size").cast("double") * F.col("size"))
        judged = staged(judged.withColumn("together", together))
        whole = staged(rest.join(judged.where("together"), "region").select(*MEMBERS)).join(sets, ["region", "id"])
        edges = edges.unionByName(_join_small(whole.where(fits), percent))
        edges = edges.unionByName(_join_blocks(whole.where(~fits), percent, region, shingles))
        apart = left.join(judged.where("not together").select("region"), "region").join(parts, ["region", "part"])
        apart = staged(apart.select("region", "part", "id", "size", "weight", "partners", "n_shingles"))
        parted = apart.join(sets, ["region", "id"]).drop("region").withColumnRenamed("part", "region").select(*MEMBERS, "grams")
        edges = edges.unionByName(_join_small(parted.where(fits), percent))
        large = staged(parted.where(~fits))
    return edges if large is None else edges.unionByName(_join_blocks(large, percent, region, shingles))


def merged_regions(met: DataFrame) -> DataFrame:
    """id, region, size, weight, partners: one region per set, made of all regions that
    share members, so that each set travels once.  ``met`` has n_shingles."""
    groups = components(met.select(F.col("id").alias("a"), F.xxhash64("region", F.lit("region")).alias("b")))
    one = met.groupBy("id").agg(F.sum("partners").alias("partners"), F.first("n_shingles").alias("n_shingles"))
    one = one.join(groups, "id").withColumnRenamed("label", "region")
    return one.join(one.groupBy("region").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight")), "region")


def _classed(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: documents by their set's component.

    Smallest ids are taken per set, then per label.  Sets of over a HOT_SHARE-th of all
    documents, fewer than HOT_SHARE, are broadcast; the others go by a plain join."""
    total = sets.count()
    per_set = sets.groupBy("set_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    per_set = per_set.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    per_set = staged(per_set)
    per_label = per_set.groupBy("label").agg(F.min("least").alias("component_id"))
    named = staged(per_set.join(per_label, "label").select("set_id", "component_id", (F.col("n") * HOT_SHARE > total).alias("hot")))
    hot = F.broadcast(named.where("hot").drop("hot"))
    lean = sets.select("doc_id", "set_id", "n_shingles")
    out = lean.join(hot, "set_id").unionByName(lean.join(hot, "set_id", "left_anti").join(named.where("not hot").drop("hot"), "set_id"))
    return out.select("doc_id", "n_shingles", "component_id")


def classes(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, region: int = REGION, shingles: int = REGION_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("row_key"), "text")
    sets = staged(document_sets(docs, k))
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = 1 << max(6, math.ceil(math.log2(1 + total / CELLS_PER_BUCKET)))
    pairs = staged(region_members(docs, k, percent, buckets).select(F.col("pivot").alias("region"), "id"))
    sizes = pairs.groupBy("region").agg((F.count("*") + 1).alias("size"))
    inside = pairs.union(pairs.select("region", "region").distinct()).join(sizes, "region")
    one = sets.groupBy("set_id").agg(F.min(F.struct(F.isnull("doc_id").alias("nameless"), "row_key", "n_shingles", "sketch")).alias("of"))
    one = one.select(F.col("set_id").alias("id"), "of.*")
    met = staged(sift(inside.join(one.select("id", "n_shingles", "sketch"), "id"), percent))
    discard(pairs)
    keys = one.select("id", "row_key", "n_shingles")
    wanted = staged(merged_regions(met.join(keys.drop("row_key"), "id")).join(keys.drop("n_shingles"), "id"))
    fits = (F.col("size") <= region) & (F.col("weight") <= shingles)
    beyond = wanted.where(~fits)
    large = None if beyond.isEmpty() else staged(with_grams(docs, beyond, k))
    small = with_grams(docs, wanted.where(fits), k)
    labels = components(link_edges(small, large, percent, region, shingles))
    if large is not None:
        discard(large)
    found = _classed(sets.where("n_shingles > 0").select("doc_id", "set_id", "n_shingles"), labels)
    return found.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
