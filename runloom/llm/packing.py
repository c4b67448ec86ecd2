"""Best-fit packing of token sequences with a bounded number of open bins.

Tasks pack the documents of their own partitions, so nothing is shuffled and a lost
task is simply done again.  A document longer than a sequence is cut into full pieces,
which are sequences by themselves, and a shorter first piece.  Shorter pieces go, the
longest of an Arrow batch first, to the open bin that they fill best.  The free space
of open bins is a bitset, so the best bin is the lowest set bit from the piece's
length on.  When all bins are open and none fits, the fullest one closes.

Defined results: a null or empty text is the closing id alone; repeated rows are
packed again; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from runloom.llm.tokens import BatchEncoder, public_encoder

SEQUENCE = 1024
OPEN_BINS = 1024
END_ID = 2
_SEQUENCES_PER_TASK = 1 << 40

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class OpenBins:
    """Best fit over at most ``most`` open bins of ``size`` units."""

    def __init__(self, size: int, most: int, first_id: int = 0):
        self.size, self.most, self.next_id = size, most, first_id
        self.free_bits = 0
        self.bins: dict[int, list[int]] = {}
        self.open = 0

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def _take(self, free: int) -> int:
        ids = self.bins[free]
        found = ids.pop()
        if not ids:
            del self.bins[free]
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return found

    def add(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of ``length`` units, 1 to ``size``."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            where = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, where = self.size, self.new_id()
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(where)
            self.free_bits |= 1 << left
            self.open += 1
        return where, self.size - free


@lru_cache(maxsize=1)
def _encoder(name: str) -> BatchEncoder:
    return public_encoder(name)


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` units; the first may be shorter."""
    head = total % size
    pieces = [(0, head)] if head else []
    return pieces + [(s, size) for s in range(head, total, size)]


def pack_batch(doc_ids: list[int], texts: list[str | None], encoder: BatchEncoder, bins: OpenBins) -> list[tuple]:
    out, short = [], []
    for doc, ids in zip(doc_ids, encoder.encode([t or "" for t in texts])):
        ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
        for piece, (start, length) in enumerate(cut(len(ids), bins.size)):
            crc = zlib.crc32(ids[start : start + length].tobytes())
            row = (doc, piece, start, length, crc)
            if length == bins.size:
                out.append((*row, bins.new_id(), 0))
            else:
                short.append(row)
    short.sort(key=lambda r: -r[3])
    out += [(*row, *bins.add(row[3])) for row in short]
    return out


def pack(docs: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Pieces of all documents with their places in sequences of ``sequence`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(sequence, open_bins, TaskContext.get().partitionId() * _SEQUENCES_PER_TASK)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        for batch in batches:
            rows = pack_batch(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _encoder(vocabulary), bins)
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
