"""Quantile boosting: trees under the pinball loss, grown where the rows are.

All (target, quantile) models grow side by side.  A round of depth D takes D + 1 passes
over the staged, binned rows.  In a pass a task counts, per model, node, feature and bin,
its rows and those above their prediction: the pinball gradient has two values, so these
whole numbers are the whole gradient histogram, and their sums don't depend on the order
of tasks (bin edges are approximate percentiles, the only part that can vary a little).
The counts are added up by (model, node), a row a task and node, each node finds its
best cut, and the driver gets one split a node.  The last pass counts residuals of every
leaf in buckets of RATIO; such sketches add up exactly, and the leaf becomes the
quantile of its residuals to half a bucket.

Below the root only the smaller child of a split is counted, the other is its parent less
that one: whole numbers, so the trees stay the same.  Rows lie in blocks of BLOCK, so that
reading them costs by bytes and not by rows.

What is shuffled a pass is tasks x models x nodes x features x bins, whatever the number
of rows.  Every RESTAGE rounds the predictions are written with the rows, so that a pass
never runs through more than RESTAGE trees a model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.stage import discard, staged

BINS = 32
RESTAGE = 2
ACCURACY = 2000
#: rows of a block; sums of FIELDS flags over it fit a double side by side
BLOCK, BITS, FIELDS = 4096, 13, 3
#: width of a residual bucket and the size below which a residual is nothing
RATIO, NOTHING, MOST = 1.02, 1e-9, 2500
STAY = 255  # a cut that no bin passes: the node is not split


@dataclass
class Tree:
    """Per model a complete tree: nodes in heap order, leaves from left to right."""

    feature: np.ndarray  # models x nodes
    cut: np.ndarray  # models x nodes; bins above go right
    value: np.ndarray  # models x leaves

    @classmethod
    def empty(cls, models: int, depth: int) -> Tree:
        nodes = (1 << depth) - 1
        return cls(np.zeros((models, nodes), np.int16), np.full((models, nodes), STAY, np.uint8), np.zeros((models, 1 << depth)))

    def leaf(self, x: np.ndarray, m: int, levels: int) -> np.ndarray:
        """Place of every row among the nodes of a level."""
        at, rows, flat = np.zeros(len(x), np.int64), np.arange(len(x)) * x.shape[1], x.reshape(-1)
        feature, cut = self.feature[m].astype(np.int64), self.cut[m]
        for level in range(levels):
            node = at + ((1 << level) - 1)
            at = 2 * at + (flat.take(rows + feature.take(node)) > cut.take(node))
        return at

    @property
    def depth(self) -> int:
        return self.value.shape[1].bit_length() - 1

    def add_to(self, f: np.ndarray, x: np.ndarray, rounds: np.ndarray | None = None, number: int = 0) -> None:
        for m in range(len(self.value)):
            if (rounds is None or number < rounds[m]) and self.value[m].any():
                f[:, m] += self.value[m][self.leaf(x, m, self.depth)]


@dataclass
class QuantileModel:
    features: list[str]
    edges: list[np.ndarray]
    models: list[tuple[str, float]]  # target column, quantile
    trees: list[Tree] = field(default_factory=list)
    rounds: np.ndarray | None = None  # trees that count, a model
    losses: list[np.ndarray] = field(default_factory=list)  # on held-out rows, before each round

    def bins(self, columns: Sequence[pa.Array]) -> np.ndarray:
        """Bin of every value, 0 where it is missing."""
        out = np.zeros((len(columns[0]), len(columns)), np.uint8)
        for j, column in enumerate(columns):
            v = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, j] = np.where(np.isnan(v), 0, 1 + np.searchsorted(self.edges[j], v, side="left"))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.zeros((len(x), len(self.models)))
        for number, tree in enumerate(self.trees):
            tree.add_to(f, x, self.rounds, number)
        return f


def bucket(r: np.ndarray) -> np.ndarray:
    size = np.ceil(np.log(np.maximum(np.abs(r), NOTHING) / NOTHING) / np.log(RATIO)).astype(np.int64)
    return np.sign(r).astype(np.int64) * np.minimum(size, MOST)


def bucket_value(b: np.ndarray) -> np.ndarray:
    """The middle of a bucket; its ends are no further away than half of RATIO - 1."""
    return np.sign(b) * NOTHING * RATIO ** np.abs(b) * 2 / (1 + RATIO) * (b != 0)


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Approximate percentiles of every feature, repeats left out: one row."""
    marks = [i / (bins - 1) for i in range(1, bins - 1)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), marks, F.lit(ACCURACY)).alias(f"_{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(found[i] or [], float)) for i in range(len(features))]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


SCHEMA = "x binary, y binary, held binary, f binary"


def _row_blocks(x: np.ndarray, y: np.ndarray, held: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    cuts = [slice(i, i + BLOCK) for i in range(0, len(x), BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array([part[c].tobytes() for c in cuts], pa.binary()) for part in (x, y, held, f)], names=["x", "y", "held", "f"])


def _opened(batches: Iterator[pa.RecordBatch], pending: Sequence[Tree]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """bins, targets, held, predictions of each block"""
    for batch in batches:
        for i in range(batch.num_rows):
            x, y, held, f = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate((np.uint8, float, bool, float)))
            x, y, f = (part.reshape(len(held), -1) for part in (x, y, f))
            f = f.copy()
            for tree in pending:
                tree.add_to(f, x)
            yield x, y, held, f


def binned(rows: DataFrame, model: QuantileModel, targets: Sequence[str], held: str) -> DataFrame:
    n = len(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[1 : n + 1]], axis=1)
                held = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
                yield _row_blocks(model.bins(batch.columns[n + 1 :]), y, held, np.zeros((batch.num_rows, len(model.models))))

    return rows.select(F.col(held).cast("boolean"), *targets, *model.features).mapInArrow(run, SCHEMA)


def moved_on(rows: DataFrame, pending: Sequence[Tree]) -> DataFrame:
    """The rows with the trees of some rounds in their predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _opened(batches, pending):
            yield _row_blocks(*block)

    return rows.mapInArrow(run, SCHEMA)


def splits(
    rows: DataFrame, model: QuantileModel, of: np.ndarray, pending: Sequence[Tree], tree: Tree, level: int, active: Sequence[int],
    bins: int, leaf: int, l2: float, seen: dict[tuple[int, int], tuple[np.ndarray, int]] | None = None,
) -> tuple[list, dict[int, float]]:
    """Best split of every node of a level, and at the root the mean loss of held-out rows.

    ``seen`` holds the split nodes of the level above by (model, node): their counts and
    which child has fewer rows.  Only these children are counted then, and ``seen`` moves on
    to this level.  It is bounded by models x nodes x features x bins."""
    d, width = len(model.features), 2 * bins
    quantile = np.array([q for _, q in model.models])
    above = dict(seen) if seen and level else None
    wanted = {m: np.arange(1 << level) if above is None else np.array(sorted(2 * node + side for (k, node), (_, side) in above.items() if k == m), np.int64) for m in active}
    keep = seen is not None and level < tree.depth - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros(len(wanted[m]) * d * width, np.int64) for m in active}
        place = {m: np.full(1 << level, -1, np.int64) for m in active}
        for m in active:
            place[m][wanted[m]] = np.arange(len(wanted[m])) * (d * width)
        loss = {m: np.zeros(2) for m in active}
        starts = np.arange(d, dtype=np.int64) * width
        groups = [(t, [m for m in active if of[m] == t]) for t in sorted({int(of[m]) for m in active})]
        for x, y, held, f in _opened(batches, pending):
            slots = x.astype(np.int64)
            slots *= 2
            slots += starts
            for of_target, shared in groups:
                gap = y[:, of_target, None] - f[:, shared]
                real = ~np.isnan(gap[:, 0])
                use = real & ~held
                if level == 0:
                    g = gap[real & held]
                    for i, m in enumerate(shared):
                        loss[m][0] += np.maximum(quantile[m] * g[:, i], (quantile[m] - 1) * g[:, i]).sum()
                        loss[m][1] += len(g)
                    # everyone is in the root: one count for some models, their flags side by side
                    cells = (slots if use.all() else slots[use]).ravel()
                    over = (gap[use] > 0).astype(np.int64)
                    for lo in range(0, len(shared), FIELDS):
                        few = shared[lo : lo + FIELDS]
                        flags = 1 + sum(over[:, lo + i] << (BITS * (i + 1)) for i in range(len(few)))
                        sums = np.bincount(cells, np.repeat(flags.astype(float), d), minlength=d * width)[::2].astype(np.int64)
                        n = sums & ((1 << BITS) - 1)
                        for i, m in enumerate(few):
                            up = (sums >> (BITS * (i + 1))) & ((1 << BITS) - 1)
                            total[m][1::2] += up
                            total[m][::2] += n - up
                    continue
                for i, m in enumerate(shared):
                    if not len(wanted[m]):
                        continue
                    at = place[m].take(tree.leaf(x, m, level))
                    some = np.flatnonzero(use & (at >= 0))
                    cells = slots.take(some, axis=0)
                    cells += (at.take(some) + (gap[:, i].take(some) > 0))[:, None]
                    total[m] += np.bincount(cells.ravel(), minlength=len(total[m]))
        for m in active:
            # a row a node; what a task counts of a cell fits an int
            cells = total[m].reshape(-1, d * width)
            some = np.flatnonzero(cells.any(1))
            node, cells, lost = wanted[m][some], cells[some], [loss[m][0], float(loss[m][1])]
            if level == 0:
                node, cells = np.append(node, -1), np.vstack([cells, np.zeros((1, d * width), np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(node), m, np.int32)), pa.array(node.astype(np.int32)), _lists(cells.astype(np.int32)), _lists(np.tile(lost, (len(node), 1)))],
                names=["model", "node", "counts", "loss"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                keys = zip(*(batch.column(i).to_pylist() for i in range(2)))
                for key, counts, loss in zip(keys, _matrix(batch.column(2)), _matrix(batch.column(3))):
                    cells[key] = cells.get(key, 0) + (counts.astype(np.int64) if key[1] >= 0 else loss)
        out = []
        for (m, node), counts in [*cells.items()]:
            if node >= 0 and above is not None:
                cells[m, node ^ 1] = above[m, node >> 1][0] - counts
        for (m, node), counts in cells.items():
            if node < 0:
                out.append((m, node, 0, 0, counts[0] / counts[1] if counts[1] else 0.0, 0, None))
                continue
            both = counts.reshape(d, bins, 2).astype(float)
            n, over = both.sum(2).cumsum(1), both[:, :, 1].cumsum(1)
            g = over - (1 - quantile[m]) * n
            side = lambda g, n: g * g / (n + l2)
            gain = side(g, n) + side(g[:, -1:] - g, n[:, -1:] - n) - side(g[:, -1:], n[:, -1:])
            gain[(n < leaf) | (n[:, -1:] - n < leaf)] = -1.0
            # the first feature of equal ones
            feature, best = divmod(int(gain.argmax()), bins)
            top = float(gain[feature, best])
            fewer = int(2 * n[feature, best] > n[feature, -1])
            out.append((m, node, feature, best, top, fewer, counts.astype(np.int64).tobytes() if keep and top > 0 else None))
        columns = list(zip(*out)) or [()] * 7
        kinds = [pa.int32()] * 4 + [pa.float64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["model", "node", "feature", "cut", "gain", "fewer", "counts"])

    cells = rows.mapInArrow(count, "model int, node int, counts array<int>, loss array<double>").repartition("model", "node")
    found = cells.mapInArrow(cut, "model int, node int, feature int, cut int, gain double, fewer int, counts binary").collect()
    if seen is not None:
        seen.clear()
        seen.update({(r.model, r.node): (np.frombuffer(r.counts, np.int64), r.fewer) for r in found if r.counts is not None})
    return [(r.model, r.node, r.feature, r.cut, r.gain) for r in found if r.node >= 0], {r.model: r.gain for r in found if r.node < 0}


def leaf_quantiles(rows: DataFrame, model: QuantileModel, of: np.ndarray, pending: Sequence[Tree], tree: Tree, active: Sequence[int]) -> list:
    """(model, leaf, quantile of the residuals) by adding up the tasks' sketches."""
    leaves, span = tree.value.shape[1], 2 * MOST + 1

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros(leaves * span, np.int64) for m in active}
        # some blocks at a time: a count runs over all buckets
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                keys = {m: [] for m in active}
                for x, y, held, f in _opened([batch.slice(lo, 32)], pending):
                    for m in active:
                        gap = y[:, of[m]] - f[:, m]
                        use = ~np.isnan(gap) & ~held
                        keys[m].append(tree.leaf(x[use], m, tree.depth) * span + bucket(gap[use]) + MOST)
                for m in active:
                    total[m] += np.bincount(np.concatenate(keys[m]), minlength=leaves * span)
        for m in active:
            # a row a leaf: the buckets it has and how often
            cells = total[m].reshape(leaves, span)
            filled = np.flatnonzero(cells.any(1))
            some = [np.flatnonzero(cells[place]) for place in filled]
            packed = [[at.astype(np.int16).tobytes() for at in some], [cells[place][at].tobytes() for place, at in zip(filled, some)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(filled), m, np.int32)), pa.array(filled.astype(np.int32)), *(pa.array(c, pa.binary()) for c in packed)], names=["model", "leaf", "at", "n"])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for m, place, at, n in zip(*(column.to_pylist() for column in batch.columns)):
                total.setdefault((m, place), np.zeros(span, np.int64))[np.frombuffer(at, np.int16)] += np.frombuffer(n, np.int64)
        first = []
        for (m, _), n in total.items():
            upto = n.cumsum()
            first.append(int(np.searchsorted(upto, model.models[m][1] * upto[-1])) - MOST)
        columns = [[m for m, _ in total], [place for _, place in total], first]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], names=["model", "leaf", "b"])

    sketches = rows.mapInArrow(sketch, "model int, leaf int, at binary, n binary").repartition("model", "leaf")
    return [(r.model, r.leaf, float(bucket_value(np.array(r.b)))) for r in sketches.mapInArrow(reached, "model int, leaf int, b int").collect()]


def fit_quantiles(
    rows: DataFrame, features: Sequence[str], targets: Sequence[str], quantiles: Sequence[float], held: str,
    rounds: int = 400, depth: int = 5, rate: float = 0.06, leaf: int = 40, l2: float = 1.0, bins: int = BINS, patience: int = 30,
) -> QuantileModel:
    """A model for every target and quantile.  Rows with ``held`` true only tell when to
    stop: a model ends with the round before ``patience`` rounds without a better loss
    (without such rows, after ``rounds``).  Rows without a target are no rows of it."""
    if not 2 < bins < STAY:
        raise ValueError(f"bins must be in (2, {STAY})")
    # fixed values: rounds, rate, leaf size, penalty and patience; depth 5 has the leaves of the modelled ensemble
    pairs = [(t, q) for t in targets for q in quantiles]
    model = QuantileModel(list(features), bin_edges(rows, features, bins), pairs)
    of = np.array([list(targets).index(t) for t, _ in pairs])
    data = staged(binned(rows, model, targets, held))
    everyone = list(range(len(pairs)))

    start = Tree.empty(len(pairs), 0)
    for m, place, value in leaf_quantiles(data, model, of, [], start, everyone):
        start.value[m, place] = value
    model.trees.append(start)
    pending, active = [start], everyone
    best, best_at = np.full(len(pairs), np.inf), np.ones(len(pairs), int)
    stopped = False

    def judge(loss: dict[int, float]) -> list[int]:
        row = np.full(len(pairs), np.nan)
        for m, value in loss.items():
            row[m] = value
            if value < best[m]:
                best[m], best_at[m] = value, len(model.trees)
        model.losses.append(row)
        return [m for m in active if len(model.trees) - best_at[m] < patience]

    for _ in range(rounds):
        tree, seen = Tree.empty(len(pairs), depth), {}
        for level in range(depth):
            found, loss = splits(data, model, of, pending, tree, level, active, bins, leaf, l2, seen)
            if level == 0 and loss:
                stopped = True
                active = judge(loss)
                if not active:
                    break
                for key in [k for k in seen if k[0] not in active]:
                    del seen[key]
            split = [s for s in found if s[4] > 0 and s[0] in active]
            for m, node, feature, cut, _ in split:
                tree.feature[m, node + (1 << level) - 1], tree.cut[m, node + (1 << level) - 1] = feature, cut
            if not split:
                break
        if not active:
            break
        for m, place, value in leaf_quantiles(data, model, of, pending, tree, active):
            tree.value[m, place] = rate * value
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) >= RESTAGE:
            before, data = data, staged(moved_on(data, pending))
            discard(before)
            pending = []
    if stopped and active:
        judge(splits(data, model, of, pending, Tree.empty(len(pairs), 0), 0, active, bins, leaf, l2)[1])
    discard(data)
    held_out = bool(model.losses) and bool(np.nanmax(model.losses[0]) > 0)
    model.rounds = best_at if held_out else np.full(len(pairs), len(model.trees))
    return model


def predict_quantiles(model: QuantileModel, rows: DataFrame, keep: Sequence[str], name) -> DataFrame:
    """``keep`` and one column ``name(target, quantile)`` a model."""
    names = [name(t, q) for t, q in model.models]
    kept = rows.select(*keep).schema
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                f = model.predict(model.bins(batch.columns[n:]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(f[:, m]) for m in range(len(names)))], names=[*batch.schema.names[:n], *names])

    for c in names:
        kept = kept.add(c, "double")
    inputs = [F.col(f).cast("double").alias(f"_in_{i}") for i, f in enumerate(model.features)]
    return rows.select(*keep, *inputs).mapInArrow(run, kept)
