"""Per-run ordered processing of a sample stream.

``lag`` is not available on streams, so each run keeps the few samples its look-back
needs.  Runs are cut into (run, segment), as in the batch windows, and the state of a
finished segment is dropped.  Python is called once per bucket of segments, not once
per run, and works on whole arrays: calls cost milliseconds, whatever they hold.
Samples that arrive early wait until their predecessor has come; with a watermark, a
gap that stays open too long is skipped and what comes after it is released."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runloom.operators.segments import SEG, SEGMENT_ROWS

STATE = "held binary"
#: groups that the segments of a stream are dealt to; fixed when the stream first starts
BUCKETS = 512
BUCKET = "_bucket"
Block = Callable[..., dict[str, np.ndarray]]


def _pack(parts: Sequence[np.ndarray]) -> bytes:
    """Entries (four whole numbers each), then history and waiting rows (entry, position, values)."""
    sizes = np.array([len(p) for p in parts], np.int64)
    return b"".join([sizes.tobytes(), *(np.ascontiguousarray(p).tobytes() for p in parts)])


def _unpack(held: bytes, k: int) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(held, np.int64, 7), 56, []
    for n, (kind, shape) in zip(sizes, [(np.int64, (-1, 4)), *[(np.int64, (-1,)), (np.int64, (-1,)), (float, (-1, k))] * 2]):
        width = 8 * int(n) * (shape[1] if len(shape) > 1 else 1)
        out.append(np.frombuffer(held[at : at + width], kind).reshape(int(n), *shape[1:]))
        at += width
    return out


def _begins(ids: np.ndarray) -> np.ndarray:
    """For each row of sorted ``ids`` the first row of its id."""
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))


def ordered_stream(
    stream: DataFrame,
    values: Sequence[str],
    back: int,
    block: Block,
    output: str,
    size: int = SEGMENT_ROWS,
    start: int = 0,
    time: str | None = None,
    wait: str = "10 minutes",
    many: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Each sample once, in run order, with the columns ``block`` adds.

    ``block(positions, table)`` sees the history (at most ``back`` rows) of a run followed
    by its new rows and returns one array per output column for all of them.  With
    ``many`` it is ``block(positions, table, begins)`` and sees many runs one after the
    other; ``begins`` is the row at which each row's run begins.  ``start`` is
    the first position of every run.  ``time`` names an event-time column: a gap is
    then given up once the watermark has passed it by ``wait``, and the state of a segment
    is dropped once the watermark has passed its last sample and none waits."""
    names = ["sample_idx", *values]
    k = len(values)
    added = [part.split()[0] for part in output.split(",")]

    if time is not None:
        # a sample delivered again must not start a finished segment anew
        stream = stream.withWatermark(time, wait).dropDuplicatesWithinWatermark(["run_id", "sample_idx"])
    pos = F.col("sample_idx").cast("long")
    spread = F.sequence(F.floor(pos / F.lit(size)), F.floor((pos + back) / F.lit(size)))
    keyed = stream.select("run_id", *names, *([time, F.unix_millis(time).alias("_ms")] if time else []), F.explode(spread).alias(SEG))
    keyed = keyed.withColumn(BUCKET, F.pmod(F.xxhash64("run_id", SEG), F.lit(buckets)).cast("int"))

    def apply(positions: np.ndarray, table: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        if many:
            return block(positions, table, begins)
        ends = [*np.unique(begins), len(table)]
        parts = [block(positions[a:b], table[a:b]) for a, b in zip(ends, ends[1:])]
        return {name: np.concatenate([p[name] for p in parts]) for name in added}

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none, no_rows = np.empty(0, np.int64), np.empty((0, k))
        if state.exists:
            entries, h_of, h_pos, h_val, w_of, w_pos, w_val = _unpack(bytes(state.get[0]), k)
        else:
            entries, h_of, h_pos, h_val, w_of, w_pos, w_val = np.empty((0, 4), np.int64), none, none, no_rows, none, none, no_rows
        came = [] if state.hasTimedOut else [b for b in batches if len(b)]
        column = lambda c: np.concatenate([none, *[b[c].astype("int64").to_numpy() for b in came]])
        f_pos, f_val = column("sample_idx"), np.vstack([no_rows, *[b[list(values)].to_numpy(dtype=float) for b in came]])

        # one id per (run, segment), held or new
        runs, segs = np.concatenate([entries[:, 0], column("run_id")]), np.concatenate([entries[:, 1], column(SEG)])
        order = np.lexsort((segs, runs))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(runs[order]) != 0) | (np.diff(segs[order]) != 0)
        ids = np.empty(len(order), np.int64)
        ids[order] = np.cumsum(new) - 1
        run, seg = runs[order][new], segs[order][new]
        of_entry, f_of = ids[: len(entries)], ids[len(entries) :]
        nxt, due = np.maximum(seg * size - back, start), np.zeros(len(run), np.int64)
        nxt[of_entry], due[of_entry] = entries[:, 2], entries[:, 3]
        h_of, w_of = of_entry[h_of], of_entry[w_of]
        alive, moved = np.ones(len(run), bool), np.zeros(len(run), bool)
        moved[f_of] = True
        mark = 0
        if time is not None:
            mark = max(state.getCurrentWatermarkMs(), 0)
            late, waits = ~moved & (due < mark), np.zeros(len(run), bool)
            waits[w_of] = True
            alive[late & ~waits] = False
            # the gap is given up: on with the first that waits
            skip = late & waits
            first = np.full(len(run), np.iinfo(np.int64).max)
            np.minimum.at(first, w_of, w_pos)
            nxt[skip], moved[skip] = first[skip], True
            seen = np.zeros(len(run), np.int64)
            np.maximum.at(seen, f_of, column("_ms"))
            due[moved] = np.maximum(seen[moved], mark) + 1

        # what waits and what came, each position once
        of, at, table = np.concatenate([w_of, f_of]), np.concatenate([w_pos, f_pos]), np.vstack([w_val, f_val])
        order = np.lexsort((at, of))
        order = order[at[order] >= nxt[of[order]]]
        once = np.ones(len(order), bool)
        once[1:] = (np.diff(of[order]) != 0) | (np.diff(at[order]) != 0)
        order = order[once]
        of, at, table = of[order], at[order], table[order]
        # the part that follows on without a gap
        ready = at == nxt[of] + np.arange(len(of)) - _begins(of)
        w_of, w_pos, w_val = of[~ready], at[~ready], table[~ready]
        if ready.any():
            of, at, table = of[ready], at[ready], table[ready]
            grown = np.bincount(of, minlength=len(run))
            nxt += grown
            past = grown[h_of] > 0
            fresh = np.concatenate([np.zeros(past.sum(), bool), np.ones(len(of), bool)])
            of, at, table = np.concatenate([h_of[past], of]), np.concatenate([h_pos[past], at]), np.vstack([h_val[past], table])
            order = np.lexsort((at, of))
            of, at, table, fresh = of[order], at[order], table[order], fresh[order]
            begins = _begins(of)
            columns = apply(at, table, begins)
            own = fresh & (at // size == seg[of])
            to_end = np.bincount(of, minlength=len(run))[of] - (np.arange(len(of)) - begins)
            keep = to_end <= back
            h_of, h_pos, h_val = np.concatenate([h_of[~past], of[keep]]), np.concatenate([h_pos[~past], at[keep]]), np.vstack([h_val[~past], table[keep]])
            if own.any():
                kept = table[own]
                data = {"run_id": run[of[own]], "sample_idx": at[own], **{v: kept[:, i] for i, v in enumerate(values)}}
                yield pd.DataFrame(data | {name: columns[name][own] for name in added})
        alive &= nxt < (seg + 1) * size
        if not alive.any():
            if state.exists:
                state.remove()
            return
        place = np.cumsum(alive) - 1
        h, w = alive[h_of], alive[w_of]
        entries = np.stack([run, seg, nxt, due], axis=1)[alive]
        state.update((_pack([entries, place[h_of[h]], h_pos[h], h_val[h], place[w_of[w]], w_pos[w], w_val[w]]),))
        if time is not None:
            # fires once the watermark, which lags by ``wait``, has passed the last sample of one
            state.setTimeoutTimestamp(int(max(due[alive].min(), mark + 1)))

    schema = "run_id long, sample_idx long, " + "".join(f"{v} double, " for v in values) + output
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return keyed.groupBy(BUCKET).applyInPandasWithState(step, schema, STATE, "append", timeout)
