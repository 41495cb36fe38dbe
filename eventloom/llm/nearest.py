"""Nearest record in time per entity, through a learned index.

Both sides are cut into entity-time shards. A record of the searched side is filed in every shard that
its tolerance touches, so shard edges overlap and each shard can be answered alone. Within a shard the
instants form a sorted array; a piecewise-linear index, fitted with a bounded error, predicts where a
wanted instant falls and a local search of that width finds its exact place.

A hot entity is spread over its time shards, and a shard is read as a sorted stream in bounded chunks,
so no task ever holds a whole entity or a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_HOUR_US = 30 * 60 * 1_000_000
SHARD_US = 6 * 3600 * 1_000_000
EPSILON = 16
CHUNK_ROWS = 400_000


class LearnedIndex:
    """Piecewise-linear position model over sorted groups laid end to end.

    keys: ascending inside each group; starts: first position of each group, and the total at the end.
    Every key's predicted position is within ``epsilon`` of its true one: a piece whose line, drawn
    through its first and last key, misses any key by more is halved until none does.
    """

    def __init__(self, keys: np.ndarray, starts: np.ndarray, epsilon: int = EPSILON, piece: int = 1024):
        self.keys, self.starts, self.epsilon = keys, starts, epsilon
        first = [np.arange(a, b, piece) for a, b in zip(starts[:-1], starts[1:]) if b > a]
        at = np.concatenate(first) if first else np.zeros(0, np.int64)
        ends_of_group = starts[1:][np.searchsorted(starts, at, "right") - 1]
        end = np.minimum(at + piece, ends_of_group)
        done_at, done_end, done_slope = [], [], []
        while len(at):
            span = (keys[end - 1] - keys[at]).astype(np.float64)
            slope = np.where(span > 0, (end - 1 - at) / np.where(span > 0, span, 1.0), 0.0)
            size = end - at
            head = np.repeat(at, size)
            offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            miss = np.abs((keys[head + offset] - keys[head]) * np.repeat(slope, size) - offset)
            worst = np.maximum.reduceat(miss, np.cumsum(size) - size)
            good = (worst <= epsilon) | (size <= 2)
            done_at.append(at[good]), done_end.append(end[good]), done_slope.append(slope[good])
            at, end = at[~good], end[~good]
            mid = (at + end) // 2
            at, end = np.concatenate([at, mid]), np.concatenate([mid, end])
        self.at = np.concatenate(done_at) if done_at else np.zeros(0, np.int64)
        self.end = np.concatenate(done_end) if done_end else np.zeros(0, np.int64)
        self.slope = np.concatenate(done_slope) if done_slope else np.zeros(0)
        order = np.argsort(self.at, kind="stable")
        self.at, self.end, self.slope = self.at[order], self.end[order], self.slope[order]
        self.first_key = keys[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.piece_starts = np.searchsorted(self.at, starts)

    @staticmethod
    def _bisect(values: np.ndarray, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
        """Per row, the first place in values[lo:hi] whose value is not before (right: is after) the wanted one."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            v = values[np.minimum(mid, len(values) - 1)]
            step = open_ & ((v <= wanted) if right else (v < wanted))
            lo = np.where(step, mid + 1, lo)
            hi = np.where(open_ & ~step, mid, hi)

    def lower_bound(self, group: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Position, within its group's range, of the first key that is not before each wanted one."""
        if not len(self.at):
            return self.starts[group]
        piece = self._bisect(self.first_key, wanted, self.piece_starts[group], self.piece_starts[group + 1], True) - 1
        inside = piece >= self.piece_starts[group]
        p = np.where(inside, piece, 0)
        guess = self.at[p] + np.minimum((wanted - self.first_key[p]) * self.slope[p], (self.end - self.at)[p])
        lo = np.clip(np.floor(guess).astype(np.int64) - self.epsilon - 1, self.at[p], self.end[p])
        hi = np.clip(np.ceil(guess).astype(np.int64) + self.epsilon + 2, self.at[p], self.end[p])
        found = self._bisect(self.keys, wanted, lo, hi, False)
        return np.where(inside, found, self.starts[group])


def _answer(group: np.ndarray, ts: np.ndarray, role: np.ndarray, ident: np.ndarray, tolerance: int, epsilon: int):
    """(target id, record id) over rows ordered by group, instant, role, id; role 0 is the searched side."""
    is_rec, is_want = role == 0, role == 1
    rg, rt, ri = group[is_rec], ts[is_rec], ident[is_rec]
    if len(rt):
        keep = np.r_[True, (rg[1:] != rg[:-1]) | (rt[1:] != rt[:-1])]
        rg, rt, ri = rg[keep], rt[keep], ri[keep]
    wg, wt, wi = group[is_want], ts[is_want], ident[is_want]
    if not len(wt) or not len(rt):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.searchsorted(rg, np.arange(int(group[-1]) + 2))
    index = LearnedIndex(rt, starts, epsilon)
    after = index.lower_bound(wg, wt)
    before = after - 1
    far = np.int64(2**62)
    last = len(rt) - 1
    d_after = np.where(after < starts[wg + 1], rt[np.minimum(after, last)] - wt, far)
    d_before = np.where(before >= starts[wg], wt - rt[np.maximum(before, 0)], far)
    best = np.where(d_before <= d_after, before, after)
    ok = np.minimum(d_before, d_after) <= tolerance
    return wi[ok], ri[best[ok]]


def _matcher(tolerance: int, epsilon: int, chunk_rows: int):
    names = ["entity", "shard", "ts", "role", "ident"]
    out = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def emit(tab: pa.Table, final: bool):
            """Answers what can be answered; returns the rows that must wait for more."""
            tab = tab.combine_chunks()
            n = tab.num_rows
            if n == 0:
                return None, tab
            code = tab["entity"].combine_chunks().dictionary_encode()
            ent = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
            shard, ts, role, ident = (tab[c].to_numpy() for c in names[1:])
            new = np.r_[True, (ent[1:] != ent[:-1]) | (shard[1:] != shard[:-1])]
            group = np.cumsum(new) - 1
            wait = np.zeros(n, bool)
            ask = role == 1
            if not final:
                tail = group == group[-1]
                unsure = tail & ask & (ts > ts[-1] - tolerance - 1)
                ask &= ~unsure
                since = (ts[unsure].min() if unsure.any() else ts[-1]) - tolerance
                wait = unsure | (tail & (role == 0) & (ts >= since))
            use = ask | (role == 0)
            got = _answer(group[use], ts[use], role[use], ident[use], tolerance, epsilon)
            res = pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], schema=out) if len(got[0]) else None
            return res, tab.filter(pa.array(wait))

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= chunk_rows:
                res, rest = emit(pa.concat_tables(held), False)
                held, rows = [rest], 0
                if res is not None:
                    yield res
        if held:
            res, _ = emit(pa.concat_tables(held), True)
            if res is not None:
                yield res

    return run


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_entity: Column,
    left_time: Column,
    left_id: Column,
    right_entity: Column,
    right_time: Column,
    right_id: Column,
    tolerance_us: int = HALF_HOUR_US,
    shard_us: int = SHARD_US,
    epsilon: int = EPSILON,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(left_id, right_id): for each left record the right record of its entity nearest in time.

    Of two equally near the earlier counts, of several at one instant the one with the smallest id; the
    tolerance is inclusive. Rows without entity, time or id take no part on either side; a left record
    with nothing in reach is left out; a repeated left row counts once; empty inputs give no rows.
    Only the given expressions are read, so further columns, of whatever name, don't matter.
    """
    if not 0 <= tolerance_us <= shard_us:
        raise ValueError("the tolerance must not exceed the width of a shard")
    us = F.unix_micros
    lt = left.select(left_entity.alias("entity"), us(left_time.cast("timestamp")).alias("ts"), left_id.cast("long").alias("ident")).dropna().distinct()
    rt = right.select(right_entity.alias("entity"), us(right_time.cast("timestamp")).alias("ts"), right_id.cast("long").alias("ident")).dropna()
    part = lambda c: F.floor(c / F.lit(shard_us)).cast("long")
    wants = lt.select("entity", part(F.col("ts")).alias("shard"), "ts", F.lit(1).cast("byte").alias("role"), "ident")
    a, b = part(F.col("ts") - tolerance_us), part(F.col("ts") + tolerance_us)
    have = rt.select("entity", F.explode(F.sequence(a, b)).alias("shard"), "ts", F.lit(0).cast("byte").alias("role"), "ident")
    rows = have.unionByName(wants).repartition("entity", "shard").sortWithinPartitions("entity", "shard", "ts", "role", "ident")
    return rows.mapInArrow(_matcher(tolerance_us, epsilon, chunk_rows), "left_id long, right_id long")
