"""Bulk-synchronous best-fit packing of token sequences.

Documents are cut to pieces of at most ``capacity`` ids. Pieces of equal length are interchangeable, as are sequences of
equal gaps, so both are handled as runs: a piece is known by its length and its rank among pieces of that length, and the ranks come
from distributed counts. Each round sorts runs of pieces and gaps into ranges of size; a task for each range sweeps it for the
successors of its pieces, the k-th piece of a run going to the k-th sequence of a run of gaps (so conflicts are settled by rank), updates the
gaps, and repeats within the range. What found none goes to the ranges further up, gaps move to the ranges of their new
sizes, and the next round begins; when nothing is placed, sequences are opened, as many as the waiting ids fill. Long
pieces come first, by halves of their length. There are at most ``capacity`` lengths, whatever the number of documents, so a round's
state is some thousands of runs; the placements are looked up by every piece where it lies.

Defined results: null and empty texts are one piece with the end id alone; rows with equal or null ids are packed as
they come, each whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filled, stored, tune
from .tokens import END_ID, default_path, encoder, groups

CAPACITY, RANGES = 2048, 8


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity if there are more."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))] if n > capacity else [(0, n)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece, with its part (task) and its rank there by length."""
    path = path or default_path()
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            doc_ids, texts, rows = batch.column(0).to_pylist(), filled(batch.column(1)).to_pylist(), []
            for lo, hi in groups(texts):
                for doc_id, got in zip(doc_ids[lo:hi], enc.encode(texts[lo:hi])):
                    ids = np.append(np.frombuffer(got, enc.dtype), enc.dtype.type(END_ID)).astype("<u4")
                    for i, (start, length) in enumerate(cuts(len(ids), capacity)):
                        rows.append((doc_id, i, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                        seen[length] += 1
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "in_part"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, in_part long")


@dataclass
class Runs:
    """Placements in order of length and rank: the pieces from ``rank`` on go to sequences from ``sequence`` on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


Run = tuple[int, int, int]  # size, first rank or sequence, how many


def sweep(pieces: list[Run], gaps: list[Run], capacity: int) -> tuple[list[tuple], list[Run], list[Run]]:
    """In order of size, each gap takes at most one piece: the largest open one that it holds, so a piece goes to the next gap up.
    Of two runs that meet, the k-th piece goes to the k-th sequence. Returns placements (length, rank, sequence, offset, n), the
    pieces that found no gap, and the gaps as they are then."""
    placed, made, waiting = [], [], []
    for size, is_gap, first, n in sorted([(s, 0, f, n) for s, f, n in pieces] + [(s, 1, f, n) for s, f, n in gaps]):
        if not is_gap:
            waiting.append([size, first, n])
            continue
        while n and waiting:
            length, rank, left = waiting[-1]
            m = min(n, left)
            placed.append((length, rank, first, capacity - size, m))
            made.append((size - length, first, m))
            waiting[-1][1:] = rank + m, left - m
            if left == m:
                waiting.pop()
            first, n = first + m, n - m
        if n:
            made.append((size, first, n))
    return placed, [tuple(w) for w in waiting], [g for g in made if g[0]]


def _swept_ranges(spark: SparkSession, pieces: list[Run], gaps: list[Run], capacity: int) -> tuple[list[tuple], list[Run], list[Run]]:
    """Sweeps of RANGES ranges of sizes, each in a task of its own, until nothing more fits within a range."""
    width = -(-(capacity + 1) // RANGES)

    names = ["kind", "size", "first", "sequence", "offset", "n"]

    def swept(low: int, runs: list[dict]) -> pa.RecordBatch:
        rows = {k: [(r["size"], r["first"], r["n"]) for r in runs if r["kind"] == k] for k in (0, 1)}
        mine, inside, outside, placed = rows[0], rows[1], [], []
        while True:
            some, mine, made = sweep(mine, inside, capacity)
            inside, outside = [g for g in made if g[0] >= low], outside + [g for g in made if g[0] < low]
            placed += some
            if not some:
                break
        out = [(2, *p) for p in placed] + [(0, s, f, 0, 0, n) for s, f, n in mine] + [(1, s, f, 0, 0, n) for s, f, n in inside + outside]
        columns = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.int64()] * 5])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, runs in zip(*(c.to_pylist() for c in batch.columns)):
                yield swept(at * width, runs)

    ranges: dict[int, list[tuple]] = {}
    for kind, runs in ((0, pieces), (1, gaps)):
        for size, first, n in runs:
            ranges.setdefault(size // width, []).append((kind, size, first, n))
    # a row for each range, so that ranges are dealt to tasks without a shuffle
    state = spark.createDataFrame(sorted(ranges.items()), "range int, runs array<struct<kind:int,size:long,first:long,n:long>>")
    found = state.mapInArrow(run, "kind int, size long, first long, sequence long, offset long, n long").collect()  # runs, some thousands
    placed = [tuple(r)[1:] for r in found if r["kind"] == 2]
    return placed, *([(r["size"], r["first"], r["n"]) for r in found if r["kind"] == k] for k in (0, 1))


def rounds(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY) -> Runs:
    """Bulk-synchronous best fit of runs of pieces; see the module's text."""
    idle: list[Run] = sorted((int(s), 0, int(n)) for s, n in counts.items() if n)
    gaps: list[Run] = []
    placed: list[tuple] = []
    opened = 0
    while idle:
        top = idle[-1][0]
        least = top // 2 if top > capacity // 8 else 0  # long pieces first, the short ones together
        active, idle = [p for p in idle if p[0] >= least], [p for p in idle if p[0] < least]
        n = len(placed)
        if gaps:
            some, active, gaps = _swept_ranges(spark, active, gaps, capacity)
            placed += some
            # what found no gap in its own range goes to ranges further up
            some, active, gaps = sweep(active, gaps, capacity)
            placed += some
        long = [p for p in active if 2 * p[0] > capacity]
        for size, rank, m in long:  # no two of these share a sequence
            placed.append((size, rank, opened, 0, m))
            gaps += [(capacity - size, opened, m)] if size < capacity else []
            opened += m
        active = [p for p in active if 2 * p[0] <= capacity]
        if active and not long and len(placed) == n:
            m = -(-sum(s * k for s, _, k in active) // capacity)
            gaps.append((capacity, opened, m))
            opened += m
        idle = sorted(idle + active)
    columns = np.array(sorted(p[:4] for p in placed), dtype=np.int64).reshape(-1, 4).T
    return Runs(*columns)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places the pieces of a stored table; see ``pieces``."""
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("first"))
    totals = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    runs = rounds(cut.sparkSession, totals, capacity)
    key = (runs.length << 40) + runs.rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            at = np.searchsorted(key, (length << 40) + rank, side="right") - 1
            made = [pa.array(runs.sequence[at] + rank - runs.rank[at]), pa.array(runs.offset[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(firsts, (F.col("length") == F.col("l")) & (F.col("part") == F.col("p")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("in_part")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return place(stored(pieces(docs, path, capacity), "pieces"), capacity)
