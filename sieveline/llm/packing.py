"""Best-fit packing of whole tokenized documents with dominance reduction.

The plan is made for lengths, not for documents: there are at most ``capacity`` different lengths,
so the histogram, the reduction, the best-fit pass and the resulting runs have a size bound that
does not depend on the number of documents. Documents get their place by their rank in a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_text, saved
from .tokens import encoder

PIECES = "doc long, piece int, start long, length long, ids_crc32 long, part int, nth long"


@dataclass(frozen=True)
class Bins:
    """``count`` equal sequences, each holding ``items`` as (length, how many)."""

    items: tuple[tuple[int, int], ...]
    count: int


def _fitting(lengths: list[int], left: dict[int, int], room: int, taken: tuple[int, ...]) -> int:
    """Largest length of at most ``room`` of which a copy is left beside those taken; 0 if none."""
    at = bisect_right(lengths, room) - 1
    while at >= 0:
        if left[lengths[at]] > taken.count(lengths[at]):
            return lengths[at]
        at -= 1
    return 0


def _smallest(lengths: list[int], left: dict[int, int], without: int, n: int) -> list[int]:
    """The ``n`` smallest lengths, with repeats, beside one copy of ``without``."""
    out: list[int] = []
    for length in lengths:
        out += [length] * min(n - len(out), left[length] - (length == without))
        if len(out) >= n:
            break
    return out


def _dominant(lengths: list[int], left: dict[int, int], capacity: int, j: int) -> tuple[int, ...] | None:
    """Up to three items with ``j`` that dominate every other feasible set with ``j``.

    One set dominates another if the other's items can be dealt to the items of the first so that
    no item gets more than its own length; then some best packing has the first set as a sequence.
    """
    room = capacity - j
    few = _smallest(lengths, left, j, 3)
    if not few or few[0] > room:
        return (j,)
    k = _fitting(lengths, left, room, (j,))
    if k == room or len(few) < 2 or few[0] + few[1] > room:
        return (j, k)
    if len(few) > 2 and sum(few) <= room:
        return None  # three more items fit: too many sets to compare with
    b = _fitting(lengths, left, room - k, (j, k))
    for small in lengths:  # pairs (big, small) that fit neither item for item nor together into k
        if 2 * small > room:
            break
        if small > b and left[small] > (small == j):
            big = _fitting(lengths, left, room - small, (j, small))
            if big >= small and big + small > k:
                return None
    return (j, k, b) if b else (j, k)


def reduce_lengths(counts: dict[int, int], capacity: int) -> tuple[list[Bins], dict[int, int]]:
    """Fix dominating sets of up to three items for good; the second result is what remains."""
    left = {length: n for length, n in counts.items() if n}
    fixed: list[Bins] = []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                lengths = sorted(left)
                found = _dominant(lengths, left, capacity, j)
                if found is None:
                    break
                items = tuple((length, found.count(length)) for length in sorted(set(found), reverse=True))
                # The set stays dominating while copies of its items are left.
                n = min(left[length] // each for length, each in items)
                fixed.append(Bins(items, n))
                for length, each in items:
                    left[length] -= n * each
                    if not left[length]:
                        del left[length]
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Best-fit decreasing over groups of equal sequences: the tightest group takes items first."""
    open_bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    done: list[Bins] = []

    def put(room: int, items: tuple[tuple[int, int], ...], n: int) -> None:
        if n:
            open_bins.setdefault(room, []).append((items, n)) if room else done.append(Bins(items, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in open_bins if r >= length), default=0)
            if room:
                items, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            else:
                room, items, bins = capacity, (), -(-n // (capacity // length))
            each = room // length
            full = min(bins, n // each)
            rest = n - full * each if full < bins else 0
            put(room - each * length, (*items, (length, each)), full)
            if rest:
                put(room - rest * length, (*items, (length, rest)), 1)
            put(room, items, bins - full - bool(rest))
            n -= full * each + rest
    return done + [Bins(items, n) for groups in open_bins.values() for items, n in groups]


def plan_bins(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Sequences for a histogram of lengths (1 to ``capacity``)."""
    fixed, left = reduce_lengths(counts, capacity)
    return fixed + best_fit(left, capacity)


def runs_of(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): ranks in a row sit in sequences in a row."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for group in bins:
        offset = 0
        for length, each in group.items:
            for _ in range(each):
                rows.append((length, rank.get(length, 0), sequence, offset))
                rank[length] = rank.get(length, 0) + group.count
                offset += length
        sequence += group.count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _pieces(path: str, end_id: int, capacity: int):
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            docs, texts = batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1))
            for doc, found in zip(docs, encode(texts), strict=True):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(min(first, len(ids)), len(ids) + 1, capacity)]
                for piece, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append(
                        (doc, piece, low, high - low, zlib.crc32(ids[low:high].tobytes()), part, int(met[high - low]))
                    )
                    met[high - low] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [field.split()[0] for field in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return cut_up


def token_pieces(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of at most ``capacity`` ids, numbered within (task, length)."""
    return keyed_text(docs, id_col, text_col).mapInArrow(_pieces(path, end_id, capacity), PIECES)


def _place(runs: np.ndarray, span: int):
    keys = runs[:, 0] * span + runs[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            run = runs[np.searchsorted(keys, length * span + rank, side="right") - 1] if len(rank) else runs[:0]
            sequence = run[:, 2] + rank - run[:, 1]
            kept = [batch.column(n) for n in ("doc", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence, pa.int64()), pa.array(run[:, 3], pa.int64())],
                ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return look_up


def pack_documents(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
) -> DataFrame:
    """Place every token of every document in sequences of at most ``capacity`` ids.

    A document (null text: empty) is its ids and then ``end_id``; only one longer than ``capacity``
    is cut, and then its first piece may be shorter. Rows with an equal or null id are packed like
    any others. Other columns are not read. An empty table gives no rows.

    Returns: doc, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = saved(token_pieces(docs, path, id_col, text_col, end_id, capacity))
    counts = saved(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    # At most one row for each possible length comes to the driver.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = runs_of(plan_bins(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    span = max(histogram.values(), default=0) + 1
    return ranked.select("doc", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(runs, span),
        "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
