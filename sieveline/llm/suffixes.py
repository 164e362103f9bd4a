"""Exact removal of repeated byte strings by sparse suffix buckets that are refined by later offsets.

Of the suffixes of a text only some need a bucket: in every ``length``-byte string the one that starts
with the least-hashed q-gram (its anchor). Equal strings have their anchors at equal offsets, so they
meet in the bucket of that anchor. A bucket starts as that of the q-gram and is refined by the
identifiers of the buckets at later offsets; each doubling reuses the identifiers made before, until a
bucket stands for a string over half as long as the ones looked for. Buckets with one suffix are
done. Where all members of a bucket continue alike, all their strings are repeated; only in the others
are the strings compared one start at a time. Identifiers are hashes of what they stand for, so that
every task makes the same ones; two independent 64-bit hashes tell strings apart. Before single starts
are compared, cells of neighbouring starts are refined by the bytes all of their strings hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keyed_text, saved

_STEPS = 3  # doublings from the q-gram to the bucket's string
CELL = 16  # neighbouring starts that are looked at together
_SLICE = 1 << 22
_POSITION = np.uint64((1 << 24) - 1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int, made: dict = {}) -> np.ndarray:  # noqa: B006 - kept on purpose
    if base not in made or len(made[base]) < n:
        out = np.full(max(n, 1 << 16), np.uint64(base))
        out[0] = 1
        made[base] = np.multiply.accumulate(out)
    return made[base][:n]


class Prefixes:
    """Hashes of any byte ranges of one array, from prefix sums of byte values times powers."""

    def __init__(self, raw: np.ndarray, which: int) -> None:
        base = _BASES[which] | 1
        values = np.random.default_rng(991 + which).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.sums = np.empty(len(raw) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values[raw] * _powers(base, len(raw)), out=self.sums[1:])
        self.back = _powers(pow(base, -1, 1 << 64), len(raw) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def grams(self, q: int) -> np.ndarray:
        """Identifiers of all q-grams."""
        n = max(0, len(self.sums) - q)
        return mixed((self.sums[q : q + n] - self.sums[:n]) * self.back[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring keys: of a block's end and the next one's beginning."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    heads = np.minimum.accumulate(grid, axis=1).ravel()
    tails = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tails[: n - width + 1], heads[width - 1 : n])


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """(text number, offset, bytes) so that every string lies in one slice."""
    for n, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), _SLICE):
            if len(text) >= length:
                yield n, at, text[at : at + _SLICE + length - 1]


def anchored_runs(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """``_anchored`` over the slices of the texts, a few at a time.

    Ties between equal q-grams go to the leftmost by a position in the slices taken together, which has
    24 bits; so these hold about one full slice, and a text of any size is anchored like its copies in
    little memory.
    """
    taken: list[dict[str, np.ndarray]] = []
    held, n = [], 0
    for piece in _slices(texts, length):
        if held and n + len(piece[2]) > _SLICE + length:
            taken.append(_anchored(held, length))
            held, n = [], 0
        held.append(piece)
        n += len(piece[2])
    taken.append(_anchored(held, length))
    if len(taken) == 1:
        return taken[0]
    return {name: np.concatenate([t.pop(name) for t in taken]) for name in list(taken[0])}


def _anchored(part: list[tuple[int, int, bytes]], length: int) -> dict[str, np.ndarray]:
    """Runs of string starts with one anchor: text, bucket, side, anchor, near, far, whole.

    The starts are anchor - far to anchor - near. ``side`` 0 has the strings with more of their bytes
    after the anchor, 1 the others; ``bucket`` stands for bytes that all of the run's strings hold, and
    ``whole`` for all bytes of all of them.
    """
    # So that every string holds the bucket's bytes after its anchor, or before it, or both.
    q = (length + 1) // ((2 << _STEPS) - 1)
    size, width = q << _STEPS, length - q + 1
    names = ("text", "bucket", "side", "anchor", "near", "far", "whole")
    if not part:
        return {name: np.zeros(0, np.int64) for name in names}
    raw = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
    sizes = np.array([len(p[2]) for p in part])
    first = np.cumsum(sizes) - sizes
    hashes = Prefixes(raw, 0)
    grams = hashes.grams(q)
    keys = (grams & ~_POSITION) | (np.arange(len(grams), dtype=np.uint64) & _POSITION)
    minima = _window_minima(keys, width)
    usable = np.zeros(len(raw), bool)
    for low, n in zip(first, sizes, strict=True):
        usable[low : low + n - length + 1] = True
    starts = np.flatnonzero(usable[: len(minima)])
    anchors = (minima[starts] & _POSITION).astype(np.int64)
    # The bucket's string starts at the anchor, or ends with the anchor's q-gram where the anchor is
    # far enough from the start for that and too far for the other.
    side = (anchors - starts > length - size).astype(np.int64)
    new = np.flatnonzero((np.diff(anchors, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1) | (np.diff(side, prepend=-1) != 0))
    last = np.append(new[1:], len(starts)) - 1
    anchor, side, low, high = anchors[new], side[new], starts[new], starts[last]
    begin = np.where(side == 1, anchor - (size - q), anchor)
    levels = [grams[begin + k * q] for k in range(1 << _STEPS)]
    while len(levels) > 1:
        levels = [mixed(a * _MIX + b) for a, b in zip(levels[::2], levels[1::2], strict=True)]
    whole = Prefixes(raw, 1)(low, high + length)
    of = np.searchsorted(first, low, side="right") - 1
    shift = np.array([p[1] for p in part])[of] - first[of]
    return {
        "text": np.array([p[0] for p in part])[of], "bucket": levels[0].view(np.int64), "side": side,
        "anchor": anchor + shift, "near": anchor - high, "far": anchor - low, "whole": whole.view(np.int64),
    }


def _batches(texts: list[bytes], size: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    at = held = 0
    for n, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield at, texts[at : n + 1]
            at, held = n + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _bytes(column) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def _runs(length: int):
    kinds = {"bucket": pa.int64(), "side": pa.int32(), "anchor": pa.int64(), "near": pa.int32(), "far": pa.int32(), "whole": pa.int64()}

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at, texts in _batches(_bytes(part.column("body"))):
                found = anchored_runs(texts, length)
                which = pa.array(found["text"] + at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(which), part.column("mark").take(which)]
                    + [pa.array(found[name]).cast(kind) for name, kind in kinds.items()],
                    ["doc", "mark", *kinds],
                )

    return rows


def _cells(length: int):
    """A row for each cell of the runs asked for.

    A cell is ``CELL`` neighbouring starts. ``core`` stands for the bytes that all of its strings hold;
    ``edge`` has the bytes on either side of them, so the string that starts ``j`` bytes before the core
    is told from the others of the cell by the CELL - 1 bytes of the edge from CELL - 1 - j on.
    """
    side_bytes = CELL - 1

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            docs, marks, asked = (part.column(n).to_pylist() for n in ("doc", "mark", "asked"))
            for doc, mark, text, runs in zip(docs, marks, part.column("body"), asked, strict=True):
                raw = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                hashes = Prefixes(raw, 1)
                bucket, side, anchor, near, far, n = (
                    np.array([r[c] for r in runs], np.int64) for c in ("bucket", "side", "anchor", "near", "far", "n")
                )
                each = far // CELL - near // CELL + 1
                k = np.repeat(np.arange(len(each)), each)
                grid = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + near[k] // CELL) * CELL
                low, high = np.maximum(near[k] - grid, 0), np.minimum(far[k] - grid, side_bytes)
                base = anchor[k] - grid
                core = hashes(base, base + length - side_bytes)
                cell = mixed(bucket[k].view(np.uint64) + _MIX * (2 * grid + side[k]).astype(np.uint64))
                padded = np.concatenate([np.zeros(CELL, np.uint8), raw, np.zeros(CELL, np.uint8)])
                at = np.arange(side_bytes)
                left = padded[(base + CELL - side_bytes)[:, None] + at]
                left[at[None, :] < (side_bytes - high)[:, None]] = 0
                right = padded[(base + CELL + length - side_bytes)[:, None] + at]
                right[at[None, :] >= (side_bytes - low)[:, None]] = 0
                edge = np.ascontiguousarray(np.concatenate([left, right], axis=1))
                offsets = np.arange(len(k) + 1, dtype=np.int32) * edge.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc] * len(k), pa.int64()), pa.array(np.full(len(k), mark)), pa.array(base),
                        pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(n[k]),
                        pa.array(cell.view(np.int64)), pa.array(core.view(np.int64)),
                        pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(edge)]),
                    ],
                    ["doc", "mark", "base", "low", "high", "n", "cell", "core", "edge"],
                )

    return rows


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; touching runs are one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _cleaned(length: int):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for doc, text, low, high in zip(
                part.column("doc").to_pylist(), part.column("body"),
                part.column("low").to_pylist(), part.column("high").to_pylist(), strict=True,
            ):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = merged([(a, b + length) for a, b in zip(low or [], high or [], strict=True)])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((doc, len(raw), sum(b - a for a, b in spans), spans, digest.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.string())
            columns[3] = [[{"low": a, "high": b} for a, b in spans] for spans in columns[3]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc", "n_bytes", "n_removed", "spans", "kept_sha256"],
            )

    return rows


def repeated_starts(keyed: DataFrame, length: int) -> DataFrame:
    """(doc, mark, low, high): ranges of starts whose string starts anywhere else too."""
    runs = saved(
        keyed.mapInArrow(
            _runs(length),
            "doc long, mark long, bucket long, side int, anchor long, near int, far int, whole long",
        )
    )
    kind = F.xxhash64("near", "far", "whole")
    # Written, so that both sides of the join are plain shuffles and a hot bucket can be split.
    shared = saved(
        runs.groupBy("bucket", "side")
        .agg(F.count("*").alias("members"), F.min(kind).alias("least"), F.max(kind).alias("most"))
        .where("members > 1")
        .select("bucket", "side", (F.col("least") == F.col("most")).alias("alike"))
    )
    met = saved(runs.join(shared, ["bucket", "side"]))
    discard(runs, shared)
    alike = met.where("alike").select("doc", "mark", "anchor", "near", "far")
    group = ["bucket", "side", "near", "far", "whole"]
    # Of runs with the same bytes one is asked, with the number of them as weight.
    classes = saved(
        met.where("not alike").groupBy(*group).agg(
            F.count("*").alias("n"), F.min(F.struct("doc", "mark", "anchor")).alias("one")
        )
    )
    several = met.where("not alike").join(classes.where("n > 1").select(*group), group, "left_semi")
    asked = classes.select(
        "one.doc", "one.mark", F.struct("bucket", "side", "one.anchor", "near", "far", "n").alias("run")
    )
    cells = saved(
        # A repeated row is asked twice, but its runs have a weight of two or more anyway.
        keyed.where(F.length("body") > 0)
        .join(asked.groupBy("doc", "mark").agg(F.collect_list("run").alias("asked")), ["doc", "mark"])
        .mapInArrow(
            _cells(length),
            "doc long, mark long, base long, low int, high int, n long, cell long, core long, edge binary",
        )
    )
    kinds = saved(cells.groupBy("cell", "core", "low", "high", "edge").agg(F.sum("n").alias("n")))
    single = cells.where("n = 1")
    sure = single.join(kinds.where("n > 1").drop("n"), ["cell", "core", "low", "high", "edge"], "left_semi")
    # Where cells with one core differ at their edges, their strings are compared one by one.
    mixed_cores = saved(
        kinds.groupBy("cell", "core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("cell", "core")
    )

    def strings(df: DataFrame, *columns: str) -> DataFrame:
        piece = F.expr(f"substring(edge, {CELL} - j, {CELL - 1})")
        return (
            df.join(mixed_cores, ["cell", "core"], "left_semi")
            .select(*columns, "cell", "core", "edge", F.explode(F.sequence("low", "high")).alias("j"))
            .select(*columns, "cell", "core", "j", piece.alias("piece"))
        )

    string = ["cell", "core", "j", "piece"]
    twice = saved(strings(kinds, "n").groupBy(*string).agg(F.sum("n").alias("n")).where("n > 1").select(*string))
    lone = single.join(kinds.where("n = 1").drop("n"), ["cell", "core", "low", "high", "edge"], "left_semi")
    found = strings(lone, "doc", "mark", "base").join(twice, string, "left_semi")

    def ranges(df: DataFrame, low, high) -> DataFrame:
        return df.select("doc", "mark", low.alias("low"), high.alias("high"))

    anchor, base = F.col("anchor"), F.col("base")
    return (
        ranges(alike, anchor - F.col("far"), anchor - F.col("near"))
        .union(ranges(several, anchor - F.col("far"), anchor - F.col("near")))
        .union(ranges(sure, base - F.col("high"), base - F.col("low")))
        .union(ranges(found, base - F.col("j"), base - F.col("j")))
    )


def remove_repeats(
    docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc, n_bytes, n_removed, spans, kept_sha256) for every row.

    A byte goes if a string of ``length`` bytes that covers it starts at two or more places of the
    whole table, in the text as given; strings do not cross texts. A null text is empty; a text under
    ``length`` bytes keeps all. Repeated rows are places of their own, so both lose what they share.
    Rows with a null id are handled like others. Other columns are not read.
    """
    if length < 2 * CELL:
        raise ValueError(f"strings of at least {2 * CELL} bytes can be looked for")
    no_id = F.lit(-(1 << 63)).cast("long")
    keyed = keyed_text(docs, id_col, text_col).select(
        F.coalesce(F.col("doc").cast("long"), no_id).alias("doc"), F.xxhash64("body").alias("mark"), "body"
    )
    ranges = repeated_starts(keyed, length)
    # Repeated rows have equal ranges, and each row gets them once.
    gathered = ranges.groupBy("doc", "mark").agg(F.collect_set(F.struct("low", "high")).alias("found")).select(
        "doc", "mark", F.col("found.low").alias("low"), F.col("found.high").alias("high")
    )
    cleaned = keyed.join(gathered, ["doc", "mark"], "left").mapInArrow(
        _cleaned(length),
        "doc long, n_bytes long, n_removed long, spans array<struct<low:long,high:long>>, kept_sha256 string",
    )
    return cleaned.withColumn("doc", F.nullif("doc", no_id))
