"""Token counts that follow edits without encoding whole texts again.

A text is kept as a segment tree: its leaves are runs of pre-token pieces with their characters and
tokens, every node has the sums of its two children. An edit finds its leaves by their character sums,
and encodes only those and one leaf on either side, whose outer borders it leaves as they are; then it
updates the sums above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, saved
from .tokens import PieceEncoder, encoder

PIECES = 64  # pieces in a leaf
TREE = "n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"


def leaves_of(texts: list[str], pieces: PieceEncoder) -> list[tuple[np.ndarray, np.ndarray]]:
    """(characters, tokens) of the leaves of each text."""
    chars, tokens, counts = pieces.piece_counts(texts)
    each = -(-counts // PIECES)
    if not each.sum():
        return [(chars, tokens)] * len(texts)
    first = np.repeat(np.cumsum(counts) - counts, each)
    starts = first + PIECES * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
    cuts = np.cumsum(each)[:-1]
    return list(
        zip(np.split(np.add.reduceat(chars, starts), cuts), np.split(np.add.reduceat(tokens, starts), cuts), strict=True)
    )


class TokenTree:
    """A text with its segment tree, built from leaves counted before or now."""

    def __init__(self, text: str, pieces: PieceEncoder, chars=None, tokens=None) -> None:
        self.pieces = pieces
        if chars is None:
            chars, tokens = leaves_of([text], pieces)[0]
        ends = np.cumsum(chars)
        self.leaves = [text[end - n : end] for end, n in zip(ends.tolist(), np.asarray(chars).tolist(), strict=True)] or [""]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        #: Row k has the sums of node k; its children are 2k and 2k + 1, the leaves start at ``width``.
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(chars), 0] = chars
        self.sums[self.width : self.width + len(chars), 1] = tokens
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2
        #: Characters encoded for edits so far.
        self.encoded = 0

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, places: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The filled leaves that hold some characters; the last one for the text's end."""
        filled = np.flatnonzero(self.sums[self.width : self.width + len(self.leaves), 0])
        if not len(filled):
            return np.zeros(len(places), np.int64)
        return filled[np.maximum(np.searchsorted(firsts[filled], places, side="right") - 1, 0)]

    def _filled(self, leaf: int, step: int) -> int:
        """The next leaf with characters in a direction, or ``leaf`` if there is none."""
        at = leaf + step
        while 0 <= at < len(self.leaves):
            if self.leaves[at]:
                return at
            at += step
        return leaf

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, *edits: tuple[int, int, str]) -> None:
        """Put each ``new`` in place of the characters [start, stop); edits do not overlap.

        Edits whose leaves meet are encoded together.
        """
        regions: list[list] = []
        edits = tuple(sorted(edits))
        chars = self.sums[self.width : self.width + len(self.leaves), 0]
        firsts = np.cumsum(chars) - chars
        lows = self._find(np.array([e[0] for e in edits], np.int64), firsts).tolist()
        highs = self._find(np.array([max(e[0], e[1] - 1) for e in edits], np.int64), firsts).tolist()
        for edit, low, high in zip(edits, lows, highs, strict=True):
            before, after = self._filled(low, -1), self._filled(high, 1)
            if regions and before <= regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], after)
            else:
                regions.append([before, after, int(firsts[before]), []])
            regions[-1][3].append(edit)
        for before, after, first, own in regions:
            old, parts, at = "".join(self.leaves[before : after + 1]), [], first
            for start, stop, new in own:
                parts += [old[at - first : start - first], new]
                at = stop
            region = "".join([*parts, old[at - first :]])
            tokens = int(self.pieces.piece_counts([region])[1].sum())
            self.encoded += len(region)
            for leaf in range(before, after + 1):
                if self.leaves[leaf]:
                    self.leaves[leaf] = ""
                    self._set(leaf, 0, 0)
            self.leaves[before] = region
            self._set(before, len(region), tokens)


# Addresses, numbers and keys that a corpus should not hold, and runs of marks: what a redaction
# takes out, with what it puts in their place.
_ADDRESS = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}")
_NUMBER = re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b")
_KEY = re.compile(r"\b[0-9a-f]{24,}\b")
_MARKS = re.compile(r"[#*$%&|!]{2,}")
_DIGIT = re.compile(r"\d")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, new) of the edits that clean a text, in ascending order and without overlaps."""
    # Cheap looks first: most texts have no address, number or long word.
    found = [(m.start(), m.end(), "MAIL") for m in _ADDRESS.finditer(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "IP") for m in _NUMBER.finditer(text)]
    if max(map(len, text.split()), default=0) >= 24:
        found += [(m.start(), m.end(), "KEY") for m in _KEY.finditer(text)]
    found += [(m.start(), m.end(), "") for m in _MARKS.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for one in sorted(found):
        if not out or one[0] >= out[-1][1]:
            out.append(one)
    return out


def _trees(path: str):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        for part in parts:
            leaves = leaves_of([t or "" for t in part.column("body").to_pylist()], pieces)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc"), part.column("mark"), pa.array([int(t.sum()) for _, t in leaves], pa.int64()),
                    pa.array([c.astype(np.int32) for c, _ in leaves], kind), pa.array([t.astype(np.int32) for _, t in leaves], kind),
                ],
                ["doc", "mark", "n_tokens", "leaf_chars", "leaf_tokens"],
            )

    return rows


def _redacted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("new", pa.string())]))
    for part in parts:
        edits = [redactions(t.as_py() or "") for t in part.column("body")]
        some = pa.array([n for n, e in enumerate(edits) if e], pa.int64())
        listed = pa.array([[dict(zip(("start", "stop", "new"), e, strict=True)) for e in one] for one in edits if one], kind)
        kept = part.take(some)
        yield pa.RecordBatch.from_arrays([*kept.columns, listed], ["doc", "mark", "body", "edits"])


def _recounted(path: str):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        for part in parts:
            out = []
            for row in part.to_pylist():
                tree = TokenTree(row["body"] or "", pieces, np.array(row["leaf_chars"], np.int64), np.array(row["leaf_tokens"], np.int64))
                tree.edit(*[(e["start"], e["stop"], e["new"]) for e in row["edits"]])
                out.append((row["doc"], row["mark"], len(row["edits"]), tree.n_tokens, tree.encoded))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)],
                ["doc", "mark", "n_edits", "n_after", "chars_encoded"],
            )

    return rows


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed_text(docs, id_col, text_col).select(
        F.coalesce(F.col("doc").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("body").alias("mark"), "body"
    )


def token_trees(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, n_tokens, leaf_chars, leaf_tokens): the leaves of every text; its tree follows from them.

    ``mark`` is the hash of the text, null ids are the least long. A null text is empty and has no leaf.
    """
    return _keyed(docs, id_col, text_col).mapInArrow(_trees(path), f"doc long, mark long, {TREE}")


def recount(edited: DataFrame, path: str) -> DataFrame:
    """(doc, mark, n_edits, n_after, chars_encoded) of rows (doc, mark, body, leaves, edits).

    Edits are (start, stop, new) in characters of the text as it was; they do not overlap.
    """
    return edited.mapInArrow(_recounted(path), "doc long, mark long, n_edits long, n_after long, chars_encoded long")


def count_redacted(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_tokens, n_edits, n_after, chars_encoded): tokens of every text before and after redaction.

    Only texts that are edited are read again, and only what their edits touch is encoded again. Repeated
    rows are counted each; null ids stay null; empty texts have no tokens. Other columns are not read.
    """
    keyed = _keyed(docs, id_col, text_col)
    trees = saved(token_trees(docs, path, id_col, text_col))
    edits = keyed.mapInArrow(
        _redacted, "doc long, mark long, body string, edits array<struct<start:int,stop:int,new:string>>"
    )
    once = trees.dropDuplicates(["doc", "mark"]).select("doc", "mark", "leaf_chars", "leaf_tokens")
    counted = recount(edits.join(once, ["doc", "mark"]), path).dropDuplicates(["doc", "mark"])
    return trees.select("doc", "mark", "n_tokens").join(counted, ["doc", "mark"], "left").select(
        F.nullif("doc", F.lit(-(1 << 63))).alias("doc"), "n_tokens", F.coalesce("n_edits", F.lit(0)).alias("n_edits"),
        F.coalesce("n_after", "n_tokens").alias("n_after"), F.coalesce("chars_encoded", F.lit(0)).alias("chars_encoded"),
    )
