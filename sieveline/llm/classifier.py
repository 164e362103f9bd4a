"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by log-count ratios.

Texts are cut into runs of letters, digits and non-ASCII characters, and single other marks. One- and
two-token indicators, and three for a word met again at once, are hashed into ``1 << BITS`` buckets. Each bucket is scaled by the logarithm of
its smoothed document frequency among good texts over that among poor ones, a text is scaled to unit
length, and dual coordinate descent fits the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text
from .shingles import batches

BITS = 18
#: At most so many labelled rows of each class are learned from; they are those with the least hash.
SAMPLE_PER_CLASS = 6000

_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = np.uint64(pow(_P, -1, 1 << 64))
_SPREAD, _SECOND = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_KIND = np.ones(256, np.uint8)  # 0 white space, 1 mark, 2 word
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


def indicators(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts): the different buckets of each text in ascending order, and how many."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = _KIND[raw]
    before = np.concatenate([[np.uint8(0)], kind[:-1]])
    starts = np.flatnonzero((kind == 1) | ((kind == 2) & (before != 2)))
    after = np.concatenate([kind[1:], [np.uint8(0)]])
    ends = np.flatnonzero((kind == 1) | ((kind == 2) & (after != 2))) + 1
    bounds = np.cumsum([len(t) + 1 for t in texts])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    # Hash of a byte range from prefix sums: sum of byte * P^i, shifted back by P^-start.
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(np.uint64(_P), len(raw)))])
    back = _powers(_INVERSE, len(raw))
    tokens = (prefix[ends] - prefix[starts]) * back[starts]
    tokens = (tokens ^ (tokens >> np.uint64(29))) * _SPREAD
    of = np.searchsorted(bounds, starts, side="right")
    same = of[1:] == of[:-1]
    pairs = (tokens[:-1] * _SECOND + tokens[1:])[same]
    pairs = (pairs ^ (pairs >> np.uint64(31))) * _SPREAD
    # A word that follows itself is one indicator whatever the word is; so is one that does so twice,
    # at once or with one token in between.
    word = kind[starts] == 2
    again = same & (tokens[1:] == tokens[:-1]) & word[1:]
    thrice = again[1:] & again[:-1]
    skip = (of[2:] == of[:-2]) & (tokens[2:] == tokens[:-2]) & word[2:]
    skips = skip[2:] & skip[:-2]
    runs = [np.full(met.sum(), np.uint64(n) * _SPREAD) for n, met in enumerate((again, thrice, skips), 1)]
    keys = np.concatenate([tokens, pairs, *runs]) >> np.uint64(64 - bits)
    texts_of = np.concatenate([of, of[:-1][same], of[1:][again], of[2:][thrice], of[4:][skips]])
    keys |= texts_of.astype(np.uint64) << np.uint64(bits)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    counts = np.bincount((keys >> np.uint64(bits)).astype(np.int64), minlength=len(texts))
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int64), counts


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    #: Score of a text on the border between the classes, and how fast scores leave it.
    border: float = 0.3
    slope: float = 4.0

    def scores(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each text; a text without a known bucket gets the bias alone."""
        ends = np.cumsum(counts)

        def total(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(values[buckets])])
            return sums[ends] - sums[ends - counts]

        norms = np.sqrt(np.maximum(total(self.ratios**2), 1e-12))
        margins = total(self.ratios * self.weights) / norms + self.bias
        return 1.0 / (1.0 + (1.0 - self.border) / self.border * np.exp(-self.slope * np.clip(margins, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, bits: int, smoothing: float = 1.0) -> np.ndarray:
    """Per bucket: log of its share among good texts over its share among poor ones; unseen: 0."""
    size = 1 << bits
    counts = [np.zeros(size), np.zeros(size)]
    for buckets, label in zip(rows, good, strict=True):
        counts[int(label)][buckets] += 1
    poor, fine = counts
    n = [max(1, int((~good).sum())), max(1, int(good.sum()))]
    ratios = np.log((smoothing + fine) / (2 * smoothing + n[1])) - np.log((smoothing + poor) / (2 * smoothing + n[0]))
    return np.where(poor + fine > 0, ratios, 0.0)


def dual_coordinate_descent(
    rows: list[np.ndarray], good: np.ndarray, ratios: np.ndarray, cost: float = 4.0, epochs: int = 12, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; both classes get the same total cost.

    A row's values are looked up again in each epoch: held for all rows they take twice what the rows do.
    """
    signs = np.where(good, 1.0, -1.0)
    each = {s: cost * len(rows) / (2 * max(1, int((signs == s).sum()))) for s in (1.0, -1.0)}
    norms, squares = np.empty(len(rows)), np.empty(len(rows))
    for i, buckets in enumerate(rows):
        x = ratios[buckets]
        norms[i] = max(np.sqrt(x @ x), 1e-6)
        x = x / norms[i]
        squares[i] = float(x @ x) + 1.0
    weights, bias = np.zeros(len(ratios)), 0.0
    alphas = np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(rows)):
            buckets, y = rows[i], signs[i]
            x = ratios[buckets] / norms[i]
            gradient = y * (float(weights[buckets] @ x) + bias) - 1.0
            new = min(max(alphas[i] - gradient / squares[i], 0.0), each[y])
            step = (new - alphas[i]) * y
            if step:
                weights[buckets] += step * x
                bias += step
                alphas[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return weights, bias


def fit(rows: list[np.ndarray], good: np.ndarray, bits: int = BITS) -> Model:
    """Without a class there is nothing to tell apart: then every score is 1, or 0, alike."""
    if not len(rows) or good.all() or not good.any():
        return Model(np.zeros(1 << bits), np.zeros(1 << bits), 5.0 if not len(rows) or good.all() else -5.0)
    ratios = log_count_ratios(rows, good, bits)
    return Model(ratios, *dual_coordinate_descent(rows, good, ratios))


def _indicator_rows(bits: int):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            buckets: list[np.ndarray] = []
            for texts in batches(t.as_py() for t in part.column("body")):
                found, counts = indicators(texts, bits)
                buckets += np.split(found.astype(np.int32), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays(
                [part.column("good"), pa.array(buckets, pa.list_(pa.int32()))], ["good", "buckets"]
            )

    return rows


def in_training(doc):
    """True for ids that may be learned from: the CRC-32 of their digits is not divisible by 5."""
    return F.crc32(doc.cast("string").cast("binary")) % 5 != 0


def ordered_rows(found: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """(buckets of each text, whether it is good) in an order that does not depend on the table's.

    The rows are views into the table's own memory.
    """
    rows: list[np.ndarray] = []
    for chunk in found.column("buckets").chunks:
        ends = chunk.offsets.to_numpy()
        rows += np.split(chunk.flatten().to_numpy(), ends[1:-1] - ends[0]) if len(chunk) else []
    good = found.column("good").to_numpy().astype(bool)
    size = lambda i: (good[i], len(rows[i]))
    alike = groupby(sorted(range(len(rows)), key=size), size)
    order = [i for _, same in alike for i in sorted(same, key=lambda i: rows[i].tobytes())]
    return [rows[i] for i in order], good[order] if order else good


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_class: int = SAMPLE_PER_CLASS,
    bits: int = BITS,
) -> Model:
    """A model from at most ``per_class`` labelled texts of each class.

    ``labels`` has doc_id and quality; null labels and ids, and the ids that are held out, are not
    used; with several labels of an id the lowest counts. Only the sample's ids (bounded) are sent to
    the executors, and only its indicators, of at most ``1 << bits`` numbers a text, to the driver.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(
        (F.min("quality") != 0).alias("good")
    )
    usable = marks.where(in_training(F.col("doc")))
    order = [F.xxhash64("doc"), F.col("doc")]
    chosen = usable.where("good").orderBy(*order).limit(per_class).union(
        usable.where("not good").orderBy(*order).limit(per_class)
    )
    sample = keyed_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc").select("doc", "good", "body")
    # One text for each id, whatever the order of repeated rows.
    picked = sample.groupBy("doc").agg(F.min(F.struct("good", "body")).alias("x")).select("x.good", "x.body")
    found = picked.mapInArrow(_indicator_rows(bits), "good boolean, buckets array<int>").toArrow()
    return fit(*ordered_rows(found), bits)


def _scored(model: Model, bits: int):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [model.scores(*indicators(texts, bits)) for texts in batches(t.as_py() for t in part.column("body"))]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([part.column("doc").cast(pa.int64()), pa.array(scores)], ["doc", "score"])

    return rows


def scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.3,
    per_class: int = SAMPLE_PER_CLASS,
    bits: int = BITS,
) -> DataFrame:
    """(doc, held_out, score, predicted) for every row; a null text counts as empty.

    The score depends on nothing but the whole text and the model. Repeated rows and rows with a null
    id are scored like others (a null id counts as held out). Other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, per_class, bits)
    rated = keyed_text(docs, id_col, text_col).mapInArrow(_scored(model, bits), "doc long, score double")
    return rated.select(
        "doc",
        F.coalesce(~in_training(F.col("doc")), F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """``docs`` without the rows whose score is under ``threshold``; same columns.

    The whole row goes through the scoring, so nothing is joined and equal ids are judged apart.
    """
    model = train(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [model.scores(*indicators(texts)) for texts in batches(t.as_py() for t in part.column(at))]
            good = np.concatenate(found) >= threshold if found else np.zeros(0, bool)
            yield part.filter(pa.array(good))

    return docs.mapInArrow(rows, docs.schema)
