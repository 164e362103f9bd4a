"""SimHash fingerprints and their links by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keyed_text, saved
from .components import components
from .shingles import Words, batches, xxh64

_BYTES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group of ``counts`` hashes: the bits set in over half of them (no hash: zero).

    Eight bits at a time are added in the bytes of one word, over runs of at most 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    sizes = counts[some]
    first = np.cumsum(sizes) - sizes
    runs = -(-sizes // 255)
    step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(first, runs) + 255 * step
    of = np.cumsum(runs) - runs
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _BYTES, starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), of, axis=0)
        for byte in range(8):
            over = 2 * sums[:, byte] > sizes
            out[some] |= over.astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprints_of(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    words = Words(texts, lower=True)
    starts, ends, counts = words.shingles(width)
    return majority_bits(xxh64(words.data, starts, ends, seed), counts)


def _fingerprints(width: int, seed: int):
    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [fingerprints_of(texts, width, seed) for texts in batches(t.as_py() for t in part.column(1))]
            prints = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), part.column(2), pa.array(prints.view(np.int64))], ["doc", "mark", "print"]
            )

    return hashed


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42
) -> DataFrame:
    """(doc, mark, print): the 64-bit fingerprint of every whole text, as a signed long; mark is its hash."""
    keyed = keyed_text(docs, id_col, text_col).select("doc", "body", F.xxhash64("body").alias("mark"))
    return keyed.mapInArrow(_fingerprints(width, seed), "doc long, mark long, print long")


def links_of(prints: DataFrame) -> DataFrame:
    """(u, v) for different fingerprints at 2 or fewer differing bits, by multi-index hashing.

    A fingerprint has two segments of 32 bits. Two bits of difference leave either the upper
    segments at most one bit apart or the lower segments equal. So each fingerprint looks up its
    Hamming ball of radius 1 in the table of upper segments and itself in the table of lower ones,
    and the complete distance of every match is verified. Of two fingerprints only the one without
    the differing bit looks the other one up; matches of equal segments are taken once.
    """
    upper, lower = F.shiftrightunsigned("print", 32), F.col("print").bitwiseAND(0xFFFFFFFF)
    flips = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda k: upper.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)),
        ),
        lambda key: key != upper,
    )

    def entry(segment: int, key, same: bool):
        return F.struct(F.lit(segment).alias("segment"), key.alias("key"), F.lit(same).alias("same"))

    own = F.array(entry(0, upper, True), entry(1, lower, True))
    asked = prints.select(
        F.col("print").alias("u"), F.explode(F.concat(own, F.transform(flips, lambda k: entry(0, k, False)))).alias("e")
    ).select("u", "e.*")
    stored = prints.select(F.col("print").alias("v"), F.explode(own).alias("e")).select("v", "e.segment", "e.key")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    return asked.join(stored, ["segment", "key"]).where(near & (~F.col("same") | (F.col("u") < F.col("v")))).select(
        "u", "v"
    )


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42
) -> DataFrame:
    """(doc, print, group) for every row: group is the smallest id reachable over links.

    Texts are lower-cased in A-Z and cut into words at ASCII white space; a bit of the fingerprint
    is 1 if it is set in over half of the hashes of the ``width``-word shingles, repeats included.
    A shorter text is one shingle. Null, empty and blank texts have the fingerprint zero and are
    linked like any other. Rows with a null id take part, but never name a group; a group without
    any id has a null name. Repeated rows stay repeated. Other columns are not read.

    Equal fingerprints are one node, so copies never meet in pairs; only numbers travel.
    """
    return _grouped(docs, id_col, text_col, width, seed).select("doc", "print", "group")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int = 3, seed: int = 42) -> DataFrame:
    prints = saved(fingerprints(docs, id_col, text_col, width, seed))
    nodes = saved(prints.groupBy("print").agg(F.min("doc").alias("least")))
    roots = components(links_of(nodes.select("print")))
    rooted = nodes.join(roots.withColumnRenamed("node", "print"), "print", "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("group"))
    return prints.join(rooted.join(named, "root").select("print", "root", "group"), "print")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one that names it, its repeated rows once.

    Rows with one id and different texts are documents of their own, each held against its own group;
    if they are in one group, the text with the least hash stays. Rows without an id cannot be named and
    stay. Texts move once, by id and hash of the text.
    """
    named = _grouped(docs, id_col, text_col).where(F.col("doc") == F.col("group"))
    mark = fresh("mark")
    first = named.groupBy("root").agg(F.min(F.struct("doc", "mark")).alias("one"))
    kept = first.select(F.col("one.doc").alias(id_col), F.col("one.mark").alias(mark)).distinct()
    marked = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    return marked.join(kept, [id_col, mark], "left_semi").dropDuplicates([id_col, mark]).select(docs.columns).union(
        docs.where(F.col(id_col).isNull())
    )
