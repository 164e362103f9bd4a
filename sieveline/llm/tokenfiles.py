"""Documents as files of token-id blocks, in ascending order of their ids, and back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_text, saved
from .mixing import read_block, write_block
from .tokens import encoder

#: A block ends with the document that brings it to so many ids.
BLOCK = 1 << 21
BLOCKS = "part int, block int, n_docs long, n_tokens long, data binary"
NO_ID = -(1 << 63)


def _blocks(path: str, end_id: int, target: int):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        number, held, docs, size = 0, [], [], 0

        def full() -> pa.RecordBatch:
            sizes = [len(ids) for ids in held]
            data = write_block(np.array(docs, np.int64), np.array(sizes), np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(docs)], pa.int64()),
                    pa.array([size], pa.int64()), pa.array([data], pa.binary()),
                ],
                ["part", "block", "n_docs", "n_tokens", "data"],
            )

        for batch in parts:
            for doc, ids in zip(batch.column("doc").to_pylist(), encode(t.as_py() for t in batch.column("body")), strict=True):
                docs.append(doc)
                held.append(np.append(ids, np.uint32(end_id)))
                size += len(ids) + 1
                if size >= target:
                    yield full()
                    number, held, docs, size = number + 1, [], [], 0
        if docs:
            yield full()

    return rows


def token_blocks(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, target: int = BLOCK
) -> DataFrame:
    """Rows of the file format: blocks of whole documents in ascending order of (part, block).

    A document is its ids and then ``end_id``; a null text is empty. Null ids come first, and rows with
    equal ids are in the order of their texts' hashes. A text longer than ``target`` ids makes a block of
    its own length. An empty table has no blocks. Other columns are not read.
    """
    keyed = keyed_text(docs, id_col, text_col).select(
        F.coalesce(F.col("doc").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("body").alias("mark"), "body"
    )
    ordered = keyed.repartitionByRange("doc", "mark").sortWithinPartitions("doc", "mark")
    return ordered.mapInArrow(_blocks(path, end_id, target), BLOCKS)


def _documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for base, block in zip(batch.column("base").to_pylist(), batch.column("data"), strict=True):
            docs, sizes, ids = read_block(block.as_py())
            ends = np.cumsum(sizes.astype(np.int64))
            raw = ids.astype("<u4").tobytes()
            checks = [zlib.crc32(raw[4 * (end - n) : 4 * end]) for end, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs), pa.array(ends - sizes + base), pa.array(sizes.astype(np.int64)), pa.array(checks, pa.int64())],
                ["doc", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(blocks: DataFrame) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document of a table of blocks, decoded and checked.

    ``start`` is the number of ids of all documents before it: of the parts, and of the blocks within a
    part. A damaged block stops the read.
    """
    sizes = blocks.select("part", "block", "n_tokens")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part, whatever the number of documents.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before().orderBy("part")), F.lit(0)).alias("part_base")
    )
    bases = sizes.join(parts, "part").select(
        "part", "block",
        (F.col("part_base") + F.coalesce(F.sum("n_tokens").over(before("part").orderBy("block")), F.lit(0))).alias("base"),
    )
    found = blocks.select("part", "block", "data").join(bases, ["part", "block"]).select("base", "data").mapInArrow(
        _documents, "doc long, start long, n_tokens long, ids_crc32 long"
    )
    return found.withColumn("doc", F.nullif("doc", F.lit(NO_ID)))


def encode_and_read(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' blocks into the shared folder and read them back."""
    return read_documents(saved(token_blocks(docs, path, id_col, text_col)))
