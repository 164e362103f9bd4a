"""Integrity gates and write-once outputs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import require_none, violations
from ..functions.text import content_hash

_BLOCK = 8 * 1024 * 1024


def _uri(path: str) -> str:
    """Spark lists local files as file:/x, which URI parsers expect as file:///x."""
    short = path.startswith("file:/") and not path.startswith("file://")
    return "file://" + path.removeprefix("file:") if short else path


def open_file(path: str):
    """A stored file as a seekable stream."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(_uri(path))
    return system.open_input_file(name)


def file_digests(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, bytes, sha256) of stored files.

    Only names and sizes come through the file source. A digest is sequential by nature, so
    each file is streamed block by block in its own task and never held in memory.
    """
    listed = spark.read.format("binaryFile").load(list(paths)).select("path", "length")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                total = hashlib.sha256()
                with open_file(path) as stream:
                    while block := stream.read(_BLOCK):
                        total.update(block)
                rows.append(total.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "bytes": batch["length"], "sha256": rows})

    return listed.repartition("path").mapInPandas(digest, "path string, bytes long, sha256 string")


def checksum_violations(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pinned files that are missing or whose size or digest changed (matched on file name)."""
    name = F.substring_index("path", "/", -1)
    found = digests.select(
        name.alias("name"), F.col("bytes").alias("got_bytes"), F.col("sha256").alias("got_sha256")
    )
    joined = manifest.join(found, "name", "left")
    there = F.col("got_sha256").isNotNull()
    return violations(
        joined,
        F.col("name"),
        [
            ("file_missing", F.col("got_sha256").isNull(), F.col("name")),
            ("size_differs", there & (F.col("got_bytes") != F.col("bytes")), F.col("got_bytes")),
            ("sha256_differs", there & (F.col("got_sha256") != F.col("sha256")), F.col("got_sha256")),
        ],
    )


def asset_violations(manifest: DataFrame, max_total_bytes: int | Column, root: str) -> DataFrame:
    """Asset-set guards on (local_path, bytes): budget, unique destinations, no escape."""
    limit = max_total_bytes if isinstance(max_total_bytes, Column) else F.lit(max_total_bytes)
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    over = violations(
        total, F.lit(root), [("budget_exceeded", F.col("bytes") > limit, F.col("bytes"))]
    )
    copies = manifest.groupBy("local_path").agg(F.count("*").alias("n"))
    again = violations(
        copies, F.col("local_path"), [("repeated_destination", F.col("n") > 1, F.col("n"))]
    )
    steps = F.filter(F.split("local_path", "/"), lambda s: ~s.isin("", "."))
    depth = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("lowest")),
        lambda acc, s: F.struct(
            (acc["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"),
            F.least(acc["lowest"], acc["at"] + F.when(s == "..", -1).otherwise(1)).alias("lowest"),
        ),
        lambda acc: acc["lowest"],
    )
    outside = F.col("local_path").startswith("/") | (depth < 0)
    escape = violations(
        manifest,
        F.col("local_path"),
        [("destination_escapes_root", outside, F.col("local_path"))],
    )
    return over.unionByName(again).unionByName(escape)


def row_hash(df: DataFrame) -> Column:
    """Digest of one row's canonical JSON (columns in name order)."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def folded(digest: Column) -> list[Column]:
    """Aggregates of a digest column whose concatenation does not depend on the rows' order.

    Every digest is cut into eight 32-bit words that are summed, so folds combine map-side.
    """
    return [F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")) for i in range(8)]


def fingerprint(rows: DataFrame, digest: Column | None = None) -> DataFrame:
    """Order-free content fingerprint: row count and fold of the row digests."""
    digest = row_hash(rows) if digest is None else digest
    return rows.select(digest.alias("h")).agg(
        F.count("*").alias("rows"), F.sha2(F.concat_ws("-", *folded(F.col("h"))), 256).alias("fingerprint")
    )


def content_digests(rows: DataFrame, name: str, part: Column, size: Column, digest: Column | None = None) -> DataFrame:
    """(path, bytes, sha256) of a table's content by part, whatever files it lies in.

    Row digests are folded map-side, one row a part and task is exchanged. The result is what
    ``checksum_violations`` holds against a manifest.
    """
    digest = row_hash(rows) if digest is None else digest
    slim = rows.select(F.concat_ws("/", F.lit(name), part.cast("string")).alias("path"), size.alias("size"), digest.alias("h"))
    return slim.groupBy("path").agg(
        F.sum("size").alias("bytes"), F.sha2(F.concat_ws("-", F.count("*"), *folded(F.col("h"))), 256).alias("sha256")
    )


def write_once(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a trace; an existing output is never overwritten."""
    df.write.mode("errorifexists").format(fmt).save(path)


def write_run(
    trace: DataFrame, path: str, config_json: str, sources: DataFrame, order: tuple[str, ...] = ("interaction_id",),
    digest: Column | None = None,
) -> DataFrame:
    """Write a trace once and bind it by a manifest gathered in the same pass; returns the manifest.

    Counts and folds of row digests and of the ``order`` columns are observed while the rows are written
    (by the task that writes them, so a lost or repeated task counts once). The manifest is the last
    thing written: a write that fails leaves none, and a folder without one is no run. ``sources`` holds
    the digests of the inputs, ``order`` the columns that fix the rows' places (place and id, say).
    """
    spark = trace.sparkSession
    digest = row_hash(trace) if digest is None else digest
    place = content_hash(*order)
    seen = Observation()
    words = [(f"{name}{i}", w) for name, h in (("row", digest), ("place", place)) for i, w in enumerate(folded(h))]
    watched = trace.observe(seen, F.count("*").alias("rows"), *[w.alias(name) for name, w in words])
    write_once(watched, f"{path}/trace", "parquet")
    got = seen.get
    bound = fingerprint(sources).first()
    fold = lambda name: "-".join(str(got[f"{name}{i}"] if got["rows"] else "") for i in range(8)).strip("-")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    row = (config_json, sha(config_json), got["rows"], sha(fold("row")), sha(fold("place")), bound.rows, bound.fingerprint)
    names = "config string, config_sha256 string, trace_rows long, trace_fingerprint string, order_fingerprint string, sources long, source_fingerprint string"
    write_once(spark.createDataFrame([row], names).coalesce(1), f"{path}/manifest", "json")
    return spark.read.schema(names).json(f"{path}/manifest")


def run_violations(spark: SparkSession, path: str, order: tuple[str, ...] = ("interaction_id",), digest: Column | None = None) -> DataFrame:
    """A stored run against its manifest: rows, content and order worked out again from the files."""
    manifest = spark.read.json(f"{path}/manifest")
    trace = spark.read.parquet(f"{path}/trace")
    now = fingerprint(trace, digest).select(F.col("rows").alias("now_rows"), F.col("fingerprint").alias("now_rows_print"))
    places = fingerprint(trace, content_hash(*order)).select(F.col("fingerprint").alias("now_order"))
    joined = manifest.join(now, F.lit(True)).join(places, F.lit(True))  # one row each
    return violations(
        joined,
        F.lit(path),
        [
            ("trace_rows_differ", F.col("now_rows") != F.col("trace_rows"), F.col("now_rows")),
            ("trace_differs", F.col("now_rows_print") != F.col("trace_fingerprint"), F.col("now_rows")),
            ("order_differs", F.col("now_order") != F.col("order_fingerprint"), F.col("now_rows")),
            ("config_differs", F.sha2("config", 256) != F.col("config_sha256"), F.lit("config")),
        ],
    )


def import_once(spark: SparkSession, export_path: str, violations_found: DataFrame, output: str) -> None:
    """Store a validated export unchanged: validation must be clean and the bytes must match."""
    require_none(violations_found)
    before = file_digests(spark, export_path).select("bytes", "sha256")
    raw = spark.read.format("binaryFile").load(export_path).select("path", "content")
    raw.select(
        "path", F.sha2("content", 256).alias("sha256"), "content"
    ).write.mode("errorifexists").parquet(output)
    kept = spark.read.parquet(output).select(
        F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")
    )
    require_none(
        violations(
            before.exceptAll(kept),
            F.lit(output),
            [("export_changed_during_import", F.lit(True), F.col("sha256"))],
        )
    )
