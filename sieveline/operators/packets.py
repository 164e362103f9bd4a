"""Review packets as flat tables, compared by digest trees.

A packet may hold any number of pages, so nothing is nested: questions, their pages, their ranked
candidates and the ledger of excluded questions are four tables. For a comparison every row becomes a
leaf (branch, part, place, digest) and every branch one root, an order-free fold of its leaves. Only
the branches whose roots differ are opened, and only digests are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import violations
from ..functions.text import content_hash
from ..sources.artifacts import write_once

LEDGER_BRANCHES = 4096
CANDIDATE = "rank evidence_id page_index field char_start char_end content word_count".split()
PAGE = "page_index page_name page_url page_snippet page_result page_last_modified".split()


@dataclass(frozen=True)
class Packet:
    questions: DataFrame  # interaction_id, query, query_time
    pages: DataFrame  # interaction_id and the page columns
    candidates: DataFrame  # interaction_id and the candidate columns
    ledger: DataFrame  # interaction_id of every excluded question


def build_packet(
    chosen: DataFrame, questions: DataFrame, pages: DataFrame, candidates: DataFrame, excluded: DataFrame
) -> Packet:
    """The chosen questions with all their pages and their candidates, and what was excluded."""
    keys = chosen.select("interaction_id")
    own = lambda df, *columns: df.join(keys, "interaction_id", "left_semi").select("interaction_id", *columns)
    return Packet(
        own(questions, "query", "query_time"), own(pages, *PAGE), own(candidates, *CANDIDATE),
        excluded.select("interaction_id").distinct(),
    )


def write_packet(packet: Packet, folder: str) -> None:
    """Each table once; an existing packet is never overwritten."""
    for part in fields(packet):
        write_once(getattr(packet, part.name), f"{folder}/{part.name}", "parquet")


def read_packet(spark: SparkSession, folder: str) -> Packet:
    return Packet(**{part.name: spark.read.parquet(f"{folder}/{part.name}") for part in fields(Packet)})


def _digest(*parts: Column | str) -> Column:
    """SHA-256 of the parts; a null is told apart from every text."""
    told = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string"))) for c in map(_column, parts)]
    return content_hash(*told)


def _column(part: Column | str) -> Column:
    return F.col(part) if isinstance(part, str) else part


def leaves(packet: Packet) -> DataFrame:
    """(branch, part, place, digest): one row for each row of the packet.

    A question's rows are on its own branch. The ledger belongs to no question; its ids are dealt over
    a fixed number of branches, so that one lost id opens a small part of it.
    """

    def part(df: DataFrame, name: str, branch: Column, place: Column | str, *columns: str) -> DataFrame:
        return df.select(
            branch.alias("branch"), F.lit(name).alias("part"), _column(place).cast("string").alias("place"),
            _digest(*columns).alias("digest"),
        )

    question = F.concat(F.lit("question/"), F.col("interaction_id"))
    dealt = F.concat(F.lit("ledger/"), F.pmod(F.xxhash64("interaction_id"), F.lit(LEDGER_BRANCHES)).cast("string"))
    return (
        part(packet.questions, "question", question, F.lit(""), "interaction_id", "query", "query_time")
        .unionByName(part(packet.pages, "page", question, "page_index", "interaction_id", *PAGE))
        .unionByName(part(packet.candidates, "candidate", question, "rank", "interaction_id", *CANDIDATE))
        .unionByName(part(packet.ledger, "ledger", dealt, "interaction_id", "interaction_id"))
    )


def roots(rows: DataFrame) -> DataFrame:
    """(branch, leaves, root): the fold of a branch's leaf digests, whatever their order.

    Digests of (part, place, digest) are cut into eight 32-bit words that are summed, so a branch with
    any number of leaves combines map-side.
    """
    hashed = rows.select("branch", F.sha2(F.concat_ws("\0", "part", "place", "digest"), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")) for i in range(8)]
    return hashed.groupBy("branch").agg(
        F.count("*").alias("leaves"), F.sha2(F.concat_ws("-", F.count("*"), *words), 256).alias("root")
    )


def packet_violations(stored: Packet, expected: Packet) -> DataFrame:
    """Every question, page, candidate and ledger id that differs, is missing, or was not expected.

    Roots are compared first; leaves are only compared on branches whose roots differ. A place that
    occurs twice is reported as repeated.
    """
    sides = leaves(stored), leaves(expected)
    got, want = (roots(side).select("branch", F.struct("leaves", "root").alias(name)) for side, name in zip(sides, ("got", "want"), strict=True))
    opened = got.join(want, "branch", "full").where(~F.col("got").eqNullSafe(F.col("want"))).select("branch")
    keys = ["branch", "part", "place"]

    def inside(side: DataFrame, name: str) -> DataFrame:
        own = side.join(opened, "branch", "left_semi").groupBy(*keys)
        return own.agg(F.count("*").alias(f"{name}_n"), F.min("digest").alias(f"{name}_digest"))

    rows = inside(sides[0], "got").join(inside(sides[1], "want"), keys, "full")
    there, asked = F.col("got_n").isNotNull(), F.col("want_n").isNotNull()
    owner = F.when(F.col("part") == "ledger", F.lit("ledger")).otherwise(F.regexp_replace("branch", "^question/", ""))
    at = F.concat_ws("/", owner, F.when(F.col("part") != "ledger", F.col("part")), F.when(F.col("place") != "", F.col("place")))
    broken = violations(
        rows,
        at,
        [
            ("missing", asked & ~there, F.col("part")),
            ("unexpected", there & ~asked, F.col("part")),
            ("changed", there & asked & (F.col("got_digest") != F.col("want_digest")), F.col("part")),
            ("repeated", there & (F.col("got_n") > F.coalesce("want_n", F.lit(1))), F.col("part")),
        ],
    )
    return broken.select("location", F.concat_ws("_", "detail", "rule").alias("rule"), F.lit("digest").alias("detail"))
