"""Word-window chunks with exact character provenance.

Everything happens inside the page row: no word is exploded and nothing is shuffled, so a
source holding a third of all pages costs no more than its share of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import is_int, require
from ..functions.text import GAP, SPACES, TOKEN, content_hash, let, word_count

FIELDS = ("page_result", "page_snippet")

_PREFIX_BLOCK = 128


def _pieces(text: Column, chunk_words: int) -> Column:
    """Consecutive slices of the text that hold ``chunk_words`` words each, leading space kept.

    One match is one slice: nothing is made for the single word, and the possessive runs never step back.
    """
    words = f"((?:{GAP}{TOKEN}){{1,{chunk_words}}}+)"
    return F.regexp_extract_all(text, F.lit(words), F.lit(1))


def _every(size: Column, step: int) -> Column:
    """0, step, 2*step, ... below ``size``."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def _ends(lengths: Column) -> Column:
    """Running sum of an int array, in blocks so that long pages do not copy quadratically."""

    def within(block: Column, base: Column) -> Column:
        zero = F.struct(base.alias("total"), F.array().cast("array<int>").alias("ends"))
        return F.aggregate(
            block,
            zero,
            lambda acc, n: F.struct(
                (acc["total"] + n).alias("total"),
                F.concat(acc["ends"], F.array(acc["total"] + n)).alias("ends"),
            ),
        )

    blocks = let(
        lengths,
        lambda all_lengths: F.transform(
            _every(F.size(all_lengths), _PREFIX_BLOCK),
            lambda i: F.slice(all_lengths, i + 1, F.lit(_PREFIX_BLOCK)),
        ),
    )
    empty = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(
        blocks,
        empty,
        lambda acc, block: let(
            within(block, acc["total"]),
            lambda done: F.struct(
                done["total"].alias("total"), F.concat(acc["ends"], done["ends"]).alias("ends")
            ),
        ),
        lambda acc: acc["ends"],
    )


def web_chunks(pages: DataFrame, chunk_words: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cut ``page_result`` then ``page_snippet`` of every page into evidence rows.

    ``pages`` holds interaction_id, page_index, page_name, page_url, page_snippet, page_result
    and page_last_modified; columns named in ``carry`` are repeated on each chunk. Offsets
    count code points. Empty text yields no chunk.
    """
    require(is_int(chunk_words) and chunk_words >= 1, "a chunk has at least one word")
    texts = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    )
    keep = ["interaction_id", "page_index", "page_url", "page_name", "page_last_modified", *carry]
    fields = pages.select(*keep, texts.alias("f")).select(*keep, "f.field", "f.text")
    pieces = fields.withColumn("pieces", _pieces(F.col("text"), chunk_words)).drop("text")
    spans = pieces.withColumn(
        "ends", _ends(F.transform("pieces", lambda piece: F.length(piece)))
    )
    chunk = F.posexplode(F.arrays_zip("pieces", "ends")).alias("position", "c")
    last = F.size("pieces") - 1
    rows = spans.select(*keep, "field", last.alias("last"), chunk).select(
        *keep,
        "field",
        (F.col("position") == F.col("last")).alias("is_last"),
        F.col("c.ends").alias("char_end"),
        F.ltrim("c.pieces", F.lit(SPACES)).alias("content"),
    )
    rows = rows.withColumn("char_start", F.col("char_end") - F.length("content"))
    identity = content_hash(
        "interaction_id", "page_index", "field", "char_start", "char_end", "content"
    )
    return rows.select(
        identity.alias("evidence_id"),
        "interaction_id",
        F.lit("web").alias("source_kind"),
        "page_index",
        F.col("page_url").alias("source_url"),
        F.col("page_name").alias("source_title"),
        F.col("page_last_modified").alias("source_time"),
        "field",
        "char_start",
        "char_end",
        "content",
        F.when(F.col("is_last"), word_count("content"))
        .otherwise(F.lit(chunk_words))
        .alias("word_count"),
        *carry,
    )


def explode_pages(records: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Nested question records to one row per page; the array position is the page key."""
    return records.select(
        "interaction_id", *carry, F.posexplode("search_results").alias("page_index", "page")
    ).select("interaction_id", *carry, "page_index", "page.*")


def with_content(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Attach the source slice to rows that only kept their span.

    Ranking works on slim rows; only the few winners go back for their text, so the text
    itself never takes part in a ranking shuffle.
    """
    source = pages.select("interaction_id", "page_index", *FIELDS)
    text = F.when(F.col("field") == FIELDS[0], F.col(FIELDS[0])).otherwise(F.col(FIELDS[1]))
    content = F.substring(text, F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return (
        spans.join(source, ["interaction_id", "page_index"])
        .withColumn("content", content)
        .drop(*FIELDS)
    )
