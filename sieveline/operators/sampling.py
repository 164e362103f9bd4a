"""Exposure ledger and leakage-free, source-disjoint sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import ValidationError, is_int, require, require_none, violations
from ..functions.text import canonical_url, content_hash, is_blank, question_key
from ..plans.lineage import cut

# The JSON keys that name an exposed question.
ID_KEYS = ("interaction_id", "query_id")
ID_LIST_KEY = "query_ids"

# Rejection reasons in order of precedence.
REASONS = (
    "prior_question",
    "no_canonical_source",
    "duplicate_question_text",
    "shared_source_page",
    "empty_source_text",
)


def exposed_ids(artifacts: DataFrame, value: str = "value") -> DataFrame:
    """Distinct question ids found at any depth of JSON artifacts.

    Each pass opens one nesting level of all artifacts together and keeps only the containers
    for the next, so the number of passes is the JSON depth, not the number of nodes. An artifact
    that is null or not JSON, or repeats a key, stops the query: a ledger may not lose ids.
    """
    unread = F.try_parse_json(value).isNull()
    require_none(violations(artifacts, F.substring(F.coalesce(value, F.lit("null")), 1, 80), [
        ("artifact_not_json", unread, F.lit("cannot be read"))
    ]))
    text = lambda v: F.try_variant_get(v, "$", "string")
    kind = lambda v: F.schema_of_variant(v)
    level = artifacts.select(F.try_parse_json(value).alias("node"))
    found = None
    while True:
        members = F.map_entries(F.try_variant_get("node", "$", "map<string,variant>"))
        elements = F.transform(
            F.try_variant_get("node", "$", "array<variant>"),
            lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")),
        )
        children = cut(
            level.where(kind(F.col("node")).rlike("^(OBJECT|ARRAY)")).select(
                F.explode(
                    F.when(kind(F.col("node")).startswith("OBJECT"), members).otherwise(elements)
                ).alias("c")
            ).select("c.key", "c.value")
        )
        if children.isEmpty():
            break
        named = F.coalesce(F.col("key").isin(*ID_KEYS), F.lit(False)) & (
            kind(F.col("value")) == "STRING"
        )
        listed = F.coalesce(F.col("key") == ID_LIST_KEY, F.lit(False)) & kind(
            F.col("value")
        ).startswith("ARRAY")
        items = F.filter(
            F.try_variant_get("value", "$", "array<variant>"), lambda v: kind(v) == "STRING"
        )
        ids = F.when(named, F.array(text(F.col("value")))).when(
            listed, F.transform(items, text)
        )
        here = children.select(F.explode(ids).alias("interaction_id"))
        found = here if found is None else found.unionByName(here)
        level = children.where(~named & ~listed).select(F.col("value").alias("node"))
    if found is None:
        return artifacts.select(F.lit("").alias("interaction_id")).limit(0)
    return found.distinct()


def shuffle_key(seed: str, identity: Column | str = "interaction_id") -> Column:
    """Position of a question in the seeded, data-independent order."""
    return content_hash(F.lit(seed), identity)


@dataclass(frozen=True)
class Sample:
    chosen: DataFrame
    rejections: DataFrame
    scanned: DataFrame


def _earliest_independent(edges: DataFrame) -> DataFrame:
    """Nodes a one-by-one scan in ``position`` order would keep when kept nodes block their keys.

    A node that comes first for all of its keys is kept; it and everything sharing a key with
    it leave. With positions from a hash the number of rounds grows with the logarithm of the
    node count. Both groupings reduce map-side and hot keys carry one row per node.
    """
    kept = None
    while not edges.isEmpty():
        first = edges.groupBy("key").agg(F.min("position").alias("first"))
        ready = (
            edges.join(first, "key")
            .groupBy("interaction_id", "position")
            .agg(F.bool_and(F.col("position") == F.col("first")).alias("ready"))
            .where("ready")
            .select("interaction_id", "position")
        )
        ready = cut(ready)
        kept = ready if kept is None else kept.unionByName(ready)
        closed = edges.join(ready, "interaction_id", "left_semi").select("key").distinct()
        gone = edges.join(closed, "key", "left_semi").select("interaction_id").distinct()
        edges = cut(edges.join(gone, "interaction_id", "left_anti"))
    return kept


def position_at(rows: DataFrame, rank: int) -> str | None:
    """The ``rank``-th smallest ``position`` (hexadecimal digests), or null if there are fewer.

    Digits are fixed four at a time from counts of at most 65,536 beginnings, until few digests
    are left; no task sorts more than those.
    """
    begin = ""
    while True:
        at = len(begin) + 1
        counts = (
            rows.where(F.col("position").startswith(begin))
            .groupBy(F.substring("position", at, 4).alias("next")).count().orderBy("next").collect()
        )
        for row in counts:
            if row["count"] >= rank:
                break
            rank -= row["count"]
        else:
            return None
        begin += row["next"]
        if row["count"] <= 4096 or len(begin) >= 64:
            last = rows.where(F.col("position").startswith(begin)).select("position").collect()
            return sorted(r.position for r in last)[rank - 1]


def sample_disjoint(
    questions: DataFrame, pages: DataFrame, excluded: DataFrame, seed: str, size: int
) -> Sample:
    """First ``size`` questions in seeded order that share nothing with each other or the past.

    Pages and questions are read once and shrink to digests; conflicts are resolved in rounds over
    those slim edges of all questions, and the sample is cut at the position of its last question.
    Raises when the whole set cannot fill the sample.
    """
    require(is_int(size) and size >= 1, "a sample has at least one question")
    digest = lambda c: F.sha2(c, 256)
    order = cut(
        questions.select(
            "interaction_id", shuffle_key(seed).alias("position"), digest(question_key("query")).alias("text")
        )
    )
    past = excluded.select("interaction_id").distinct()
    unknown = past.join(order, "interaction_id", "left_anti").take(1)
    if unknown:
        raise ValidationError(f"excluded id is not a known question: {unknown[0][0]}")
    known = order.select("interaction_id")
    sheets = cut(
        pages.select(
            "interaction_id",
            digest(canonical_url("page_url")).alias("url"),
            F.coalesce(~is_blank("page_result") | ~is_blank("page_snippet"), F.lit(False)).alias("has_text"),
        ).join(known, "interaction_id", "left_semi")
    )
    links = sheets.where("url is not null").select("interaction_id", "url").distinct()
    texts = order.join(past, "interaction_id", "left_semi").select("text").distinct()
    urls = links.join(past, "interaction_id", "left_semi").select("url").distinct()
    flags = ("has_url", "has_text", "prior", "old_url")

    def marked(df: DataFrame, **found: Column) -> DataFrame:
        return df.select("interaction_id", *[found.get(f, F.lit(False)).alias(f) for f in flags])

    noted = (
        marked(sheets, has_url=F.col("url").isNotNull(), has_text=F.col("has_text"))
        .unionByName(marked(past, prior=F.lit(True)))
        .unionByName(marked(links.join(urls, "url", "left_semi"), old_url=F.lit(True)))
        .groupBy("interaction_id").agg(*[F.bool_or(f).alias(f) for f in flags])
    )
    state = cut(
        order.join(noted, "interaction_id", "left")
        .join(texts.withColumn("old_text", F.lit(True)), "text", "left")
        .select(
            "interaction_id", "position", "text",
            *[F.coalesce(f, F.lit(False)).alias(f) for f in (*flags, "old_text")],
        )
    )
    open_ = state.where("not prior and has_url and not old_text and not old_url and has_text")
    key = lambda kind, c: F.concat(F.lit(kind), c).alias("key")
    edges = cut(
        links.join(open_, "interaction_id").select("interaction_id", "position", key("u:", "url"))
        .unionByName(open_.select("interaction_id", "position", key("t:", "text")))
    )
    kept = _earliest_independent(edges)
    last = None if kept is None else position_at(kept, size)
    if last is None:
        raise ValidationError("the questions left do not fill a source-disjoint sample")
    chosen = cut(kept.where(F.col("position") <= last))
    scanned = state.where(F.col("position") <= last)
    taken = (
        edges.join(chosen.select("interaction_id"), "interaction_id", "left_semi")
        .select("key", F.col("position").alias("taken_at"))
    )
    here = scanned.select("interaction_id", "position", "text")
    used = (
        here.select("interaction_id", "position", key("t:", "text"))
        .unionByName(links.join(here, "interaction_id").select("interaction_id", "position", key("u:", "url")))
        .join(taken, "key").where(F.col("taken_at") < F.col("position"))
        .groupBy("interaction_id").agg(
            F.bool_or(F.col("key").startswith("t:")).alias("new_text"),
            F.bool_or(F.col("key").startswith("u:")).alias("new_url"),
        )
    )
    judged = scanned.join(used, "interaction_id", "left").join(
        chosen.select("interaction_id", F.lit(True).alias("chosen")), "interaction_id", "left"
    )
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(true("chosen"), "chosen")
        .when(F.col("prior"), REASONS[0])
        .when(~F.col("has_url"), REASONS[1])
        .when(F.col("old_text") | true("new_text"), REASONS[2])
        .when(F.col("old_url") | true("new_url"), REASONS[3])
        .otherwise(REASONS[4])
    )
    outcome = judged.select("interaction_id", "position", reason.alias("outcome"))
    counts = (
        outcome.where(F.col("outcome") != "chosen")
        .groupBy(F.col("outcome").alias("reason"))
        .agg(F.count("*").alias("n"))
    )
    return Sample(chosen, counts, outcome)
