"""Validation of human review exports as joins against the pinned inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import violations
from ..functions.text import is_blank
from .chunking import FIELDS

# The vocabularies of the three export kinds.
STATUSES = ("pending", "reviewed", "needs_changes")
DECISIONS = ("pending", "correct", "incorrect", "abstained", "uncertain")
SUPPORTS = ("pending", "supported", "unsupported", "uncertain", "not_applicable")
ANSWERABILITY = ("pending", "supported_by_candidates", "missing_evidence", "uncertain")
DRAFT_EXPORT = "human_review_of_ai_drafts"
GENERATED_EXPORT = "human_review_of_generated_answers"
EVIDENCE_EXPORT = "human_candidate_evidence_review"


def _outside(column: str, allowed: tuple[str, ...]):
    return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def export_violations(exports: DataFrame, artifact_type: str) -> DataFrame:
    """Header rules of exports (location, artifact_type, reviewer, n_reviews)."""
    return violations(
        exports,
        F.col("location"),
        [
            (
                "artifact_type",
                ~F.col("artifact_type").eqNullSafe(F.lit(artifact_type)),
                F.col("artifact_type"),
            ),
            ("reviewer_missing", is_blank(F.coalesce("reviewer", F.lit(""))), F.lit("reviewer")),
            ("no_reviews", F.coalesce("n_reviews", F.lit(0)) < 1, F.col("n_reviews")),
        ],
    )


def _repeated(reviews: DataFrame, *keys: str) -> DataFrame:
    counted = reviews.groupBy(*keys).agg(F.count("*").alias("n"))
    return violations(
        counted, F.concat_ws("/", *keys), [("repeated_review", F.col("n") > 1, F.col("n"))]
    )


def draft_review_violations(
    reviews: DataFrame, questions: DataFrame, pages: DataFrame
) -> DataFrame:
    """Decisions over drafts: identity, flags, inspected references and exact quotes.

    References are exploded and joined to their page, so a quote is compared with the source
    slice where the page already lives.
    """
    known = questions.select("interaction_id", F.col("query").alias("pinned_query"))
    rows = reviews.join(known, "interaction_id", "left")
    reviewed = F.col("status") == "reviewed"
    all_inspected = F.forall("inspected_excerpts", lambda x: F.coalesce(x, F.lit(False)))
    shape = (F.size("inspected_excerpts") != F.size("draft.references")) | F.exists(
        "inspected_excerpts", lambda x: x.isNull()
    )
    found = F.col("pinned_query").isNotNull()
    base = violations(
        rows,
        F.col("interaction_id"),
        [
            ("question_unknown", ~found, F.col("interaction_id")),
            ("status_unknown", _outside("status", STATUSES), F.col("status")),
            ("validation_flag_missing", F.col("human_validated").isNull(), F.lit("flag")),
            (
                "validation_flag_contradicts",
                F.col("human_validated").isNotNull() & ~F.col("human_validated").eqNullSafe(reviewed),
                F.col("status"),
            ),
            ("notes_missing", F.col("notes").isNull(), F.lit("notes")),
            (
                "draft_identity_differs",
                found
                & (
                    ~F.col("draft.interaction_id").eqNullSafe(F.col("interaction_id"))
                    | ~F.col("draft.query").eqNullSafe(F.col("pinned_query"))
                ),
                F.col("draft.interaction_id"),
            ),
            (
                "draft_status_changed",
                ~F.col("draft.human_validated").eqNullSafe(F.lit(False))
                | ~F.col("draft.status").eqNullSafe(F.lit("ai_assisted_draft")),
                F.col("draft.status"),
            ),
            ("inspection_shape", shape, F.size("inspected_excerpts")),
            (
                "reviewed_without_attestation",
                reviewed & (~F.coalesce("attested", F.lit(False)) | ~all_inspected),
                F.col("status"),
            ),
        ],
    )
    source = pages.select(
        "interaction_id",
        "page_index",
        F.col("page_url").alias("raw_url"),
        *[F.col(f).alias(f"raw_{f}") for f in FIELDS],
    )
    refs = reviews.select(
        "interaction_id", F.posexplode("draft.references").alias("position", "r")
    ).select("interaction_id", "position", "r.*")
    joined = refs.join(source, ["interaction_id", "page_index"], "left")
    text = F.when(F.col("field") == FIELDS[0], F.col(f"raw_{FIELDS[0]}")).when(
        F.col("field") == FIELDS[1], F.col(f"raw_{FIELDS[1]}")
    )
    start, end = F.col("char_start"), F.col("char_end")
    inside = (start >= 0) & (start < end) & (end <= F.length("text"))
    page = F.col("raw_url").isNotNull()
    spans = joined.withColumn("text", text).withColumn(
        "slice", F.substring(text, start + 1, end - start)
    )
    quoted = violations(
        spans,
        F.concat_ws("/", "interaction_id", "position"),
        [
            ("page_out_of_range", ~page, F.col("page_index")),
            ("field_unsupported", _outside("field", FIELDS), F.col("field")),
            ("span_out_of_range", page & F.col("text").isNotNull() & ~inside, F.col("char_end")),
            ("source_url_differs", page & (F.col("raw_url") != F.col("source_url")), F.lit("url")),
            (
                "quote_differs",
                page & F.coalesce(inside, F.lit(False)) & ~F.col("slice").eqNullSafe(F.col("quote")),
                F.col("char_start"),
            ),
        ],
    )
    return base.unionByName(quoted).unionByName(_repeated(reviews, "interaction_id"))


def generated_review_violations(reviews: DataFrame, predictions: DataFrame) -> DataFrame:
    """Verdicts bound to the stored prediction and prompt, with consistent abstentions."""
    keys = ["interaction_id", "policy"]
    original = predictions.select(
        *keys,
        F.col("prediction").alias("raw_prediction"),
        F.col("prompt_sha256").alias("raw_prompt"),
        F.col("evaluation.outcome").alias("outcome"),
    )
    rows = reviews.join(original, keys, "left")
    decided = F.col("decision") != "pending"
    abstained = F.col("decision") == "abstained"
    known = F.col("raw_prompt").isNotNull()
    not_applicable = F.col("support") == "not_applicable"
    found = violations(
        rows,
        F.concat_ws("/", *keys),
        [
            ("prediction_unknown", ~known, F.col("policy")),
            (
                "prediction_differs",
                known
                & (
                    ~F.col("prediction").eqNullSafe(F.col("raw_prediction"))
                    | ~F.col("prompt_sha256").eqNullSafe(F.col("raw_prompt"))
                ),
                F.col("policy"),
            ),
            ("decision_unknown", _outside("decision", DECISIONS), F.col("decision")),
            ("support_unknown", _outside("support", SUPPORTS), F.col("support")),
            ("notes_missing", F.col("notes").isNull(), F.lit("notes")),
            ("attestation_missing", F.col("attested").isNull(), F.lit("attested")),
            (
                "decided_without_attestation",
                decided & (~F.coalesce("attested", F.lit(False)) | (F.col("support") == "pending")),
                F.col("decision"),
            ),
            (
                "abstention_contradicts",
                known & decided & (abstained != (F.col("outcome") == "abstained")),
                F.col("decision"),
            ),
            ("abstention_support", abstained & ~not_applicable, F.col("support")),
            (
                "answer_needs_support",
                ~F.col("decision").isin("pending", "abstained") & not_applicable,
                F.col("decision"),
            ),
        ],
    )
    return found.unionByName(_repeated(reviews, *keys))


def decision_violations(reviews: DataFrame, candidates: DataFrame, packet_sha256: str) -> DataFrame:
    """Candidate-evidence decisions against the packet they were made on.

    ``candidates``: (interaction_id, evidence_id) of the packet, one row each; members of the
    acceptable sets are checked by an anti join. Each review carries the packet hash it names.
    """
    yes = F.lit(True)
    questions = candidates.select("interaction_id").distinct().withColumn("known", yes)
    members = reviews.select(
        "interaction_id",
        F.explode(F.flatten(F.filter("acceptable_sets", lambda g: g.isNotNull()))).alias(
            "evidence_id"
        ),
    ).distinct()
    strangers = members.join(
        candidates.select("interaction_id", "evidence_id").distinct(),
        ["interaction_id", "evidence_id"],
        "left_anti",
    )
    strange = strangers.select("interaction_id").distinct().withColumn("strange", yes)
    rows = reviews.join(questions, "interaction_id", "left").join(strange, "interaction_id", "left")
    sets = F.col("acceptable_sets")
    bad_set = F.coalesce("strange", F.lit(False)) | F.exists(
        sets,
        lambda g: g.isNull()
        | (F.size(g) == 0)
        | F.exists(g, lambda x: x.isNull())
        | (F.size(F.array_distinct(g)) != F.size(g)),
    )
    same = F.size(F.array_distinct(F.transform(sets, lambda g: F.array_sort(g)))) != F.size(sets)
    reviewed = F.col("status") == "reviewed"
    known = F.col("known").isNotNull()
    unresolved = (
        ~F.coalesce("attested", F.lit(False))
        | is_blank(F.coalesce("requirements", F.lit("")))
        | F.col("answerability").isin("pending", "uncertain")
    )
    supported = F.col("answerability") == "supported_by_candidates"
    found = violations(
        rows,
        F.col("interaction_id"),
        [
            (
                "packet_differs",
                ~F.col("packet_sha256").eqNullSafe(F.lit(packet_sha256)),
                F.col("packet_sha256"),
            ),
            ("question_unknown", ~known, F.col("interaction_id")),
            ("status_unknown", _outside("status", STATUSES), F.col("status")),
            (
                "answerability_unknown",
                _outside("answerability", ANSWERABILITY),
                F.col("answerability"),
            ),
            (
                "text_or_attestation_missing",
                F.col("attested").isNull()
                | F.col("requirements").isNull()
                | F.col("notes").isNull(),
                F.lit("fields"),
            ),
            ("sets_missing", sets.isNull(), F.lit("acceptable_sets")),
            ("set_invalid", known & bad_set, F.size(sets)),
            ("set_repeated", same, F.size(sets)),
            ("reviewed_unresolved", reviewed & unresolved, F.col("answerability")),
            (
                "sets_contradict_answerability",
                reviewed & (supported != (F.size(sets) > 0)),
                F.size(sets),
            ),
        ],
    )
    return found.unionByName(_repeated(reviews, "interaction_id"))
