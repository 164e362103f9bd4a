"""Date-gated source routing with one shared evidence budget.

A question's plan depends on that question and a short capability list only, so hints, gate,
policies and apportionment are column expressions on the question row: no join, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import is_int, require, violations
from ..functions.text import asked_date, bounded, casefold, let, query_date, query_moment

POLICIES = ("fixed_web", "all_available", "adaptive")
CAPABILITY = "array<struct<name:string,available:boolean,requires_as_of:boolean,as_of_date:date>>"

# Keyword families per source, counted on the folded question.
HINT_PATTERNS = {
    "finance_market_cap": r"market cap(?:italization)?s?",
    "finance_ticker": r"ticker",
    "finance_prices": r"stock price|share price|best performer|daily moves|price change",
    "sports_stats": r"per game|3-point|three-point|batting|touchdowns",
    "movie_knowledge": r"movie|film|oscar",
    "company_history": r"ceo|previously work|prior employer",
}
HISTORICAL_PATTERN = r"historical|decade|over time|when|past years"


@dataclass(frozen=True)
class Capability:
    name: str
    available: bool
    requires_as_of: bool
    as_of_date: str | None = None

    def __post_init__(self) -> None:
        require(bool(self.name), "capability needs a name")
        require(
            isinstance(self.available, bool) and isinstance(self.requires_as_of, bool),
            "capability needs explicit availability and time flags",
        )
        if self.as_of_date is not None:
            date.fromisoformat(self.as_of_date)


def capability_array(capabilities: Sequence[Capability]) -> Column:
    """A short capability list as a literal column."""
    names = [c.name for c in capabilities]
    require(
        len(set(names)) == len(names) and "web" in names,
        "capability names must differ and one must be web",
    )
    rows = [
        F.struct(
            F.lit(c.name).alias("name"),
            F.lit(c.available).alias("available"),
            F.lit(c.requires_as_of).alias("requires_as_of"),
            F.lit(c.as_of_date).cast("date").alias("as_of_date"),
        )
        for c in capabilities
    ]
    return F.array(*rows).cast(CAPABILITY)


def source_hints(query: Column | str) -> Column:
    """Keyword hits per source as sorted (name, weight) structs; ``web`` always counts 1.

    A market-cap question about the past asks for a time series, not for the snapshot.
    """

    def hits(text: Column, pattern: str) -> Column:
        """A pattern is only tried on a text that holds the start of one of its choices."""
        held = [text.contains(re.match(r"[a-z0-9 -]+(?![?*{])", choice)[0]) for choice in pattern.split("|")]
        return F.when(reduce(or_, held), F.regexp_count(text, F.lit(bounded(pattern)))).otherwise(0)

    def weighed(text: Column, market: Column) -> Column:
        past = (market > 0) & text.rlike(bounded(HISTORICAL_PATTERN))
        weights = {name: hits(text, p) for name, p in HINT_PATTERNS.items() if name != "finance_market_cap"}
        weights["finance_market_cap"] = F.when(past, 0).otherwise(market)
        weights["finance_timeseries"] = F.when(past, 1).otherwise(0)
        weights["web"] = F.lit(1)
        entries = F.array(
            *[
                F.struct(F.lit(name).alias("name"), weight.cast("int").alias("weight"))
                for name, weight in sorted(weights.items())
            ]
        )
        return F.filter(entries, lambda e: e["weight"] > 0)

    market = lambda text: hits(text, HINT_PATTERNS["finance_market_cap"])
    return let(casefold(query), lambda text: let(market(text), lambda n: weighed(text, n)))


def gate(capabilities: Column, asked: Column) -> Column:
    """(name, reason) per capability; a null reason means eligible on the question's date.

    Without a readable date no dated source is eligible.
    """

    def judged(c: Column, day: Column) -> Column:
        late = c["requires_as_of"] & ~c["as_of_date"].eqNullSafe(day)
        return F.struct(
            c["name"].alias("name"),
            F.when(~c["available"], "unavailable")
            .when(c["requires_as_of"] & c["as_of_date"].isNull(), "snapshot_date_unknown")
            .when(late, "snapshot_date_mismatch")
            .alias("reason"),
        )

    return let(asked, lambda day: F.transform(capabilities, lambda c: judged(c, day)))


def apportion(sources: Column, budget: Column) -> Column:
    """Largest-remainder split of ``budget`` over (name, weight) structs; zero shares drop.

    Leftover units go to the largest remainders, ties to the smaller name. A single source gets the
    whole budget; nothing is sorted for it, nor where nothing is left over.
    """

    def split(total: Column) -> Column:
        part = lambda s: F.struct(
            s["name"].alias("name"),
            F.floor(budget * s["weight"] / total).cast("int").alias("tokens"),
            ((budget * s["weight"]) % total).alias("over"),
        )
        return let(F.transform(sources, part), lambda parts: let(left_of(parts), lambda left: hand_out(parts, left)))

    def left_of(parts: Column) -> Column:
        return budget - F.aggregate(parts, F.lit(0), lambda acc, p: acc + p["tokens"])

    def hand_out(parts: Column, left: Column) -> Column:
        order = F.sort_array(F.transform(parts, lambda p: F.struct(-p["over"], p["name"])))
        lucky = F.transform(F.slice(order, F.lit(1), left), lambda r: r["name"])
        plain = F.transform(parts, lambda p: F.struct(p["name"].alias("name"), p["tokens"].alias("tokens")))
        more = lambda extra: F.transform(
            parts,
            lambda p: F.struct(p["name"].alias("name"), (p["tokens"] + F.array_contains(extra, p["name"]).cast("int")).alias("tokens")),
        )
        return F.when(left > 0, let(lucky, more)).otherwise(plain)

    total = F.aggregate(sources, F.lit(0), lambda acc, s: acc + s["weight"])
    first = F.get(sources, F.lit(0))
    alone = F.array(F.struct(first["name"].alias("name"), budget.cast("int").alias("tokens")))
    shares = F.when((F.size(sources) == 1) & (first["weight"] > 0), alone).when(F.size(sources) > 0, let(total, split))
    kept = F.filter(shares, lambda s: s["tokens"] > 0)
    return F.coalesce(kept, F.array().cast("array<struct<name:string,tokens:int>>"))


def route(
    questions: DataFrame,
    capabilities: Sequence[Capability] | Column,
    total_budget: int,
    reserved: int | Column,
    policies: Sequence[str] = POLICIES,
    carry: tuple[str, ...] = (),
    strict: bool = True,
) -> DataFrame:
    """One plan per question and policy.

    A question whose time is not readable stops the query; with ``strict=False`` it only loses its
    dated sources, and ``question_violations`` reports it.

    ``capabilities`` is a short list for all questions or a column with each question's own.
    ``reserved`` may be a column when every question reserves its own prompt.
    """
    require(set(policies) <= set(POLICIES), "unknown routing policy")
    require(is_int(total_budget), "the total budget has to be a whole number")
    if isinstance(reserved, Column):
        unfit = F.coalesce((reserved < 0) | (reserved >= total_budget), F.lit(True))
        reserved = F.when(
            unfit, F.raise_error(F.lit("a question's reserve takes the whole budget")).cast("int")
        ).otherwise(reserved)
    else:
        require(is_int(reserved), "the reserve has to be a whole number")
        require(0 <= reserved < total_budget, "the reserve takes the whole budget")
        reserved = F.lit(reserved)
    if not isinstance(capabilities, Column):
        capabilities = capability_array(capabilities)
    gated = questions.select(
        "interaction_id",
        *carry,
        source_hints("query").alias("hints"),
        gate(capabilities, (asked_date if strict else query_date)("query_time")).alias("gate"),
        reserved.cast("int").alias("reserved_tokens"),
    )
    names = lambda rows: F.transform(rows, lambda r: r["name"])
    eligible = F.sort_array(names(F.filter("gate", lambda g: g["reason"].isNull())))
    listed = gated.withColumn("eligible", eligible).withColumn("asked", names(F.col("hints")))
    reasons = F.map_from_entries("gate")
    blocked = F.transform(
        F.filter("asked", lambda h: ~F.array_contains("eligible", h)),
        lambda h: F.named_struct(
            F.lit("name"),
            h,
            F.lit("reason"),
            F.coalesce(F.element_at(reasons, h), F.lit("capability_not_provisioned")),
        ),
    )
    equal = lambda rows: F.transform(
        rows, lambda n: F.named_struct(F.lit("name"), n, F.lit("weight"), F.lit(1))
    )
    chosen = {
        "fixed_web": equal(F.filter("eligible", lambda n: n == "web")),
        "all_available": equal(F.col("eligible")),
        "adaptive": F.filter("hints", lambda h: F.array_contains("eligible", h["name"])),
    }
    plans = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("policy"), chosen[p].alias("sources"))
                for p in policies
            ]
        )
    )
    budget = F.lit(total_budget) - F.col("reserved_tokens")
    rows = listed.select(
        "interaction_id", *carry, "asked", blocked.alias("blocked_hints"), "reserved_tokens",
        plans.alias("p"),
    )
    allocated = rows.withColumn(
        "allocations", let(F.col("p.sources"), lambda s: apportion(s, budget))
    )
    return allocated.select(
        "interaction_id",
        *carry,
        "p.policy",
        F.col("asked").alias("requested_hints"),
        "blocked_hints",
        "allocations",
        budget.alias("evidence_budget"),
        "reserved_tokens",
        F.lit(total_budget).alias("total_budget"),
        F.size("allocations").alias("max_source_calls"),
        F.lit("not_executed").alias("execution_status"),
    )


def question_violations(questions: DataFrame) -> DataFrame:
    return violations(
        questions,
        F.col("interaction_id"),
        [("query_time_format", query_moment("query_time").isNull(), F.col("query_time"))],
    )


def capability_violations(rows: DataFrame) -> DataFrame:
    """Rules for a capability table whose fields arrive as text (flags and dates unparsed)."""
    flag = lambda c: ~F.coalesce(F.lower(F.col(c)).isin("true", "false"), F.lit(False))
    return violations(
        rows,
        F.col("location"),
        [
            ("name_missing", F.coalesce(F.col("name"), F.lit("")) == "", F.lit("name")),
            ("available_not_boolean", flag("available"), F.col("available")),
            ("requires_as_of_not_boolean", flag("requires_as_of"), F.col("requires_as_of")),
            (
                "as_of_date_not_iso",
                F.col("as_of_date").isNotNull()
                & F.try_to_date("as_of_date", "yyyy-MM-dd").isNull(),
                F.col("as_of_date"),
            ),
        ],
    )


def routing_summary(plans: DataFrame) -> DataFrame:
    """Counts per section: blocked hints (adaptive plans), allocated sources, equal plans."""
    blocked = plans.where(F.col("policy") == "adaptive").select(
        F.lit("blocked_hint").alias("section"),
        F.explode(
            F.transform("blocked_hints", lambda b: F.concat(b["name"], F.lit(":"), b["reason"]))
        ).alias("key"),
    )
    allocated = plans.select(
        F.lit("allocated_source").alias("section"),
        F.explode(
            F.transform("allocations", lambda a: F.concat(F.col("policy"), F.lit(":"), a["name"]))
        ).alias("key"),
    )
    shape = F.concat_ws(
        ",", F.transform("allocations", lambda a: F.concat_ws(":", a["name"], a["tokens"]))
    )
    per_question = plans.groupBy("interaction_id").agg(
        F.min(shape).alias("low"), F.max(shape).alias("high"), F.count("*").alias("n")
    )
    overall = per_question.agg(
        F.count("*").alias("questions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("plans"),
        F.count_if(F.col("low") == F.col("high")).alias("equivalent_allocations"),
    )
    totals = overall.select(
        F.lit("total").alias("section"),
        F.expr(
            "stack(3, 'questions', questions, 'plans', plans,"
            " 'equivalent_allocations', equivalent_allocations) as (key, n)"
        ),
    )
    counted = blocked.unionByName(allocated).groupBy("section", "key").agg(F.count("*").alias("n"))
    return counted.unionByName(totals)
