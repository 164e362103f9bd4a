"""Spark views with the shapes the operators take, over the whole driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.asof import prior_close_evidence, prior_close_requests
from sieveline.operators.routing import Capability
from sieveline.plans.lineage import fan_out, share
from sieveline.sources.prices import daily_prices

SNAPSHOT = "desk-prices"
TEMPLATES = (
    "At which price did {t}'s shares close yesterday?",
    "Name the closing price of {t}'s stock for the previous day.",
    "How does {t}'s share price look this morning?",
    "Which price did {t}'s stock open at yesterday?",
    "Did {t}'s closing price of yesterday end lower compared with MSFT?",
    "Give {t}'s closing price for the month before yesterday.",
    "Yesterday {t}'s closing price beat MSFT's, and by how much?",
    "Which closing price did the index have on the previous day?",
    "How has the market capitalization of Microsoft moved over the past decade?",
    "List the ticker, the market cap, plus all market caps that {t} had",
    "Is there a film with the CEO of Tesla, plus a stock price of {t}?",
    "How many touchdowns, how many points per game, for AAPL?",
)
DESK_TEMPLATES = (TEMPLATES[0], TEMPLATES[1], TEMPLATES[2], TEMPLATES[9])
CAPABILITIES = (
    Capability("web", True, False),
    Capability("finance_market_cap", True, True, "2024-01-15"),
    Capability("finance_ticker", True, True),
    Capability("finance_prices", False, True, "2024-01-10"),
    Capability("sports_stats", True, False),
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def questions(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") % 30).cast("int"))
    return table(spark, d, "benchmark").select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("interaction_id"),
        F.col("text").alias("query"),
        F.concat(F.date_format(day, "MM/dd/yyyy"), F.lit(", 23:18:31 PT")).alias("query_time"),
        "item_id",
    )


def _page_rows(spark: SparkSession, d: str, owner: Column, index: Column) -> DataFrame:
    web = table(spark, d, "pages")
    n_pages = web.count()
    docs = table(spark, d, "documents")
    # dealt by the key of the join, so that a large table of addresses does not move the texts again
    keyed = fan_out(docs.withColumn("page_id", F.col("doc_id") % n_pages), "page_id")
    return keyed.join(web.select("page_id", "url"), "page_id").select(
        owner.alias("interaction_id"),
        index.cast("int").alias("page_index"),
        F.col("source").alias("page_name"),
        F.col("url").alias("page_url"),
        F.substring("text", 1, 200).alias("page_snippet"),
        F.col("text").alias("page_result"),
        F.col("lang").alias("page_last_modified"),
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document is a page of one benchmark question."""
    n = table(spark, d, "benchmark").count()
    return _page_rows(
        spark,
        d,
        F.concat(F.lit("q"), (F.col("doc_id") % n).cast("string")),
        F.expr(f"doc_id div {n}"),
    )


def _texts(spark: SparkSession, d: str, n: int, prefix: str) -> DataFrame:
    """Texts of the pages where they are stored: what a lookup by page needs, without address or exchange."""
    return table(spark, d, "documents").select(
        F.concat(F.lit(prefix), (F.col("doc_id") % n).cast("string")).alias("interaction_id"),
        F.expr(f"doc_id div {n}").cast("int").alias("page_index"),
        F.substring("text", 1, 200).alias("page_snippet"),
        F.col("text").alias("page_result"),
    )


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, table(spark, d, "benchmark").count(), "q")


def desk_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, table(spark, d, "events").agg(F.max("user_id") + 1).first()[0], "u")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def vector_pools(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, grouped into one pool per benchmark question; the question has its own."""
    n = table(spark, d, "benchmark").count()
    rows = vectors(spark, d)
    pool = rows.select(
        F.concat(F.lit("q"), (F.col("vec_id") % n).cast("string")).alias("interaction_id"),
        F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("evidence_id"),
        F.col("embedding").alias("vector"),
        (F.col("vec_id") % 37 + 20).cast("int").alias("word_count"),
    )
    asked = questions(spark, d).select("interaction_id", F.col("item_id").alias("vec_id"))
    own = asked.join(rows, "vec_id").select("interaction_id", F.col("embedding").alias("vector"))
    return pool, own


def ticker(user: str = "user_id") -> Column:
    return F.concat(F.lit("U"), F.lpad(F.col(user).cast("string"), 4, "0"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    ticks = table(spark, d, "events").select(
        ticker().alias("ticker"), F.to_date("ts").alias("date"), "ts", "event_id", "value"
    )
    daily = daily_prices(ticks, ("ticker", "date"), ("ts", "event_id"))
    stamp = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 00:00:00-05:00"))
    return daily.withColumn("row_timestamp", stamp)


def histories(spark: SparkSession, d: str) -> DataFrame:
    """One nested entry per event; some entries break the price rules by their event type."""
    stamp = F.when(F.col("event_type") == "error", F.lit("unknown")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    close = F.when(F.col("event_type") == "signup", F.lit(float("nan"))).otherwise(F.col("value"))
    full = F.create_map(F.lit("Open"), F.col("value"), F.lit("Close"), close)
    half = F.create_map(F.lit("Open"), F.col("value"))
    fields = F.when(F.col("event_type") == "view", half).otherwise(full)
    return table(spark, d, "events").select(
        ticker().alias("ticker"), "event_id", F.create_map(stamp, fields).alias("history")
    )


def _filled(template: Column) -> Column:
    return F.replace(template, F.lit("{t}"), F.col("ticker"))


def _pick(index: Column, texts: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (index + 1).cast("int"))


def price_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = fan_out(table(spark, d, "events").select("event_id", "ts", "user_id"), "event_id").select(
        "event_id", "ts", ticker().alias("ticker"), F.to_date("ts").alias("date")
    )
    return rows.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("interaction_id"),
        _filled(_pick(F.col("event_id") % len(TEMPLATES), TEMPLATES)).alias("query"),
        F.concat(F.date_format("ts", "MM/dd/yyyy, HH:mm:ss"), F.lit(" PT")).alias("query_time"),
        "event_id",
        "ticker",
        "date",
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    asked = price_questions(spark, d)
    return prior_close_requests(asked, prices(spark, d).select("ticker"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return prior_close_evidence(requests(spark, d), prices(spark, d), SNAPSHOT)


def _policies() -> Column:
    return F.explode(F.array(*[F.lit(p) for p in ("fixed_web", "all_available", "adaptive")]))


def answer(style: Column) -> Column:
    """Prediction texts of six kinds around the known close."""
    close = F.coalesce(F.col("close").cast("string"), F.lit("0.5"))
    day = F.date_format("requested_date", "yyyy-MM-dd")
    sentence = F.concat(
        "ticker", F.lit("'s closing price yesterday ("), day, F.lit(") was "), close, F.lit(".")
    )
    return (
        F.when(style == 0, close)
        .when(style == 1, F.round("close").cast("int").cast("string"))
        .when(style == 2, F.concat(F.lit("$"), close))
        .when(style == 3, sentence)
        .when(style == 4, F.lit("I don't know."))
        .otherwise(F.concat(F.lit("about "), close))
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three policies for every prior-close question, with stored traces of a run."""
    asked = price_questions(spark, d).select("interaction_id", "query", "event_id")
    wanted, days = share(requests(spark, d)), prices(spark, d)
    known = prior_close_evidence(wanted, days, SNAPSHOT).select("interaction_id", "close", "content")
    rows = (
        wanted
        .join(asked, "interaction_id")
        .join(known, "interaction_id", "left")
        .withColumn("policy", _policies())
    )
    hinted = F.col("query").contains("stock price")
    uses = (F.col("policy") == "all_available") | ((F.col("policy") == "adaptive") & hinted)
    seen = F.when(uses, F.coalesce("content", F.lit(""))).otherwise(F.lit(""))
    n = F.col("event_id")
    traced = rows.select(
        "interaction_id",
        "policy",
        "event_id",
        "query",
        "ticker",
        "requested_date",
        "available_as_of",
        "close",
        (uses & F.col("close").isNotNull()).alias("uses_price"),
        F.coalesce(answer(F.expr("event_id div 12") % 6), F.lit("unknown")).alias("prediction"),
        F.coalesce(answer((F.expr("event_id div 12") + 3) % 6), F.lit("unknown")).alias("second_prediction"),
        F.sha2(F.concat("query", F.lit("|"), seen), 256).alias("prompt_sha256"),
        (n % 50 + 100).cast("int").alias("input_tokens"),
        (n % 20 + 5).cast("int").alias("output_tokens"),
        (n % 10 / 10.0).alias("generation_seconds"),
        (n % 4 / 4.0).alias("retrieval_seconds"),
    )
    return share(traced)


def _claim(value: Column, ref: str, currency: str | None) -> Column:
    return F.struct(
        value.alias("value"),
        F.lit(ref).alias("source_ref"),
        F.lit(currency).cast("string").alias("currency"),
        F.lit(None).cast("string").alias("basis"),
    )


def claims(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims held by each prediction, claims one more lookup would bring).

    Every seventh question has a contradicting copy, every fifth a value in another unit.
    """
    n = F.col("event_id")
    held = F.array_compact(
        F.array(
            F.when(F.col("uses_price"), _claim(F.col("close"), "snapshot", None)),
            F.when(F.col("uses_price") & (n % 7 == 0), _claim(F.col("close") + 1, "mirror", None)),
            F.when(F.col("uses_price") & (n % 5 == 0), _claim(F.col("close") * 2, "other", "USD")),
        )
    )
    keys = ["interaction_id", "policy", "ticker", F.col("requested_date").alias("date")]
    have = rows.select(*keys, F.explode(held).alias("c")).select(
        "interaction_id", "policy", "ticker", "date", "c.*"
    )
    extra = rows.where(F.col("close").isNotNull()).select(
        *keys,
        F.col("close").alias("value"),
        F.lit("snapshot").alias("source_ref"),
        F.lit(None).cast("string").alias("currency"),
        F.lit(None).cast("string").alias("basis"),
    )
    return have, extra


def answer_key(rows: DataFrame) -> DataFrame:
    return rows.select("interaction_id", "policy", "prediction", "ticker", "requested_date",
                       "available_as_of")


def desk_questions(spark: SparkSession, d: str) -> DataFrame:
    """One question per ticker, asked the day after its last event."""
    last = table(spark, d, "events").groupBy("user_id").agg(
        F.date_add(F.to_date(F.max("ts")), 1).alias("asked")
    )
    rows = last.withColumn("ticker", ticker())
    return rows.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("interaction_id"),
        _filled(_pick(F.col("user_id") % len(DESK_TEMPLATES), DESK_TEMPLATES)).alias("query"),
        F.concat(F.date_format("asked", "MM/dd/yyyy"), F.lit(", 09:00:00 PT")).alias("query_time"),
        "user_id",
        "ticker",
    )


def desk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document is a page of one desk question."""
    n = table(spark, d, "events").agg(F.max("user_id") + 1).first()[0]
    return _page_rows(
        spark,
        d,
        F.concat(F.lit("u"), (F.col("doc_id") % n).cast("string")),
        F.expr(f"doc_id div {n}"),
    )


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    label = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "exact_correct")
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), "judge_correct")
        .when((F.col("quality") == 0) & (F.col("toxic") == 0), "miss")
        .otherwise("incorrect")
    )
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return table(spark, d, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", label.alias("outcome")
    )


def _quoted(text: Column) -> Column:
    """JSON string literal of a text."""
    whole = F.to_json(F.struct(text.alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def record_lines(spark: SparkSession, d: str, broken: bool) -> DataFrame:
    """(doc_id, value): one JSON question record per document.

    With ``broken``, eleven of every twelve records carry one defect, chosen by document id.
    """
    kind = F.col("doc_id") % 12 if broken else F.lit(0)
    pick = lambda k, bad, good: F.when(kind == k, F.lit(bad)).otherwise(good)
    numeric = F.col("n_chars").cast("string")
    answer = F.when(F.col("doc_id") % 2 == 0, numeric).otherwise(_quoted(F.col("source")))
    answer = F.when(kind == 3, "null").when(kind == 4, "true").otherwise(answer)
    listed = F.concat(F.lit("["), numeric, F.lit(',"'), numeric, F.lit('","'), "lang", F.lit('"]'))
    alternates = (
        F.when(kind == 5, ', "alt_ans": "x"')
        .when(kind == 10, ', "alt_ans": [2020, true]')
        .when(F.col("doc_id") % 3 == 0, F.concat(F.lit(', "alt_ans": '), listed))
        .otherwise("")
    )
    snippet = pick(6, "null", _quoted(F.substring("text", 1, 200)))
    page = F.concat(
        F.lit('{"page_name": '), _quoted(F.col("source")),
        F.lit(', "page_url": "", "page_snippet": '), snippet,
        F.lit(', "page_result": '), _quoted(F.col("text")),
        F.lit(', "page_last_modified": ""}'),
    )
    pages_json = F.when(kind == 9, F.lit("{}")).otherwise(F.concat(F.lit("["), page, F.lit("]")))
    split = F.when(F.col("doc_id") % 4 != 0, F.lit(', "split": 1')).otherwise("")
    record = F.concat(
        F.lit('{"interaction_id": "d'), F.col("doc_id").cast("string"),
        F.lit('", "query": '), pick(7, '"  "', _quoted(F.concat_ws(" ", "source", "lang"))),
        F.lit(', "query_time": "03/05/2024, 23:18:31 PT", "domain": '),
        pick(8, "5", _quoted(F.col("lang"))),
        F.lit(', "question_type": "simple", "static_or_dynamic": "static", "answer": '), answer,
        alternates, split, F.lit(', "search_results": '), pages_json, F.lit("}"),
    )
    value = (
        F.when(kind == 1, "   ")
        .when(kind == 2, '{"interaction_id": ')
        .when(kind == 11, "[1]")
        .otherwise(record)
    )
    return fan_out(table(spark, d, "documents"), "doc_id").select("doc_id", value.alias("value"))
