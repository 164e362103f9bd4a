"""Prior-day price requests and evidence without look-ahead, and source provisioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import asked_date, bounded, casefold, content_hash, let, terms
from .routing import CAPABILITY, source_hints

# What a prior-close question must say, must not say, and how it names a ticker.
PRIOR_CLOSE_REQUIRED = (r"price", r"yesterday|previous day", r"close|closing")
PRIOR_CLOSE_EXCLUDED = (
    r"and|or|than|versus|compared|compare|higher|lower|week|month|ratio"
)
POSSESSIVE = r"([a-z][a-z0-9]{2,5})['’]s"
TICKER_WORD = r"[A-Z][A-Z0-9]{2,}"
# The names the price executor knows.
ALIASES = {"apple": "AAPL", "microsoft": "MSFT", "tesla": "TSLA"}
LIMITATION = "Currency and adjustment basis are not established by this row."


def _all(pattern: str) -> Column:
    return F.lit(bounded(pattern))


def prior_close_intent(query: Column | str) -> Column:
    """True for a single-entity question about yesterday's closing price."""

    def intent(text: Column) -> Column:
        wanted = F.lit(True)
        for pattern in PRIOR_CLOSE_REQUIRED:
            wanted = wanted & text.rlike(bounded(pattern))
        return wanted & ~text.rlike(bounded(PRIOR_CLOSE_EXCLUDED))

    return let(casefold(query), intent)


def possessive_tickers(query: Column | str) -> Column:
    found = F.regexp_extract_all(casefold(query), _all(POSSESSIVE), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.upper(t)))


def prior_close_requests(questions: DataFrame, inventory: DataFrame) -> DataFrame:
    """Requests (ticker, requested_date, available_as_of) for questions that ask for one.

    The intent test runs on the question row, so only the few that pass meet the inventory.
    Exactly one possessive ticker must be known.
    """
    named = questions.where(prior_close_intent("query")).select(
        "interaction_id",
        asked_date("query_time").alias("available_as_of"),
        F.explode(possessive_tickers("query")).alias("ticker"),
    )
    known = named.join(inventory.select("ticker").distinct(), "ticker", "left_semi")
    return (
        known.groupBy("interaction_id", "available_as_of")
        .agg(F.count("*").alias("n"), F.min("ticker").alias("ticker"))
        .where(F.col("n") == 1)
        .select(
            "interaction_id",
            "ticker",
            F.date_sub("available_as_of", 1).alias("requested_date"),
            "available_as_of",
        )
    )


def prior_close_evidence(requests: DataFrame, prices: DataFrame, snapshot: str) -> DataFrame:
    """Exact-date join of requests with the price row; a missing day stays missing.

    The requested day is strictly before the availability date, so nothing the question could
    not have known is attached. Two rows for a requested day, or a row stamped with another one,
    stop the query.
    """
    rows = prices.groupBy("ticker", F.col("date").alias("requested_date")).agg(
        F.count("*").alias("n_rows"), F.min("row_timestamp").alias("row_timestamp"), F.min("close").alias("close")
    )
    stamped = F.substring("row_timestamp", 1, 10).eqNullSafe(F.date_format("requested_date", "yyyy-MM-dd"))
    broken = F.concat(F.lit("not one price row of its own day: "), "ticker", F.lit(" "), F.col("requested_date").cast("string"))
    rows = rows.withColumn(
        "close", F.when((F.col("n_rows") > 1) | ~stamped, F.raise_error(broken).cast("double")).otherwise(F.col("close"))
    )
    joined = requests.join(rows, ["ticker", "requested_date"]).where(
        F.col("requested_date") < F.col("available_as_of")
    )
    day = F.date_format("requested_date", "yyyy-MM-dd")
    return joined.select(
        "interaction_id",
        F.concat(
            "ticker", F.lit(" closing price on "), day, F.lit(": "), F.col("close").cast("string")
        ).alias("content"),
        F.concat_ws(
            "/", F.lit(f"snapshot:{snapshot}"), F.lit("finance_price"), "ticker", "row_timestamp"
        ).alias("source_ref"),
        "ticker",
        "requested_date",
        "row_timestamp",
        "available_as_of",
        "close",
        F.lit(snapshot).alias("snapshot_sha256"),
        F.lit(LIMITATION).alias("limitations"),
    )


def evidence_identity() -> Column:
    """Content-addressed id of a structured evidence row."""
    return content_hash("ticker", "requested_date", "row_timestamp", "content", "source_ref")


def entity_symbols(query: Column | str) -> Column:
    """Known tickers named in the question by company name or symbol, whole words only."""
    names = {**ALIASES, **{symbol.lower(): symbol for symbol in ALIASES.values()}}

    def found(text: Column) -> Column:
        hits = [
            F.when(text.rlike(bounded(name)), F.lit(symbol)) for name, symbol in names.items()
        ]
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))

    return let(F.lower(query), found)


def alias_dictionary(aliases: DataFrame) -> tuple[DataFrame, list[int]]:
    """((key, symbol), the numbers of words that aliases have) of a table (alias, symbol).

    Aliases are reduced to their words, folded and joined by single spaces; that key is what question
    n-grams are joined with. An alias without a word names nothing and is left out.
    """
    words = terms("alias")
    keyed = aliases.where(F.size(words) > 0).select(F.array_join(words, " ").alias("key"), "symbol", F.size(words).alias("n"))
    sizes = sorted(keyed.agg(F.collect_set("n")).first()[0])
    return keyed.select("key", "symbol").distinct(), sizes


def named_entities(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(interaction_id, symbol) for every alias that a question holds as whole words.

    The question's word n-grams, of the lengths that aliases have, meet the dictionary in one equi-join,
    so its size does not matter to the question row and no pattern is tried for each alias. Repeats of an
    n-gram leave by the distinct at the end, which is on the few rows that met an alias.
    """
    dictionary, sizes = alias_dictionary(aliases)
    if not sizes:
        return questions.select("interaction_id", F.lit("").alias("symbol")).limit(0)

    def grams(words: Column) -> Column:
        first = lambda n: F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        run = lambda n: lambda word, i: F.concat_ws(" ", word, *[F.get(words, i + k) for k in range(1, n)])
        return F.concat(*[words if n == 1 else F.transform(first(n), run(n)) for n in sizes])

    asked = questions.select("interaction_id", F.explode(let(terms("query"), grams)).alias("key"))
    return asked.join(dictionary, "key").select("interaction_id", "symbol").distinct()


def expansion_symbols(questions: DataFrame, inventory: DataFrame) -> DataFrame:
    """(interaction_id, ticker) for exact inventory words in price-hinted questions."""
    hinted = questions.where(price_hinted("query"))
    words = F.regexp_extract_all(F.upper("query"), F.lit(f"({bounded(TICKER_WORD)})"), F.lit(1))
    named = hinted.select("interaction_id", F.explode(F.array_distinct(words)).alias("ticker"))
    return named.join(inventory.select("ticker").distinct(), "ticker", "left_semi").select(
        "interaction_id", "ticker"
    )


def price_hinted(query: Column | str) -> Column:
    return F.exists(source_hints(query), lambda h: h["name"] == "finance_prices")


def _roles(questions: DataFrame) -> DataFrame:
    """(interaction_id, role, ticker, date) for every ticker a question may mean, as one tall table."""
    day = asked_date("query_time")
    words = F.regexp_extract_all(F.upper("query"), F.lit(f"({bounded(TICKER_WORD)})"), F.lit(1))
    none = F.array().cast("array<string>")

    def role(name: str, tickers: Column, day: Column) -> Column:
        return F.transform(
            tickers, lambda t: F.struct(F.lit(name).alias("role"), t.alias("ticker"), day.alias("date"))
        )

    entities = entity_symbols("query")
    named = F.concat(
        role("entity", F.when(F.size(entities) == 1, entities).otherwise(none), day),
        role("expansion", F.when(price_hinted("query"), F.array_distinct(words)).otherwise(none), day),
        role("prior", F.when(prior_close_intent("query"), possessive_tickers("query")).otherwise(none), F.date_sub(day, 1)),
    )
    return questions.select("interaction_id", F.explode(named).alias("r")).select("interaction_id", "r.*")


def price_eligibility(
    questions: DataFrame, prices: DataFrame, snapshot: str
) -> tuple[DataFrame, DataFrame]:
    """Per-question eligibility details and their totals.

    Details: hinted, single known entity, its same-day availability, single expansion candidate with a
    same-day row, and the prior-close request with or without evidence. Every ticker a question may mean
    is a row of a tall table, which meets the price days once; its roles are folded back by one
    grouping, where a role with two known tickers is ambiguous and counts as none. An unreadable question
    time, two price rows of one day or a row stamped with another day stop the query.
    """
    stamped = F.substring("row_timestamp", 1, 10).eqNullSafe(F.date_format("date", "yyyy-MM-dd"))
    broken = F.concat(F.lit("not one price row of its own day: "), "ticker", F.lit(" "), F.col("date").cast("string"))
    days = prices.groupBy("ticker", "date").agg(F.count("*").alias("n"), F.bool_and(stamped).alias("own_day")).select(
        "ticker", F.struct(
            "date", F.when((F.col("n") > 1) | ~F.col("own_day"), F.raise_error(broken).cast("boolean")).otherwise(F.lit(True)).alias("sound")
        ).alias("day"),
    )
    # One row per ticker; its days are as many as a history has and do not grow with the questions.
    histories = days.groupBy("ticker").agg(F.map_from_entries(F.collect_list("day")).alias("days"))
    tall = _roles(questions).join(histories, "ticker").select(
        "interaction_id", "role", "ticker", F.coalesce(F.element_at("days", F.col("date")), F.lit(False)).alias("has_day")
    )
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    many = lambda role: F.count_if(F.col("role") == role)
    folded = tall.groupBy("interaction_id").agg(
        pick("entity", "has_day").alias("date_eligible"),
        F.when((many("expansion") == 1) & pick("expansion", "has_day"), pick("expansion", "ticker")).alias("expansion_ticker"),
        F.when(many("prior") == 1, pick("prior", "ticker")).alias("prior_close_ticker"),
        ((many("prior") == 1) & pick("prior", "has_day")).alias("prior_close_supported"),
    )
    base = questions.select(
        "interaction_id",
        asked_date("query_time").alias("date"),
        price_hinted("query").alias("price_hinted"),
        (F.size(entity_symbols("query")) == 1).alias("single_entity"),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    detail = base.join(folded, "interaction_id", "left").select(
        "interaction_id", "date", "price_hinted", "single_entity", yes("date_eligible"), "expansion_ticker",
        "prior_close_ticker", yes("prior_close_supported"),
    )
    totals = detail.agg(
        F.count("*").alias("questions"),
        F.count_if("price_hinted").alias("price_hinted_questions"),
        F.count_if("single_entity").alias("single_entity_questions"),
        F.count_if("date_eligible").alias("date_eligible"),
        F.count_if(F.col("date_eligible") & F.col("price_hinted")).alias(
            "date_eligible_and_hinted"
        ),
        F.count("expansion_ticker").alias("expansion_candidates"),
        F.count("prior_close_ticker").alias("prior_close_prepared"),
        F.count_if("prior_close_supported").alias("prior_close_supported"),
    )
    return detail, totals


def provision(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Questions with dated evidence, each with capabilities dated to that question."""
    dated = evidence.select("interaction_id", "available_as_of")
    capabilities = F.array(
        F.struct(
            F.lit("web").alias("name"),
            F.lit(True).alias("available"),
            F.lit(False).alias("requires_as_of"),
            F.lit(None).cast("date").alias("as_of_date"),
        ),
        F.struct(
            F.lit("finance_prices").alias("name"),
            F.lit(True).alias("available"),
            F.lit(True).alias("requires_as_of"),
            F.col("available_as_of").alias("as_of_date"),
        ),
    ).cast(CAPABILITY)
    return questions.join(dated, "interaction_id").withColumn("capabilities", capabilities)
