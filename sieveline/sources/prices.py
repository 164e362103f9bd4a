"""Dated price rows, market caps and company names as keyed sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import not_finite, require_none, violations

DATE_KEY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} .+$"
REQUIRED_FIELDS = ("Open", "Close")


def price_entries(histories: DataFrame) -> DataFrame:
    """Nested history (ticker, map<row timestamp, map<field, number>>) to one row per entry."""
    return histories.select("ticker", F.explode("history").alias("row_timestamp", "fields"))


def price_violations(histories: DataFrame) -> DataFrame:
    """Entries without a dated key, without Open/Close, or with a value that is not finite."""
    missing = ~F.map_contains_key("fields", "Open") | ~F.map_contains_key("fields", "Close")
    return violations(
        price_entries(histories),
        F.concat_ws("/", "ticker", "row_timestamp"),
        [
            ("dated_key_required", ~F.col("row_timestamp").rlike(DATE_KEY), F.col("row_timestamp")),
            ("open_close_required", missing, F.size("fields")),
            (
                "value_not_finite",
                F.exists(F.map_values("fields"), not_finite),
                F.size("fields"),
            ),
        ],
    )


def flatten_prices(histories: DataFrame, strict: bool = True) -> DataFrame:
    """Flat rows (ticker, row_timestamp, date, open, close); strict mode refuses bad entries."""
    if strict:
        require_none(price_violations(histories))
    return price_entries(histories).select(
        "ticker",
        "row_timestamp",
        F.to_date(F.substring("row_timestamp", 1, 10)).alias("date"),
        F.col("fields")["Open"].alias("open"),
        F.col("fields")["Close"].alias("close"),
    )


def lookup_prices(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Exact (ticker, date) lookup for many requests; an unknown key gives nulls.

    A request without a date matches every row of its ticker. Both cases are equi-joins.
    """
    rows = prices.select(
        "ticker", F.col("date").alias("row_date"), "row_timestamp", "open", "close"
    )
    dated = requests.where(F.col("date").isNotNull()).join(
        rows.withColumn("date", F.col("row_date")), ["ticker", "date"], "left"
    )
    undated = requests.where(F.col("date").isNull()).join(rows, "ticker", "left")
    return dated.unionByName(undated)


def market_cap_violations(snapshot: DataFrame) -> DataFrame:
    return violations(
        snapshot,
        F.col("ticker"),
        [("value_not_finite", not_finite(F.col("value")), F.col("ticker"))],
    )


def company_symbols(companies: DataFrame, order: str = "row_number") -> DataFrame:
    """Name to symbol; a repeated name keeps its last row, combined map-side."""
    return companies.groupBy("name").agg(F.max_by("symbol", order).alias("symbol"))


def company_lookup(
    requests: DataFrame, companies: DataFrame, snapshot: DataFrame, order: str = "row_number"
) -> DataFrame:
    """Exact company name to ticker to market cap; unknown names and tickers stay null.

    ``requests`` keeps every row; how many share a name does not matter, since the lookup
    side has one row per name.
    """
    named = requests.join(company_symbols(companies, order), "name", "left")
    caps = snapshot.select(F.col("ticker").alias("symbol"), F.col("value").alias("market_cap"))
    return named.join(caps, "symbol", "left")


def probe_violations(probes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Probes whose looked-up ``value`` differs from ``expected`` (null means absent)."""
    joined = probes.join(found.select(key, F.col("value").alias("got")), key, "left")
    wrong = ~F.col("got").eqNullSafe(F.col("expected"))
    return violations(
        joined,
        F.col(key),
        [
            ("known_key_missing", wrong & F.col("got").isNull(), F.col(key)),
            ("unknown_key_found", wrong & F.col("expected").isNull(), F.col(key)),
            (
                "value_differs",
                wrong & F.col("got").isNotNull() & F.col("expected").isNotNull(),
                F.col(key),
            ),
        ],
    )


def price_coverage(prices: DataFrame, probe_date: Column) -> DataFrame:
    """Rows, first and last date, and availability on a probe date, per ticker."""
    return prices.groupBy("ticker").agg(
        F.count("*").alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.coalesce(F.bool_or(F.col("date") == probe_date), F.lit(False)).alias("probe_available"),
    )



def daily_prices(ticks: DataFrame, by: tuple[str, str], order: tuple[str, ...]) -> DataFrame:
    """First and last tick value per key and day as open and close, combined map-side."""
    rank = F.struct(*order)
    return ticks.groupBy(*by).agg(
        F.min_by("value", rank).alias("open"),
        F.max_by("value", rank).alias("close"),
        F.count("*").alias("ticks"),
    )
