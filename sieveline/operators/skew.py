"""Joins and cuts that hold when one key owns a large part of the rows."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the sketch. A key's count is over by at most the rows divided by this.
TRACKED = 10_000
#: Most keys that are split; every key that outweighs two shuffle partitions is among them.
MOST = 256


def _slots(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(rows: DataFrame, key: str) -> dict[int, int]:
    """How many salts each heavy key needs, by the hash of the key.

    One pass over the key column counts heavy hitters in a sketch of fixed size; a key is heavy if it
    outweighs two shuffle partitions of average size, and gets a salt for each partition it would fill.
    The result has at most ``MOST`` entries whatever the number of keys.
    """
    slots = _slots(rows)
    sketch = F.expr(f"approx_top_k(key, {MOST}, {TRACKED})")
    found = rows.select(F.xxhash64(key).alias("key")).agg(sketch.alias("top"), F.count("*").alias("n")).first()
    return {
        item["item"]: min(slots, math.ceil(item["count"] * slots / found.n))
        for item in found.top
        if item["count"] * slots > 2 * found.n
    }


def salted_join(
    rows: DataFrame,
    dimension: DataFrame,
    key: str,
    spread_by: Column | str,
    how: str = "inner",
    measured: DataFrame | None = None,
) -> DataFrame:
    """Join rows to a table with one row per key, splitting the heavy keys alone.

    Only the rows of heavy keys are dealt over salts, as many as their measured share asks for, and only
    those keys' dimension rows are copied. The rows' salt comes from a stable column. Without heavy keys
    this is a plain join. ``measured`` is a cheaper table with about the same shares of the key; shares
    decide speed only. When the dimension is small enough, the planner broadcasts it instead.
    """
    salts = heavy_keys(rows if measured is None else measured, key)
    if not salts:
        return rows.join(dimension, key, how)
    spread_by = F.col(spread_by) if isinstance(spread_by, str) else spread_by
    known = F.create_map(*chain.from_iterable((F.lit(k).cast("long"), F.lit(n)) for k, n in salts.items()))
    own = F.coalesce(F.element_at(known, F.xxhash64(key)), F.lit(1))
    left = rows.withColumn("salt", F.pmod(F.hash(spread_by), own))
    right = dimension.withColumn("salt", F.explode(F.sequence(F.lit(0), own - 1)))
    return left.join(right, [key, "salt"], how).drop("salt")
