"""Quality statistics of texts and decision lists learned from labelled ones, in Spark columns only.

A decision list is an ordered list of rules; a rule is a conjunction of thresholds on statistics and
rejects what it matches. Rules are learned by sequential covering: a rule is grown condition by
condition on one part of the labelled rows (FOIL gain), pruned from its end on the other part, and
what it matches leaves the rows for the next rule. Spark counts rejected and other rows by bin of each
statistic; only those counts, of a fixed number, come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import let

from .common import keyed_text, saved

BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def words_of(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; a null text has none."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[ \t-\r]+"))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the same text.

    Windows are told apart by a 64-bit hash. Most texts repeat none, which a distinct count shows;
    in the others the windows are sorted by hash and compared with their neighbours.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - at, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda total, n: total + n)

    def twice(ranked: Column) -> Column:
        return F.array_sort(
            F.array_compact(
                F.transform(
                    ranked,
                    lambda e, k: F.when(
                        (F.get(ranked, k - 1)["h"] == e["h"]) | (F.get(ranked, k + 1)["h"] == e["h"]), e["at"]
                    ),
                )
            )
        )

    def found(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(ranked, twice), covered)
        )

    windows = F.transform(
        F.slice(words, F.lit(3), F.size(words) - 2),
        lambda last, k: F.xxhash64(F.get(words, k), F.get(words, k + 1), last),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, found))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc`` and the counts of its whole text; a null text counts as empty."""
    return _with_counts(keyed_text(docs, id_col, text_col), "doc")


def _with_counts(texts: DataFrame, carry: str) -> DataFrame:
    """``carry`` and the counts of the text in ``body``."""
    body = F.coalesce("body", F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        )

    def matches(pattern: str) -> Column:
        return (F.length(body) - F.length(F.regexp_replace(body, pattern, ""))).cast("long")

    return (
        texts.select(
            carry,
            let(words_of(F.col("body")), of_words).alias("w"),
            let(lines, of_lines).alias("l"),
            matches(r"[#*$%&|<>]++").alias("n_symbols"),
            matches(r"[A-Z]++").alias("n_upper"),
            matches("!++").alias("n_marks"),
        )
        .select(carry, "w.*", "l.*", "n_symbols", "n_upper", "n_marks")
        .select(carry, *COUNTS)
    )


def base_failed(short: int = 50, repeated_percent: int = 50) -> Column:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < short) | (100 * F.col("n_repeat_words") > repeated_percent * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def features() -> dict[str, Column]:
    """Statistics a rule may test; all are defined for empty texts."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "duplicate_lines": _share("n_dup_lines", "n_lines"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "upper_case": _share("n_upper", "word_chars"),
        "marks_per_word": _share("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def matches(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that matches (from 1), null if none does: one conditional expression."""
    out = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(matches(rule), F.lit(n)).otherwise(out)
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Quantiles of each statistic, over rejected and over other rows; never more than twice ``bins``."""
    cuts = F.array(*[F.lit((k + 0.5) / bins) for k in range(bins)])
    found = rows.groupBy("reject").agg(
        *[F.percentile_approx(value, cuts, F.lit(2000)).alias(name) for name, value in features().items()]
    )
    merged: dict[str, set[float]] = {name: set() for name in features()}
    for row in found.collect():
        for name in merged:
            merged[name].update(row[name] or [])
    # Between neighbouring values, so that a threshold does not sit on a common value.
    return {
        name: [low + (high - low) / 2 for low, high in zip(ordered, ordered[1:], strict=False)]
        for name, values in merged.items()
        for ordered in [sorted(values)]
    }


def learn_rules(
    labelled: DataFrame,
    bins: int = 24,
    max_rules: int = 12,
    max_conditions: int = 4,
    precision: float = 0.9,
    least: int = 3,
) -> list[Rule]:
    """Ordered rules from rows with the counts of a text, ``reject`` (boolean) and ``prune`` (boolean).

    A rule is taken if at least ``precision`` of the rows it matches are rejected ones, in both parts,
    and it matches at least ``least`` rejected rows; the first that is not ends the list. Without
    rejected rows, or without others, the list is empty. Ties go to the earlier statistic and the
    lower threshold.
    """
    rows = labelled.where("reject is not null").select("reject", "prune", *COUNTS)
    edges = _thresholds(rows, bins)

    def bin_of(value: Column, cuts: list[float]) -> Column:
        """How many thresholds the value reaches."""
        return F.size(F.filter(F.array(*[F.lit(t) for t in cuts]), lambda t: t <= value)) if cuts else F.lit(0)

    binned = [bin_of(value, edges[name]).alias(name) for name, value in features().items()]
    cube = saved(rows.groupBy("reject", "prune", *binned).count())
    names = list(features())

    def inside(rule: list[tuple[str, bool, int]]) -> Column:
        out = F.lit(True)
        for name, at_least, k in rule:
            out = out & ((F.col(name) > k) if at_least else (F.col(name) <= k))
        return out

    def summed(reject: bool, where: Column | None = None) -> Column:
        own = (F.col("reject") == reject) if where is None else (F.col("reject") == reject) & where
        return F.coalesce(F.sum(F.when(own, F.col("count"))), F.lit(0))

    taken: list[list[tuple[str, bool, int]]] = []
    while len(taken) < max_rules:
        open_rows = cube
        for rule in taken:
            open_rows = open_rows.where(~inside(rule))
        rule: list[tuple[str, bool, int]] = []
        while len(rule) < max_conditions:
            by_bin = (
                open_rows.where(~F.col("prune") & inside(rule))
                .select("reject", "count", F.explode(F.array(*[
                    F.struct(F.lit(n).alias("f"), F.col(name).alias("bin")) for n, name in enumerate(names)
                ])).alias("e"))
                .groupBy("e.f", "e.bin").agg(summed(True).alias("p"), summed(False).alias("n"))
                .collect()
            )
            p0 = sum(r.p for r in by_bin if r.f == 0)
            n0 = sum(r.n for r in by_bin if r.f == 0)
            if not p0 or not n0:
                break
            best, most = None, 1e-9
            for f, name in enumerate(names):
                cells = {r.bin: (r.p, r.n) for r in by_bin if r.f == f}
                p = n = 0
                for k in range(len(edges[name])):
                    p, n = p + cells.get(k, (0, 0))[0], n + cells.get(k, (0, 0))[1]
                    for at_least, pp, nn in ((True, p0 - p, n0 - n), (False, p, n)):
                        if (gain := _gain(pp, nn, p0, n0)) > most:
                            best, most = (name, at_least, k), gain
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        counts = open_rows.agg(*[
            summed(reject, (F.col("prune") == prune) & inside(prefix)).alias(f"{k}_{reject}_{prune}")
            for k, prefix in enumerate(prefixes) for reject in (True, False) for prune in (True, False)
        ]).first()
        worth = []
        for k in range(len(prefixes)):
            p, n = counts[f"{k}_True_True"], counts[f"{k}_False_True"]
            worth.append((p - n) / (p + n) if p + n else -1.0)
        k = max(range(len(prefixes)), key=lambda k: (worth[k], -k))
        p = counts[f"{k}_True_True"] + counts[f"{k}_True_False"]
        n = counts[f"{k}_False_True"] + counts[f"{k}_False_False"]
        if worth[k] < 2 * precision - 1 or p < least or p < precision * (p + n):
            break
        taken.append(prefixes[k])
    return [tuple(Condition(name, at_least, edges[name][k]) for name, at_least, k in rule) for rule in taken]


def labelled_counts(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of the rows whose label is known; one in five ids is left out, one in three prunes.

    ``labels`` has doc_id and quality; conflicting or repeated labels of an id count as one row, and
    as rejected if any of them is 0.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(
        (F.min("quality") == 0).alias("reject")
    )
    bucket = F.crc32(F.col("doc").cast("string").cast("binary"))
    return counts.join(marks.where(bucket % 5 != 0), "doc").withColumn(
        "prune", F.xxhash64("doc") % 3 == 0
    )


def judged(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, list[Rule]]:
    """Counts of every row with ``base_failed``, ``rule`` and ``kept``; and the learned rules.

    A row is kept unless the base rules fail or a learned rule matches. Null and empty texts have no
    words and fail. An empty label table gives no rules.
    """
    counts = saved(text_counts(docs, id_col, text_col))
    # Rules are for what passes the base rules; those need no learning.
    rules = learn_rules(labelled_counts(counts, labels).where(~base_failed()))
    rated = counts.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return rated.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows that the base rules or the learned rules reject; same columns.

    Every row is judged by its own text, also if its id is null or another row has it too. The counts
    are worked out a second time beside the texts, which are filtered where they are and never moved.
    """
    _, learned = judged(docs, labels, id_col, text_col)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("body"))
    good = _with_counts(whole, "row").where(~base_failed() & verdict(learned).isNull())
    return good.select("row.*")
