"""Small inputs that every operator has to take."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma upsilon omega".split()


def prose(seed, n, tail=""):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)) + tail


LONG = prose(99, 20_000)
#: Nulls, empty and blank texts, repeated rows, one id with two texts, a very long text.
ROWS = [
    (1, prose(1, 120)), (2, None), (3, ""), (4, " \t\n "), (5, prose(1, 120)), (6, "one two"),
    (7, prose(2, 90, "\nlast line\nlast line")), (7, prose(2, 90, "\nlast line\nlast line")),
    (8, prose(3, 70)), (8, prose(4, 70)), (None, prose(5, 80)), (None, None), (9, LONG), (10, "äöü 日本語  😀 x"),
]
#: Columns whose names the operators use inside.
CLASHING = "doc body mark print base n low high spans cell key label vector id score good".split()


def documents(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        df = df.selectExpr("*", *[f"'x' as {name}" for name in CLASHING], "cast(null as int) as word")
    return df


def no_documents(spark):
    return documents(spark, [])
