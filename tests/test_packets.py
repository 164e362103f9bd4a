import pytest
from pyspark.sql import functions as F

from sieveline.operators import audits as A
from sieveline.operators import packets as P
from sieveline.operators.mutations import Mutation, mutation_matrix, share_of


def packet(spark):
    ids = [f"q{k}" for k in range(30)]
    asked = spark.createDataFrame([(i, f"what {i}", "t" if i != "q4" else None) for i in ids], "interaction_id string, query string, query_time string")
    pages = spark.createDataFrame(
        [(i, n, "name", f"u{n}", "", f"text {i} {n}", None) for i in ids for n in range(3)],
        "interaction_id string, page_index int, page_name string, page_url string, page_snippet string, page_result string, page_last_modified string",
    )
    candidates = spark.createDataFrame(
        [(i, r, f"{i}-{r}", 0, "page_result", 0, 4, "text", 1) for i in ids if i != "q7" for r in (1, 2, 3)],
        "interaction_id string, rank int, evidence_id string, page_index int, field string, char_start int, char_end int, content string, word_count int",
    )
    chosen = asked.where("interaction_id <> 'q9'").select("interaction_id")
    excluded = spark.createDataFrame([(f"old{k}",) for k in range(500)] + [("old1",)], "interaction_id string")
    return P.build_packet(chosen, asked, pages, candidates, excluded)


def bend(made, **change):
    return P.Packet(**{**vars(made), **change})


def test_each_damage_of_a_reread_packet_has_a_row_of_its_own(spark, tmp_path):
    made = packet(spark)
    is_ = lambda i: F.col("interaction_id") == i
    first_two = F.when(F.col("rank") == 1, 2).when(F.col("rank") == 2, 1).otherwise(F.col("rank")).cast("int")
    stored = bend(
        made,
        questions=made.questions.withColumn("query_time", F.when(is_("q4"), "").otherwise(F.col("query_time"))).where(~is_("q5")),
        pages=made.pages.withColumn("page_result", F.when(is_("q1") & (F.col("page_index") == 2), "other").otherwise(F.col("page_result")))
        .where(~(is_("q8") & (F.col("page_index") == 0))).union(made.pages.where(is_("q2") & (F.col("page_index") == 1))),
        candidates=made.candidates.withColumn("rank", F.when(is_("q3"), first_two).otherwise(F.col("rank"))),
        ledger=made.ledger.where(~is_("old7")).union(spark.sql("select 'new'")),
    )
    P.write_packet(stored, str(tmp_path / "packet"))
    with pytest.raises(Exception, match="(?i)exists"):
        P.write_packet(stored, str(tmp_path / "packet"))
    found = P.packet_violations(P.read_packet(spark, str(tmp_path / "packet")), made)
    assert {(r.location, r.rule) for r in found.collect()} == {
        ("q4/question", "question_changed"), ("q5/question", "question_missing"), ("q1/page/2", "page_changed"),
        ("q8/page/0", "page_missing"), ("q2/page/1", "page_repeated"), ("q3/candidate/1", "candidate_changed"),
        ("q3/candidate/2", "candidate_changed"), ("ledger/old7", "ledger_missing"), ("ledger/new", "ledger_unexpected"),
    }
    P.write_packet(made, str(tmp_path / "sound"))
    assert P.packet_violations(P.read_packet(spark, str(tmp_path / "sound")), made).count() == 0


def test_only_digests_are_shuffled(spark):
    made = packet(spark)
    plan = P.packet_violations(made, packet(spark))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith(("Join FullOuter", "Aggregate"))]
    assert joins and not any("page_result" in line or "content" in line for line in joins)


def test_roots_do_not_depend_on_order_or_layout(spark):
    made = packet(spark)
    one = P.leaves(made)
    same = {tuple(r) for r in P.roots(one).collect()} ^ {tuple(r) for r in P.roots(one.repartition(5).sort("digest")).collect()}
    assert not same
    branches = P.roots(one).where("branch like 'ledger/%'").count()
    assert 400 < branches <= 500


def test_mutation_matrix_tells_caught_missed_and_strayed(spark):
    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("interaction_id"), F.lit("p").alias("policy"), (F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    at = F.concat_ws("/", "interaction_id", "policy")
    mutations = [
        Mutation("a", "change", "a_differs", F.col("a") + 1),
        Mutation("b", "change", "b_differs", F.lit(None)),
        Mutation("row", "drop", "row_missing"),
        Mutation("row", "repeat", "repeated_row", where=F.col("a") < 5),
        Mutation("b", "change", "a_differs", F.col("b") + 1),
    ]
    keys = ("interaction_id", "policy")
    audit = lambda run: A.compare(rows, run.distinct(), keys, ("a", "b")).unionByName(A.repeated(run, keys))
    got = {r.mutation: r for r in mutation_matrix("x", rows, at, mutations, audit).collect()}
    shares = {r.s: (r.n, r.few) for r in rows.groupBy(share_of(at, 5).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("a") < 5).alias("few")).collect()}
    sound = shares[5][0] + shares[3][0] - shares[3][1]
    wanted = {mutations[k].name: (shares[k][0] if k != 3 else shares[3][1],) * 2 + (0,) for k in range(4)}
    wanted |= {"sound": (sound, 0, 0), mutations[4].name: (shares[4][0], 0, shares[4][0])}
    assert {k: (r.damaged, r.caught, r.strayed) for k, r in got.items()} == wanted
    with pytest.raises(ValueError):
        Mutation("a", "change", "x")
