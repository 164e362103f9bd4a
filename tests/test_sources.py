import bz2
import hashlib
import io
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sieveline.functions.rules import ValidationError
from sieveline.sources import artifacts as A
from sieveline.sources import lines as lines_of
from sieveline.sources import prices as P
from sieveline.sources import records as R


def record(i="q1", **change):
    page = dict.fromkeys(R.PAGE_FIELDS, "text")
    base = {
        "interaction_id": i, "query": "who", "query_time": "03/05/2024, 23:18:31 PT", "domain": "d",
        "question_type": "s", "static_or_dynamic": "static", "answer": 7, "alt_ans": [2020, "2020"],
        "search_results": [page],
    }
    return {**base, **change}


def lines(spark, *values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "line_number long, value string")


def rules(spark, *values):
    found = R.record_violations(lines(spark, *values), F.col("line_number")).collect()
    return {(r.location, r.rule) for r in found}


def test_reads_plain_and_compressed_in_file_order(spark, tmp_path):
    text = "\n".join(json.dumps(record(f"q{i}")) for i in range(500)) + "\n"
    (tmp_path / "plain.jsonl").write_text(text)
    (tmp_path / "packed.jsonl.bz2").write_bytes(bz2.compress(text.encode()))
    for name in ("plain.jsonl", "packed.jsonl.bz2"):
        rows = R.read_records(spark, str(tmp_path / name)).collect()
        assert {(r.line_number, r.interaction_id) for r in rows} == {
            (i + 1, f"q{i}") for i in range(500)
        }
        assert rows[0].answers == ["7", "2020"] and len(rows[0].search_results) == 1
    first = R.first_lines(R.read_lines(spark, str(tmp_path / "plain.jsonl")), 3)
    assert sorted(r.line_number for r in first.collect()) == [1, 2, 3]


def test_numbering_holds_across_ranges(spark, tmp_path):
    (tmp_path / "many.txt").write_text("".join(f"{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = R.read_lines(spark, str(tmp_path / "many.txt"))
        assert rows.rdd.getNumPartitions() == 6
        assert rows.where("line_number - 1 <> cast(value as int)").count() == 0
        assert rows.count() == 20000
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    "text", ["a\nb", "a\n\n\nb\n", "\n", "\r\n\r\n", "x\r\ny\rz\n\r", "é日\n😀 \n", "", "one long line without an end", "\ra\r\r\n\nb"]
)
def test_every_cut_gives_the_same_lines(spark, tmp_path, text):
    name = tmp_path / "t.txt"
    name.write_bytes(text.encode())
    wanted = [line.rstrip("\n").encode() for line in io.StringIO(text, newline=None)]
    packed = tmp_path / "t.txt.bz2"
    packed.write_bytes(bz2.compress(text.encode()))
    assert list(lines_of.read_packed(str(packed))) == wanted
    size = len(text.encode())
    for step in range(1, size + 1):
        got, counted = [], 0
        for low in range(0, size, step):
            part = list(lines_of.read_range(str(name), low, min(low + step, size)))
            assert len(part) == lines_of.count_starts(str(name), low, min(low + step, size))
            got += part
        assert got == wanted
    rows = lines_of.numbered_lines(spark, str(name), 3).orderBy("line_number").collect()
    assert [(r.line_number, r.value.encode()) for r in rows] == list(enumerate(wanted, 1))


def test_blocks_do_not_show_in_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(lines_of, "_BLOCK", 7)
    text = "\r\n".join("ab" * (k % 9) for k in range(200))
    (tmp_path / "t").write_text(text, newline="")
    (tmp_path / "t.bz2").write_bytes(bz2.compress(text.encode()))
    wanted = text.encode().split(b"\r\n")
    assert list(lines_of.read_packed(str(tmp_path / "t.bz2"))) == wanted
    cuts = [0, 50, 51, 400, len(text)]
    assert [x for a, b in zip(cuts, cuts[1:], strict=False) for x in lines_of.read_range(str(tmp_path / "t"), a, b)] == wanted


def test_lines_that_are_not_utf8_stop_the_read(spark, tmp_path):
    (tmp_path / "t").write_bytes(b"good\nbad \xff\n")
    with pytest.raises(Exception, match="(?i)utf"):
        R.read_lines(spark, str(tmp_path / "t")).collect()


def test_profile_tells_number_kinds_and_null_splits_apart(spark):
    rows = lines(spark, record(answer=1, alt_ans=[2.5, 3, "x"], split=None), record("b", answer=1.0, alt_ans=[]), record("c", split=2))
    got = {(r.section, r.key): r.n for r in R.profile(rows).collect()}
    assert got["answer_types", "int"] == 2 and got["answer_types", "float"] == 1
    assert (got["alternate_answer_types", "float"], got["alternate_answer_types", "int"], got["alternate_answer_types", "string"]) == (1, 2, 2)
    assert (got["split", "null"], got["split", "absent"], got["split", "2"]) == (1, 1, 1)


def test_malformed_records_stop_the_read(spark, tmp_path):
    page = dict.fromkeys(R.PAGE_FIELDS, "x")
    bad = [
        " ", "{", [1], record(answer=None), record(answer=True), record(answer={"a": 1}),
        '{"answer": NaN}', record(alt_ans="x"), record(alt_ans=[None]), record(query=" "),
        record(domain=5), record(search_results={}), record(search_results=[5]),
        record(search_results=[{**page, "page_url": None}]),
    ]
    found = rules(spark, record(), *bad)
    assert {int(i) for i, _ in found} == set(range(2, len(bad) + 2))
    (tmp_path / "bad.jsonl").write_text(json.dumps(record()) + "\n\n")
    with pytest.raises(ValidationError, match="bad.jsonl:2"):
        R.read_records(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "twice.jsonl").write_text((json.dumps(record()) + "\n") * 2)
    with pytest.raises(ValidationError, match="duplicate"):
        R.read_records(spark, str(tmp_path / "twice.jsonl"))


def test_inference_view_is_gold_free(spark):
    view = R.inference_view(R.typed(lines(spark, record())))
    assert not set(view.columns) & set(R.GOLD_FIELDS)


def test_digests_bind_files_and_tampering_is_seen(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc" * 1000)
    (tmp_path / "b.bin").write_bytes(b"")
    found = {Path(r.path).name: r for r in A.file_digests(spark, str(tmp_path)).collect()}
    assert found["a.bin"].sha256 == hashlib.sha256(b"abc" * 1000).hexdigest()
    pins = [(n, r.bytes, r.sha256) for n, r in found.items()] + [("gone", 1, "x")]
    manifest = spark.createDataFrame(pins, "name string, bytes long, sha256 string")
    (tmp_path / "a.bin").write_bytes(b"abd" * 1000)
    broken = A.checksum_violations(A.file_digests(spark, str(tmp_path)), manifest).collect()
    assert {(r.location, r.rule) for r in broken} == {
        ("a.bin", "sha256_differs"), ("gone", "file_missing"),
    }


def test_outputs_are_written_once_and_imports_are_exact(spark, tmp_path):
    df = spark.range(5)
    A.write_once(df, str(tmp_path / "run"))
    with pytest.raises(Exception, match="(?i)exists"):
        A.write_once(df, str(tmp_path / "run"))
    export = tmp_path / "export.json"
    export.write_text('{"reviews": []}')
    clean = spark.createDataFrame([], "location string, rule string, detail string")
    A.import_once(spark, str(export), clean, str(tmp_path / "kept"))
    assert bytes(spark.read.parquet(str(tmp_path / "kept")).first().content) == export.read_bytes()
    with pytest.raises(ValidationError):
        dirty = spark.createDataFrame([("x", "y", "z")], clean.schema)
        A.import_once(spark, str(export), dirty, str(tmp_path / "other"))


def test_fingerprint_ignores_layout_and_sees_changes(spark):
    df = spark.range(1000).withColumn("x", F.lit("a"))
    one = A.fingerprint(df).first()
    assert A.fingerprint(df.repartition(7).select("x", "id")).first() == one
    assert A.fingerprint(df.withColumn("x", F.when(F.col("id") == 3, "b").otherwise("a"))).first() != one


def test_a_manifest_binds_the_run_it_was_written_with(spark, tmp_path):
    df = spark.range(1000).select(F.concat(F.lit("q"), "id").alias("interaction_id"), F.col("id").alias("place"), F.lit("a").alias("x"))
    order, run = ("place", "interaction_id"), str(tmp_path / "run")
    made = A.write_run(df, run, '{"k": 1}', df.select("x").distinct(), order).first()
    assert (made.trace_rows, made.sources) == (1000, 1)
    assert made.trace_fingerprint == A.fingerprint(df).first().fingerprint
    check = lambda: {r.rule for r in A.run_violations(spark, run, order).collect()}
    assert check() == set()
    with pytest.raises(Exception, match="(?i)exists"):
        A.write_run(df, run, "{}", df, order)
    bent = {
        "trace_differs": df.withColumn("x", F.when(F.col("place") == 3, "b").otherwise("a")),
        "order_differs": df.withColumn("place", F.when(F.col("place") < 2, 1 - F.col("place")).otherwise(F.col("place"))),
        "trace_rows_differ": df.where("place <> 9"),
    }
    wanted = {"trace_differs": {"trace_differs"}, "order_differs": {"trace_differs", "order_differs"}, "trace_rows_differ": {"trace_rows_differ", "trace_differs", "order_differs"}}
    for rule, other in bent.items():
        other.write.mode("overwrite").parquet(f"{run}/trace")
        assert check() == wanted[rule]
    empty = A.write_run(df.limit(0), str(tmp_path / "empty"), "{}", df.limit(0), order).first()
    assert empty.trace_rows == 0
    assert A.run_violations(spark, str(tmp_path / "empty"), order).count() == 0


def test_a_failed_write_leaves_no_manifest(spark, tmp_path):
    broken = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise("x").alias("interaction_id"))
    with pytest.raises(Exception, match="stop"):
        A.write_run(broken, str(tmp_path / "run"), "{}", spark.range(1))
    assert not (tmp_path / "run" / "manifest").exists()


def test_content_digests_find_what_changed(spark):
    df = spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("text"))
    digests = lambda rows: A.content_digests(rows, "t", F.col("id") % 4, F.octet_length("text"))
    pins = digests(df).withColumn("name", F.substring_index("path", "/", -1)).drop("path")
    assert A.checksum_violations(digests(df.repartition(7)), pins).count() == 0
    bent = df.withColumn("text", F.when(F.col("id") == 5, "text x").when(F.col("id") == 6, F.reverse("text")).otherwise(F.col("text")))
    found = A.checksum_violations(digests(bent.where("id % 4 <> 3")), pins).collect()
    assert {(r.location, r.rule) for r in found} == {("1", "sha256_differs"), ("2", "sha256_differs"), ("3", "file_missing")}


def test_price_rules_and_lookup(spark):
    schema = "ticker string, history map<string,map<string,double>>"
    good = {"2024-02-28 00:00:00 EST": {"Open": 100.0, "Close": 101.0, "Volume": 10.0}}
    rows = spark.createDataFrame([("A", good)], schema)
    flat = P.flatten_prices(rows)
    assert flat.first().close == 101.0
    bad = [("B", {"unknown": {"Open": 1.0, "Close": 2.0}}),
           ("C", {"2024-02-28 x": {"Open": float("nan"), "Close": 1.0}}),
           ("D", {"2024-02-28 x": {"Open": 1.0}})]
    found = P.price_violations(spark.createDataFrame(bad, schema)).collect()
    assert [r.rule for r in sorted(found)] == [
        "dated_key_required", "value_not_finite", "open_close_required",
    ]
    with pytest.raises(ValidationError):
        P.flatten_prices(spark.createDataFrame(bad, schema))
    asked = spark.sql("select 'A' ticker, date'2024-02-28' date union all select 'A', date'2024-02-27' "
                      "union all select 'A', null union all select 'Z', null")  # fmt: skip
    closes = [r.close for r in P.lookup_prices(asked, flat).collect()]
    assert sorted(closes, key=str) == [101.0, 101.0, None, None]
