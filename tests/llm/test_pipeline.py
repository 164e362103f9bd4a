import re

import corpus_pipeline
from sieveline.llm import classifier, passages, rules
from sieveline.llm.common import saved
from sieveline.llm.queries import ORACLE, QUERIES

from .helpers import documents, no_documents
from .test_duplicates import fingerprint, reachable

SMALL = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    """Each stage's result from its own input, worked out row by row."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        source, docs = docs, saved(stage(spark, docs, SMALL))
        rows = docs.collect()
        seen.append(name)
        if name == "best-fit packing":
            assert {r.doc_id for r in rows} == set(before)
            assert sorted(r.doc_id for r in rows if r.piece == 0) == sorted(before)
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in rows}
        if name == "quality classifier":
            good = {r.doc for r in classifier.scores(source, labels).collect() if r.predicted}
            assert after == {k: v for k, v in before.items() if k in good}
        elif name == "quality rules":
            _, learned = rules.judged(source, labels)
            assert all(len(re.findall(r"[^\x20\x09-\x0D]+", t)) >= 50 for t in after.values())
            assert set(after) <= set(before) and (learned or len(after) > 0.6 * len(before))
        elif name == "SimHash near-dedup":
            prints = {k: fingerprint(t) for k, t in before.items()}
            links = [(a, b) for a in prints for b in prints if a <= b and (prints[a] ^ prints[b]).bit_count() <= 2]
            assert after == {k: before[k] for k in set(reachable(links).values())}
        else:
            spans = {r.doc: [(s.low, s.high) for s in r.spans] for r in passages.passages_by_text(passages.near_passages(source)).collect()}
            assert after == {k: passages.cut_words(t, spans[k]) if k in spans else t for k, t in before.items()}
            assert all(r.n_chars == len(r.text) for r in rows)
    assert seen == [n for n, _ in corpus_pipeline.STAGES]
    whole = corpus_pipeline.run(spark, SMALL)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, rows))


def test_stages_take_odd_rows(spark):
    for docs in (documents(spark), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SMALL).count() <= 60


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES} == set(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
