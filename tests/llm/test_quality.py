import re
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import classifier, rules, sentencepieces
from sieveline.llm.common import tokenizer_path

from .helpers import ROWS, documents, no_documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.01"


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


def test_counts_of_texts(spark):
    odd = [
        "a b c a b c a b", "x x x x x", "a b c\nd a b c", "one\n\n \none\none \n one", "### $$ a|b <i>", "é 日本 😀   x y",
        "\x0b\x0c a\x1cb \r\n a\x1cb", "a b a b a", "T h e T h e",
    ]
    rows = [r for r in ROWS if len(r[1] or "") < 20_000] + [(100 + k, t) for k, t in enumerate(odd)]
    got = rules.text_counts(documents(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((r.doc, *[r[n] for n in names]) for r in got), key=key) == sorted(((d, *counted(t)) for d, t in rows), key=key)


def labelled(spark, n=400):
    text = lambda k: prose(k, 60) if k % 4 else " ".join(w + "***" for w in prose(k, 60).split())
    docs = documents(spark, [(k, text(k)) for k in range(n)])
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(n)] + [(None, 1), (3, None)], "doc_id long, quality int")
    return docs, labels


def test_learned_rules(spark):
    docs, labels = labelled(spark)
    rated, learned = rules.judged(docs, labels)
    assert len(learned) == 1 and learned[0][0].feature in ("symbols_per_word", "word_length")
    assert all(r.kept == bool(r.doc % 4) for r in rated.collect())
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 300
    for none in (labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        assert rules.judged(docs, none)[1] == []
    edge, _ = rules.judged(documents(spark), labels)
    assert {(r.doc, r.kept) for r in edge.collect() if r.doc in (2, 3, 4, 6)} == {(2, False), (3, False), (4, False), (6, False)}
    assert rules.judged(no_documents(spark), labels)[0].count() == 0


def test_rules_use_no_python(spark):
    docs, labels = labelled(spark, 60)
    plan = rules.text_counts(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_first_matching_rule_counts(spark):
    one = rules.Condition("words", True, 5.0)
    two = rules.Condition("symbols_per_word", False, 0.5)
    frame = spark.createDataFrame([(3, 0), (9, 0), (4, 9)], "n_words long, n_symbols long")
    assert [r[0] for r in frame.select(rules.verdict([(one,), (one, two), (two,)])).collect()] == [3, 1, None]
    assert [r[0] for r in frame.select(rules.verdict([])).collect()] == [None] * 3
    assert str(one) == "words >= 5" and str(two) == "symbols_per_word < 0.5"


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = classifier.scores(docs, labels).join(labels.withColumnRenamed("doc_id", "doc"), "doc").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == 1 for r in rows if r.quality == 1)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = labelled(spark, 200)
    bent = labels.withColumn("quality", F.when(classifier.in_training(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    read = lambda df: sorted((r.doc, r.score) for r in classifier.scores(docs, df).collect())
    assert read(labels) == read(bent)


def test_classifier_edges(spark):
    docs, labels = labelled(spark, 200)
    got = classifier.scores(documents(spark), labels.unionByName(labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc in (2, 3, 4)}) == 1
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert {r.predicted for r in classifier.scores(docs, none).collect()} == {1}
    assert classifier.scores(no_documents(spark), labels).count() == 0
    kept = classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 4 > 0 for r in kept.select("doc_id").collect()} == {True}


def test_descent_finds_the_margin():
    rows = [np.array([k, 10 + k % 3]) for k in range(10)] * 4
    good = np.array([k < 5 for k in range(10)] * 4)
    weights, bias = classifier.dual_coordinate_descent(rows, good, np.ones(16), cost=1.0, epochs=200)
    margins = np.array([(weights[r].sum() / np.sqrt(2) + bias) * (1 if g else -1) for r, g in zip(rows, good, strict=True)])
    assert (margins > 0.9).all()
    objective = lambda w, b: (w @ w + b * b) / 2 + sum(
        max(0.0, 1 - (w[r].sum() / np.sqrt(2) + b) * (1 if g else -1)) for r, g in zip(rows, good, strict=True)
    )
    rng = np.random.default_rng(0)
    best = objective(weights, bias)
    assert all(objective(weights + rng.normal(0, 0.05, 16), bias + rng.normal(0, 0.05)) > best - 1e-3 for _ in range(50))


PIECES = tokenizer_path("piece_bpe_32k.model")
REFERENCE = sentencepiece.SentencePieceProcessor(model_file=PIECES)
CODER = sentencepieces.SentencePieceEncoder(PIECES)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tabcdeilnorstAT.,'-▁é日😀<>0x", max_size=40))
def test_pieces_are_those_of_the_model(text):
    wanted = REFERENCE.encode(text)
    assert list(next(iter(CODER.encode([text])))) == wanted
    assert CODER.whole.encode(text, add_special_tokens=False).ids == wanted
    assert CODER.decode([wanted]) == [REFERENCE.decode(wanted)]
    assert sentencepieces.ByteDecoder(PIECES)(np.array(wanted, np.int64)).decode() == REFERENCE.decode(wanted)
    assert CODER.differing == 0


def unigram_model():
    """A unigram model of a few pieces, as the file format has it."""

    def field(number, wire, data):
        return bytes([*_varint(number << 3 | wire)]) + data

    def _varint(n):
        out = []
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return [*out, n]

    def text(number, data):
        return field(number, 2, bytes(_varint(len(data))) + data)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, -1.0 - k / 3, 1) for k, p in enumerate(["▁the", "▁", "th", "e", "t", "h", "a", "▁a", "he", "at", "▁cat", "c", "s"])]
    data = b"".join(
        text(1, text(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces
    )
    trainer = field(3, 0, b"\x01") + bytes([*_varint(35 << 3)]) + b"\x01"
    return data + text(2, trainer) + text(3, field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))


def test_unigram_models():
    data = unigram_model()
    model = sentencepieces.parse_model(data)
    assert (model.kind, model.byte_fallback, model.squeeze) == (sentencepieces.UNIGRAM, True, False)
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = sentencepieces.build_tokenizer(model)
    for text in ("the cat", "a  the hat", "zebra thé", "that at tha"):
        ids = reference.encode(text)
        assert own.encode(text, add_special_tokens=False).ids == ids and own.decode(ids) == reference.decode(ids)


def test_unsupported_models():
    model = sentencepieces.parse_model(unigram_model())
    model.pieces.append(("x", 0.0, sentencepieces.USER_DEFINED))
    with pytest.raises(ValueError):
        sentencepieces.build_tokenizer(model)


def test_encoded_documents(spark):
    got = sentencepieces.encode_and_decode(documents(spark), PIECES).collect()
    assert all(r.round_trip and r.differing_pieces == 0 for r in got)
    assert sorted(r.n_ids for r in got) == sorted(len(REFERENCE.encode(t or "")) for _, t in ROWS)
    assert sentencepieces.encode_and_decode(no_documents(spark), PIECES).count() == 0


def test_classifier_holds_its_rows_once():
    """The driver fits on views of what was sent to it: no second copy of the indicators, no table of values."""
    random = np.random.default_rng(3)
    sent = [np.sort(random.choice(1 << 12, n, replace=False)).astype(np.int32) for n in (0, 900, 1000, *[1000] * 1500)]
    good = random.random(len(sent)) < 0.5
    kind = pa.schema([("good", pa.bool_()), ("buckets", pa.list_(pa.int32()))])
    cuts = [0, 400, 400, 1000, len(sent)]
    parts = [pa.record_batch([pa.array(good[a:b]), pa.array(sent[a:b], pa.list_(pa.int32()))], schema=kind) for a, b in zip(cuts, cuts[1:])]
    found = pa.Table.from_batches([parts[0].slice(0, 100), parts[0].slice(100), *parts[1:]])
    wide = [x.astype(np.int64) for x in sent]
    order = sorted(range(len(sent)), key=lambda i: (good[i], len(wide[i]), wide[i].tobytes()))
    tracemalloc.start()
    rows, labels = classifier.ordered_rows(found)
    del rows, labels
    tracemalloc.reset_peak()
    rows, labels = classifier.ordered_rows(found)
    model = classifier.fit(rows, labels, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r.tolist() for r in rows] == [sent[i].tolist() for i in order] and labels.tolist() == good[order].tolist()
    assert peak < 0.9 * sum(x.nbytes for x in sent)
    again = classifier.fit([wide[i] for i in order], good[order], 12)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
