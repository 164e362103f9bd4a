import hashlib
import operator
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import components, passages, projections, simhash, suffixes
from sieveline.llm.shingles import Words, xxh64

from .helpers import ROWS, documents, no_documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reachable(links):
    """Smallest node reachable, one node after the other."""
    low = {}

    def root(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(low)}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(n, n + 1) for n in range(40)], [(0, n) for n in range(1, 30)] + [(50, 51), (51, 50), (52, 52)]])
def test_components(spark, links):
    found = components.components(spark.createDataFrame(links, "u long, v long"))
    wanted = {k: v for k, v in reachable([x for x in links if x[0] != x[1]]).items()}
    assert sorted(map(tuple, found.collect())) == sorted(wanted.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB\t \né日", max_size=600), max_size=4))
def test_shingle_hashes(texts):
    raw = [t.encode() for t in texts] or [b""]
    words = Words(raw, lower=True)
    starts, ends, each = words.shingles(3)
    got = xxh64(words.data, starts, ends).tolist()
    wanted = []
    for t in raw:
        own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t.decode()))
        wanted += [" ".join(own[k : k + 3]) for k in range(max(1, len(own) - 2))] if own else []
    assert got == [xxhash.xxh64_intdigest(w.encode(), 42) for w in wanted]


def fingerprint(text):
    own = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(own[k : k + 3]).encode(), 42) for k in range(max(1, len(own) - 2))] if own else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    near = prose(20, 300)
    rows = ROWS + [(20 + k, near.replace(near.split()[k], "changed", 1)) for k in range(12)] + [(40, near)]
    got = simhash.simhash_groups(documents(spark, rows)).collect()
    prints = [(d, fingerprint(t)) for d, t in rows]
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    assert sorted((r.doc is None, r.doc or 0, r.print) for r in got) == sorted((d is None, d or 0, signed(p)) for d, p in prints)
    each = sorted({p for _, p in prints})
    root = reachable([(a, a) for a in each] + [(a, b) for a in each for b in each if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for d, p in prints:
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    assert all(r.group == least.get(root[r.print % (1 << 64)]) for r in got)
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark).columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(least.values())
    assert ids.count(None) == 2
    assert simhash.simhash_groups(no_documents(spark)).count() == 0


def test_links_at_two_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, np.int64).tolist()
    some = set(base)
    for b in base:
        for n in (1, 2, 3):
            flips = rng.choice(64, n, replace=False)
            x = b % (1 << 64)
            for f in flips:
                x ^= 1 << int(f)
            some.add(x - (1 << 64) if x >> 63 else x)
    found = simhash.links_of(spark.createDataFrame([(x,) for x in some], "print long")).collect()
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in found}
    near = lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2
    assert got == {(a, b) for a in some for b in some if a < b and near(a, b)}


def repeated(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if counts[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_repeated_bytes(spark, seed):
    rng = np.random.default_rng(seed)
    letters = ["a", "b", " ", "é"] if seed < 2 else list("abcdefghij ")
    stock = ["".join(rng.choice(letters, int(rng.integers(10, 60)))) for _ in range(5)]
    texts = ["".join(rng.choice(stock) if rng.random() < 0.5 else "".join(rng.choice(letters, 20)) for _ in range(int(rng.integers(0, 9)))) for _ in range(14)]
    texts += [None, "", texts[0], "ab" * 90, "a" * 200]
    rows = [(n if n != 3 else None, t) for n, t in enumerate(texts)] + [(0, texts[0])]
    length = 33 if seed % 2 else 40
    got = suffixes.remove_repeats(documents(spark, rows), length).collect()
    wanted = repeated([t for _, t in rows], length)
    assert sorted((r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == sorted(wanted)
    assert Counter(r.doc for r in got) == Counter(d for d, _ in rows)


def test_no_repeated_bytes(spark):
    with pytest.raises(ValueError):
        suffixes.remove_repeats(no_documents(spark), 20)
    assert suffixes.remove_repeats(no_documents(spark)).count() == 0
    got = suffixes.remove_repeats(documents(spark)).collect()
    assert {r.doc: r.n_removed == r.n_bytes for r in got}[7]  # its rows are copies of each other


def passage_rows():
    shared, near = prose(50, 70), prose(51, 80).split()
    other = list(near)
    other[40] = "changed"
    rows = [(n, f"{prose(60 + n, 60)} {shared} {prose(90 + n, 40)}") for n in range(30)]
    rows += [(40, f"{prose(150, 30)} {' '.join(near)} {prose(151, 30)}"), (41, f"{prose(152, 50)} {' '.join(other)} {prose(153, 5)}")]
    rows += [(n, prose(200 + n, 150)) for n in range(50, 60)]
    return rows, shared


def test_passages(spark):
    rows, shared = passage_rows()
    edge = [(70, None), (71, ""), (72, "a b"), (None, shared), (50, prose(250, 150)), (73, prose(999, 20_000))]
    found = passages.near_passages(documents(spark, rows + edge)).collect()
    spans = {(r.doc, r.other): (r.low, r.high) for r in found}
    texts = dict(rows)
    for n in range(1, 30):
        low, high = spans[n, 0]
        words = texts[n].split()
        assert shared in " ".join(words[low:high]) and high - low <= 72
    low, high = spans[41, 40]
    assert high - low >= 75
    assert {r.doc for r in found} == {*range(1, 30), 41}
    cut = {r.doc_id: r.text for r in passages.remove_passages(documents(spark, rows)).collect()}
    assert len(cut) == len(rows) and shared in cut[0] and all(shared not in cut[n] for n in range(1, 30))
    assert all(cut[n] == texts[n] for n in (40, *range(50, 60)))
    assert passages.near_passages(no_documents(spark)).count() == 0
    assert passages.remove_passages(documents(spark)).count() == len(ROWS)


def changed(words, at, what):
    return [*words[:at], what, *words[at + 1 :]]


def test_passages_of_chains(spark):
    # B is near A and C near B, but C is not near A: two changed words of 56.
    rows, wanted = [], set()
    for n in range(40):
        a = prose(2000 + n, 56).split()
        b = changed(a, 7, f"once{n}")
        c = changed(b, 48, f"twice{n}")
        for k, words in enumerate((a, b, c)):
            rows.append((3 * n + k, f"{prose(3000 + 3 * n + k, 50)} {' '.join(words)} {prose(4000 + 3 * n + k, 50)}"))
        wanted |= {3 * n + 1, 3 * n + 2}
    found = passages.near_passages(documents(spark, rows)).collect()
    assert {r.doc for r in found} <= wanted
    # Two of four functions agree on 97 of 100 passages at the bound.
    assert len(wanted - {r.doc for r in found}) <= 4


def test_passages_around_a_frequent_line(spark):
    # Every document has the line; of each pair the second has the whole passage around it again.
    line, rows, wanted = prose(5000, 40), [(0, f"{prose(5001, 60)} {prose(5000, 40)} {prose(5002, 60)}")], set()
    for n in range(1, 40):
        passage = f"{prose(5100 + n, 8)} {line} {prose(5200 + n, 8)}"
        rows += [(2 * n + k, f"{prose(5300 + 2 * n + k, 60)} {passage} {prose(5400 + 2 * n + k, 60)}") for k in (0, 1)]
        wanted.add(2 * n + 1)
    found = passages.near_passages(documents(spark, rows)).collect()
    assert {r.doc for r in found} == wanted
    assert all(r.other == r.doc - 1 and r.high - r.low >= 50 for r in found)


def test_contexts_of_windows_are_whole_hashes():
    texts = [f"{prose(7000 + n, 60)} one phrase of five words {prose(8000 + n, 60)}".encode() for n in range(400)]
    found = passages.compact_windows(texts, 46, 4)
    for side in ("ahead", "behind"):
        assert np.abs(found[side]).max() > 1 << 60
        assert len(np.unique(found[side])) > 0.9 * len(np.unique(found["text"] << 32 | found["node"]))


def test_windows_cover_all_long_subsequences():
    rng = np.random.default_rng(8)
    tokens = rng.integers(0, 25, 120).astype(np.uint64)
    each, least = np.array([70, 0, 50]), 12
    found = passages._windows(tokens, each, least, 1)
    hashes = suffixes.mixed(tokens * np.uint64(2 + 0x9E3779B1) + np.uint64(1))
    keys = (hashes & ~suffixes._POSITION) | np.arange(120, dtype=np.uint64)
    for first, n in ((0, 70), (70, 50)):
        for i in range(first, first + n):
            for j in range(i + least - 1, first + n):
                node = i + int(keys[i : j + 1].argmin())
                own = [w for w in found.tolist() if w[1] == node and w[2] <= i and j <= w[3]]
                assert len(own) == 1
    assert all(right - left + 1 >= 1 for _, _, left, right in found.tolist())


def test_similar_spans_are_similar():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 40, 300).astype(np.uint64)
    b = np.concatenate([rng.integers(0, 1 << 40, 40).astype(np.uint64), a[50:150], rng.integers(0, 1 << 40, 40).astype(np.uint64)])
    assert passages.similar_spans(b, a, 46, 0.8) == [(40, 140)]
    assert passages.similar_spans(b[:80], a, 46, 0.8) == []
    assert passages.similar_spans(b[:0], a, 46, 0.8) == [] and passages.similar_spans(b, a[:0], 46, 0.8) == []


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(25):
            v = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 5))):
                rows.append((n, (v + rng.standard_normal(16) * rng.choice([0, 0.02, 0.06])).astype(np.float32).tolist(), label))
                n += 1
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(n + k, v, 1) for k, v in enumerate(odd)] + [(5, rows[5][1], rows[5][2]), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "2 as links", "'a' as vector")
    got = projections.near_vectors(df, scheme=projections.Scheme(tile=16)).collect()
    assert len(got) == len(rows)

    def fit(v):
        return v and None not in v and np.isfinite(v).all() and any(v)

    usable = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and fit(v)]
    links, degree = [(i, i) for i, *_ in usable], Counter()
    for x in range(len(usable)):
        for y in range(x):
            (i, a, la), (j, b, lb) = usable[x], usable[y]
            if la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links.append((i, j))
                degree[x] += 1
                degree[y] += 1
    root = reachable(links)
    wanted = sorted((i, degree[x], root[i]) for x, (i, *_) in enumerate(usable))
    ids = {i for i, *_ in usable}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in ids) == wanted
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id not in ids)
    assert projections.near_vectors(df.limit(0)).count() == 0


def test_most_calibrated_pairs_are_counted():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((3000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    i, j = projections.near_pairs(x, y, projections.Scheme(), False)
    assert (i == j).all() and len(i) > 0.995 * len(x)


def test_text_hash_is_the_jvm_one(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("abc"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"abc", 42)


def test_texts_over_16_megabytes_are_anchored_like_their_copies():
    rng = np.random.default_rng(11)
    period = rng.integers(97, 123, 60, np.uint8).tobytes()
    passage = period * 10
    long = bytearray(rng.integers(97, 123, (1 << 24) + 100_000, np.uint8).tobytes())
    at = (1 << 24) - 300
    long[at : at + 600] = passage
    short = rng.integers(97, 123, 500, np.uint8).tobytes() + passage + rng.integers(97, 123, 500, np.uint8).tobytes()

    def keys(text, low):
        runs = suffixes.anchored_runs([text], 400)
        first, last = runs["anchor"] - runs["far"], runs["anchor"] - runs["near"]
        return {
            p - low: (int(runs["bucket"][k]), int(runs["side"][k]), int(runs["anchor"][k]) - p)
            for k in np.flatnonzero((last >= low) & (first <= low + 200))
            for p in range(max(low, int(first[k])), min(low + 200, int(last[k])) + 1)
        }

    one, two = keys(bytes(long), at), keys(short, 500)
    assert len(one) == len(two) == 201 and one == two


def test_many_equal_rows_are_linear(spark):
    text = prose(70, 300)
    rows = [(1, text)] * 3000 + [(2, prose(71, 300))]
    got = suffixes.remove_repeats(documents(spark, rows, extra=False)).collect()
    assert len(got) == 3001
    assert {(r.doc, r.n_removed == r.n_bytes, r.n_removed) for r in got} == {(1, True, len(text)), (2, False, 0)}


def test_simhash_keeps_other_texts_of_one_id(spark):
    rows = [(1, prose(80, 200)), (1, prose(81, 200)), (1, prose(81, 200)), (2, prose(80, 200)), (3, prose(82, 100))]
    kept = simhash.keep_one(documents(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == sorted({rows[0], rows[1], rows[4]})


def test_distinct_tokens_of_stretches():
    rng = np.random.default_rng(21)
    for kinds in (2, 9, 1000):
        tokens = rng.integers(0, kinds, 150).astype(np.uint64)
        wanted = [len(set(tokens[p : p + 46].tolist())) for p in range(105)]
        assert passages._distinct_tokens(tokens, 46).tolist() == wanted
    assert len(passages._distinct_tokens(tokens[:20], 46)) == 0


def test_spans_between_many_changes_are_found():
    # No cut at a widest gap finds these: a change in every 32 tokens, so any two stretches beside one are similar.
    rng = np.random.default_rng(22)
    earlier = rng.integers(0, 1 << 40, 300).astype(np.uint64)
    later = earlier.copy()
    for at in range(10, 290, 32):
        later[at : at + 5] = rng.integers(1 << 41, 1 << 42, 5)
    spans = passages.similar_spans(later, earlier, 46, 0.8)
    assert {p for a, b in spans for p in range(a, b)} >= set(range(15, 300))
    for a, b in spans:
        common = len(set(later[a:b].tolist()) & set(earlier[a:b].tolist()))
        assert common >= 0.8 * (2 * (b - a) - common)


def test_changes_at_the_edge_of_a_shortest_passage():
    rng = np.random.default_rng(23)
    earlier, later = (rng.integers(0, 1 << 40, 60).astype(np.uint64) for _ in range(2))
    later[9:50] = earlier[9:50]  # 41 of 46 tokens, 41 / 51
    spans = passages.similar_spans(later, earlier, 46, 0.8)
    assert len(spans) == 1 and spans[0][0] <= 9 and spans[0][1] >= 50 and spans[0][1] - spans[0][0] == 46
    later[49] = 0
    assert passages.similar_spans(later, earlier, 46, 0.8) == []


def test_runs_of_one_word_need_a_passage_on_both_sides():
    run, rng = np.full(80, 7, np.uint64), np.random.default_rng(24)
    rest = rng.integers(100, 1 << 40, 120).astype(np.uint64)
    assert passages.similar_spans(run, np.concatenate([rest[:50], run[:20], rest[50:]]), 46, 0.8) == []
    assert passages.similar_spans(run, np.concatenate([rest[:50], run[:60], rest[50:]]), 46, 0.8)


def test_candidates_are_all_windows_with_enough_common_tokens():
    rng = np.random.default_rng(25)
    base = rng.integers(0, 1 << 60, (6, 91)).astype(np.uint64)
    rows = []
    for key in range(6):
        for doc in range(int(rng.integers(2, 40))):
            tokens = base[key].copy()
            for at in rng.integers(0, 91, int(rng.integers(0, 5))):
                tokens[at : at + 5] = rng.integers(0, 1 << 60, 5)[: 91 - at]
            around, need = passages.surroundings(tokens, *(np.array([45]) for _ in range(3)), 46)
            rows.append((key, doc, around[0], int(need[0]), tokens))
    group = {
        "key": np.array([r[0] for r in rows]), "doc": np.array([r[1] for r in rows]),
        "around": np.stack([r[2] for r in rows]), "need": np.array([r[3] for r in rows], np.int32),
        "open": np.ones(len(rows), bool),
    }
    got = {(i, j) for i, j, _ in passages.best_earlier(group, 0, 1000)}
    wanted = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            most = max(len(set(a[4].tolist()) & set(b[4][p : p + 46].tolist())) for p in range(46))
            if a[0] == b[0] and most >= 41:
                wanted.add((i, j))
    assert wanted and got >= wanted
    assert len(got - wanted) <= len(wanted) // 10  # tokens that share their 16 bits


def test_windows_that_share_a_phrase_only_make_no_pairs(monkeypatch):
    rng = np.random.default_rng(26)
    size = 4000
    around = rng.integers(1, 1 << 16, (size, 91)).astype(np.uint16)
    around[:, 38:52] = around[0, 38:52]  # the phrase, 14 tokens
    around[size // 2 :: 4, 60:] = 9  # and a repeated word behind it
    around[3000, 20:70] = around[700, 20:70]
    need = np.full(size, 46, np.int32)
    need[size // 2 :: 4] = 30
    group = {"key": np.zeros(size, np.int64), "doc": np.arange(size), "around": around, "need": need, "open": np.ones(size, bool)}
    looked_at, sketches = [], passages._sketches
    monkeypatch.setattr(passages, "_sketches", lambda rows: looked_at.append(len(rows)) or sketches(rows))
    assert [pair[:2] for pair in passages.best_earlier(group, 0, 10)] == [(3000, 700)]
    assert sum(looked_at) < 400


def test_runs_of_words_have_few_windows(spark):
    other = [f"{prose(9000 + n, 60)}" for n in range(4)]
    texts = [b"word " * 800, b"one two three " * 300]
    assert len(passages.compact_windows(texts[:1], 46, 4)["node"]) <= 4 * 51
    assert len(passages.compact_windows(texts[1:], 46, 4)["node"]) <= 4 * 120
    # A long run is covered from end to end by the short one of an earlier document, at any place.
    rows = [(1, f"{other[0]} {'word ' * 70}{other[1]}"), (2, f"{other[2]} {'word ' * 900}{other[3]}")]
    spans = passages.passages_by_text(passages.near_passages(documents(spark, rows))).collect()
    covered = {w for row in spans for s in row.spans for w in range(s.low, s.high)}
    assert {row.doc for row in spans} == {2} and covered >= set(range(60, 960))


def test_candidates_of_several_rounds_are_found_in_one_pass(spark, monkeypatch):
    # A comparison that never finds a passage leaves all windows open, so all candidates are gone through.
    passes, rounds, made = [], [], passages._candidates
    rows = [(n, f"{prose(9600 + n, 30)} {prose(9500, 60)} {prose(9700 + n, 30)}") for n in range(24)]
    nothing = spark.createDataFrame([], "doc long, mark long, other long, low long, high long")
    monkeypatch.setattr(passages, "_candidates", lambda *a: passes.append(a) or made(*a))
    monkeypatch.setattr(passages, "_compared", lambda pairs, *_: rounds.append(pairs.select("doc", "other").distinct().count()) or nothing)
    assert passages.near_passages(documents(spark, rows)).count() == 0
    # The first documents, then 1, 4 and 16 candidates of each window and what is left.
    assert len(rounds) == 5 and sum(rounds[1:]) >= 24 * 23 // 2
    assert len(passes) == 1


@pytest.mark.parametrize("rows_at_once", [1, 7, 10_000])
def test_met_windows_and_the_first_alike(rows_at_once):
    rng = np.random.default_rng(41)
    size = 600
    columns = {n: rng.integers(0, top, size) for n, top in (("key", 60), ("doc", 8), ("mark", 2), ("node", 9), ("before", 3), ("after", 3), ("ahead", 3), ("behind", 2))}
    columns["key"][rng.random(size) < 0.4] = 7  # a frequent one
    order = np.lexsort([columns[n] for n in ("after", "before", "node", "doc", "key")])
    columns = {n: c[order].astype(np.int32 if n in ("node", "before", "after") else np.int64) for n, c in columns.items()}
    batches = pa.table(columns).to_batches(max_chunksize=50)
    got = [row for batch in passages._met_rows(rows_at_once)(iter(batches)) for row in batch.to_pylist()]
    rows = [dict(zip(columns, row, strict=True)) for row in zip(*(c.tolist() for c in columns.values()), strict=True)]
    docs = {}
    for r in rows:
        docs.setdefault(r["key"], set()).add(r["doc"])
    wanted = [r for r in rows if len(docs[r["key"]]) > 1]
    assert [[g[n] for n in ("key", "doc", "mark", "node", "before", "after")] for g in got] == [
        [r[n] for n in ("key", "doc", "mark", "node", "before", "after")] for r in wanted
    ]
    for g, r in zip(got, wanted, strict=True):
        pairs = []
        for side in ("ahead", "behind"):
            one = min(
                ((o["doc"], o["node"], o["before"], o["after"]) for o in wanted if o["key"] == r["key"] and o[side] == r[side])
            )
            pairs.append((one[0], one[1], min(one[2], r["before"]), min(one[3], r["after"])) if one[0] < r["doc"] else None)
        made = [tuple(g[f"{side}_{n}"] for n in ("doc", "node", "before", "after")) for side in ("ahead", "behind")]
        assert {p for p in made if p[0] is not None} == {p for p in pairs if p}


def test_bounds_of_rising_runs_of_windows():
    rng = np.random.default_rng(42)
    for values in (np.arange(500), np.append(np.arange(300)[::-1], np.arange(300)), rng.integers(0, 40, 700)):
        first = np.arange(len(values)) // 250 * 250
        for passes in (operator.gt, operator.ge):
            last, bound = passages._nearest(values, np.arange(len(values)) - 1, first, passes)
            for i, value in enumerate(values.tolist()):
                before = [j for j in range(first[i], i) if not passes(values[j], value)]
                assert bound[i] == bool(before) and (not before or last[i] == before[-1])


@pytest.mark.parametrize("rows_at_once", [1, 50, 10_000])
def test_regions_do_not_depend_on_batches(rows_at_once):
    rng = np.random.default_rng(43)
    seeds = set()
    for _ in range(900):
        pair, at, function = int(rng.integers(12)), int(rng.integers(0, 300)), int(rng.integers(4))
        shift = 40 * (pair % 3) + int(rng.integers(3))
        before, after = (int(x) for x in rng.integers(0, 40, 2))
        seeds.add((pair // 3 + 9, pair % 3, at + shift << 32 | at, before << 34 | after << 4 | function))
    rows = sorted(seeds, key=lambda s: s[:2]) * 2  # twice: union of both contexts
    rows.sort(key=lambda s: s[:2])
    table = pa.table(dict(zip(("doc", "other", "nodes", "reaches"), zip(*rows, strict=True), strict=True)))
    got = [r for b in passages._region_rows(2, rows_at_once)(iter(table.to_batches(max_chunksize=33))) for r in b.to_pylist()]
    wanted = []
    for pair in sorted({s[:2] for s in seeds}):
        windows = []
        for _, _, nodes, reaches in (s for s in seeds if s[:2] == pair):
            node, other = nodes >> 32, nodes & (1 << 32) - 1
            windows.append((node - (reaches >> 34), node + (reaches >> 4 & (1 << 30) - 1), node - other, reaches & 15))
        found = passages.regions_of(sorted(windows), 2)
        if found:
            lows, highs, other_lows, other_highs = (list(x) for x in zip(*found, strict=True))
            wanted.append({"doc": pair[0], "other": pair[1], "later": True, "lows": lows, "highs": highs})
            wanted.append({"doc": pair[1], "other": pair[0], "later": False, "lows": other_lows, "highs": other_highs})
    assert wanted and got == wanted


def test_few_calls_compare_a_region_of_repeated_tokens(monkeypatch):
    # Sets were made anew for each stretch looked at, several sorts each.
    rng = np.random.default_rng(44)
    earlier = rng.integers(0, 1 << 40, 600).astype(np.uint64)
    later = earlier.copy()
    later[rng.integers(0, 600, 90)] = 5
    sorts, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: sorts.append(1) or unique(*a, **k))
    passages.similar_spans(later, earlier, 46, 0.8)
    assert len(sorts) <= 2
