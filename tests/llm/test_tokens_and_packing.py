import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sieveline.llm import counts, mixing, packing, tokenfiles
from sieveline.llm.common import tokenizer_path
from sieveline.llm.tokens import PieceEncoder, segments

from .helpers import ROWS, documents, no_documents

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
OWN = PieceEncoder(PATH)
ODD = st.text(alphabet=" \n\t  aAbz'.,!-_09é日😀<|>", max_size=40)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=4))
def test_pieces_encode_as_whole_texts(texts):
    assert [list(x) for x in OWN.encode(texts)] == [ids_of(t) for t in texts]


def test_long_texts_and_forgotten_pieces():
    text = " ".join(f"w{n % 97}x{n % 13}" + "\n" * (n % 3 == 0) for n in range(4000)) + "  <|endoftext|> end"
    assert len(list(segments(text, 500))) > 3 and "".join(segments(text, 500)) == text
    small = PieceEncoder(PATH, limit=50)
    for _ in range(2):
        assert [list(x) for x in small.encode([text, None, text[:99]])] == [ids_of(text), [], ids_of(text[:99])]


def fewest(sizes, capacity):
    """Least number of bins by trying all ways."""
    best = len(sizes)

    def place(n, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if n == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[n]:
                rest = list(rooms)
                rest.remove(room)
                place(n + 1, [*rest, room - sizes[n]])
        place(n + 1, [*rooms, capacity - sizes[n]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best if sizes else 0


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_dominating_sets_leave_an_optimum(sizes):
    histogram = {n: sizes.count(n) for n in set(sizes)}
    fixed, left = packing.reduce_lengths(histogram, 12)
    rest = [n for n, k in left.items() for _ in range(k)]
    assert sum(b.count for b in fixed) + fewest(rest, 12) == fewest(sizes, 12)
    bins = packing.plan_bins(histogram, 12)
    placed = sorted(n for b in bins for n, k in b.items for _ in range(k * b.count))
    assert placed == sorted(sizes)
    assert all(sum(n * k for n, k in b.items) <= 12 for b in bins)
    assert sum(b.count for b in bins) <= fewest(sizes, 12) * 11 / 9 + 1


def test_runs_give_every_rank_one_place():
    bins = packing.plan_bins({7: 5, 5: 4, 3: 9, 2: 1, 10: 3}, 10)
    seen = set()
    for length, rank, sequence, offset in packing.runs_of(bins).tolist():
        assert offset + length <= 10
        seen.add((length, rank, sequence, offset))
    assert len(seen) == len(packing.runs_of(bins))


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packed_pieces(spark, capacity):
    rows = packing.pack_documents(documents(spark), PATH, capacity).collect()
    wanted = sorted(zlib.crc32(np.array([*ids_of(t), 0], "<u4")[:0].tobytes()) for _, t in ROWS)
    assert len(wanted) == len(ROWS)
    texts = {}
    for doc, text in ROWS:
        texts.setdefault(doc, []).append(np.array([*ids_of(text), 0], "<u4"))
    for r in rows:
        assert any(
            zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in texts[r.doc]
        )
        assert r.length == capacity or r.piece == 0
    assert sum(r.length for r in rows) == sum(len(i) for ids in texts.values() for i in ids)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert packing.pack_documents(no_documents(spark), PATH).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60_000), max_size=300), st.integers(1, 4))
def test_blocks_round_trip(ids, n_docs):
    sizes = np.full(n_docs, len(ids) // n_docs)
    sizes[-1] += len(ids) - sizes.sum()
    block = mixing.write_block(np.arange(n_docs) - 1, sizes, np.array(ids, np.int64))
    docs, back_sizes, back = mixing.read_block(block)
    assert back.tolist() == ids and back_sizes.tolist() == sizes.tolist() and docs.tolist() == list(range(-1, n_docs - 1))


def test_blocks_shrink_and_refuse_damage():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 50) + np.array([3, 900, 41, 7]) for _ in range(20_000)])
    block = mixing.write_block(np.array([1]), np.array([len(ids)]), ids)
    assert len(block) < len(ids)
    assert np.array_equal(mixing.read_block(block)[2], ids)
    for at in (0, 20, 60, len(block) - 1):
        bent = bytearray(block)
        bent[at] ^= 4
        with pytest.raises(ValueError):
            mixing.read_block(bytes(bent))
    with pytest.raises(ValueError):
        mixing.read_block(block[:10])


def test_token_files(spark):
    rows = tokenfiles.encode_and_read(documents(spark), PATH).collect()
    assert len(rows) == len(ROWS)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    wanted = sorted(zlib.crc32(np.array([*ids_of(t), 0], "<u4").tobytes()) for _, t in ROWS)
    assert sorted(r.ids_crc32 for r in rows) == wanted
    assert tokenfiles.encode_and_read(no_documents(spark), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_trees_follow_edits(data):
    words = data.draw(st.lists(st.sampled_from(["ab", "c,", "\n", " ", "x'y", "日本", "end."]), max_size=400))
    text = " ".join(words)
    spots = sorted(data.draw(st.sets(st.integers(0, max(0, len(text))), max_size=8)))
    edits = [(a, b, data.draw(ODD)) for a, b in zip(spots[::2], spots[1::2], strict=False)]
    tree = counts.TokenTree(text, OWN)
    tree.edit(*edits)
    for a, b, new in reversed(edits):
        text = text[:a] + new + text[b:]
    assert tree.text == text
    assert tree.n_tokens == len(ids_of(text))
    tree.edit((0, min(3, len(text)), "Z "))
    assert tree.n_tokens == len(ids_of("Z " + text[min(3, len(text)) :]))


def test_an_edit_encodes_little():
    text = " ".join(f"word{n}" for n in range(20_000))
    tree = counts.TokenTree(text, OWN)
    tree.edit((60_000, 60_003, "new"))
    assert tree.encoded < 3000 and tree.n_tokens == len(ids_of(tree.text))


def test_counts_of_redacted_texts(spark):
    secret = ROWS + [(11, "mail a.b@c.example.org now, 10.1.2.3 ### ok"), (11, "mail a.b@c.example.org now, 10.1.2.3 ### ok")]
    rows = counts.count_redacted(documents(spark, secret), PATH).collect()
    assert len(rows) == len(secret)
    mailed = [r for r in rows if r.doc == 11]
    assert [(r.n_edits, r.n_after) for r in mailed] == [(3, len(ids_of("mail MAIL now, IP  ok")))] * 2
    assert all(r.n_after == r.n_tokens and not r.chars_encoded for r in rows if not r.n_edits)
    assert sorted(r.n_tokens for r in rows) == sorted(len(ids_of(t)) for _, t in secret)
    assert counts.count_redacted(no_documents(spark), PATH).count() == 0


class Counted(PieceEncoder):
    """Counts the texts that go to the library."""

    texts = 0

    def _ids(self, pieces):
        self.texts += len(pieces)
        return super()._ids(pieces)


def test_new_words_share_a_text():
    text = " ".join(f"word{n:05d}x," for n in range(20_000))
    own = Counted(PATH)
    assert list(next(own.encode([text]))) == ids_of(text)
    assert own.texts < 1000


def test_frequent_pieces_are_not_forgotten():
    own = Counted(PATH, limit=6000)
    common = " ".join(f"often{n}" for n in range(1000))
    for n in range(9):
        text = common + "".join(f" rare{n}x{k}" for k in range(2500))
        assert list(next(own.encode([text]))) == ids_of(text)
    before = own.texts
    assert list(next(own.encode([common]))) == ids_of(common) and own.texts == before
    assert len(own.index) < 8600


def test_arrow_cuts_where_the_patterns_cut():
    own, texts = PieceEncoder(PATH), ["plain text " * 2000]
    for space in [chr(n) for n in range(0x3001) if chr(n).isspace()]:
        texts += [f"a{space} b", f"{space}b c", f"a{space}", f"a {space}b", f"{space}"]
    assert [list(x) for x in own.encode(texts)] == [ids_of(t) for t in texts]
