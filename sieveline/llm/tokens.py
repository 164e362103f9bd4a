"""Fast exact use of a byte-level BPE tokenizer: encode each distinct piece once.

A byte-level pre-tokenizer never joins a non-space character with the white space after it, so a
text may be cut in front of any space that follows a non-space character, and the pieces encode
alone to the same ids. A piece ("word", comma and line break included) is encoded by the tokenizers
library when it is first met; after that its ids are gathered from a table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A space next to other white space, or in front: there the plain split would cut too often.
_IRREGULAR = re.compile(r"\s |^ ")
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
# The same for Arrow, whose \s is narrower; a text that matches is cut by the patterns above.
_ARROW_IRREGULAR = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |^ |^$"
)
_SEGMENT = 1 << 20
_BATCH_CHARS = 6_000_000
_JOINED = 64  # new pieces that are encoded as one text
_FEW_CHARS = 1 << 14  # so short a batch is looked up piece by piece
# A key that is not a word between two spaces; these pieces are encoded alone.
_NO_WORD = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]$| |^$"


def segments(text: str, size: int = _SEGMENT) -> Iterator[str]:
    """Parts of at least ``size`` characters, cut at safe places; short texts are one part."""
    at = 0
    while len(text) - at > size:
        found = _SAFE_CUT.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def key_of(piece: str) -> str:
    """A key without a space stands for " " + key, of any other its first space goes."""
    return piece[1:] if piece[0] == " " and " " not in piece[1:] else " " + piece


def literal(key: str) -> str:
    return key[1:] if " " in key else " " + key


def keys_of(text: str) -> list[str]:
    """Keys of the pieces of a text."""
    if not text:
        return []
    if _IRREGULAR.search(text) is None:
        keys = text.split(" ")
        keys[0] = " " + keys[0]
        return keys
    return [key_of(piece) for piece in _SAFE_CUT.split(text)]


class PieceEncoder:
    """Ids of whole texts; of more than ``limit`` pieces it remembers those met in several batches."""

    def __init__(self, path: str, limit: int = 800_000) -> None:
        self.tokenizer = self._load(path)
        self.widths = self._widths()
        self.limit = limit
        self._reset()

    def _load(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def _keys(self, text: str) -> list[str]:
        return keys_of(text)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _widths(self) -> np.ndarray:
        """Bytes of every id: a vocabulary entry has one character for each, added tokens are plain text."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        widths = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        widths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        for number, token in self.tokenizer.get_added_tokens_decoder().items():
            widths[number] = len(token.content.encode())
        return widths

    def _coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each piece, all ids)."""
        ids = self._ids(pieces)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))

    def _coded_words(self, words: list[str], widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words with a space in front, many as one text, which is cut again by its bytes."""
        flat = self._coded([" " + " ".join(words[at : at + _JOINED]) for at in range(0, len(words), _JOINED)])[1]
        ends = np.cumsum(widths + 1)
        reached = np.cumsum(self.widths[flat])
        last = np.searchsorted(reached, ends)
        if len(last) and (last[-1] + 1 != len(flat) or (reached[last] != ends).any()):
            return self._coded([" " + word for word in words])
        return np.diff(last, prepend=-1), flat

    def _prepared(self, text: str) -> str:
        return text

    def _reset(self) -> None:
        self.index: dict[str, int] = {}  # numbers of keys, in order of first use
        self.unseen: list[str] = []  # the last of them, not encoded yet
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int32)
        self.chars = np.zeros(1 << 14, np.int32)
        self.uses = np.zeros(1 << 14, np.int32)
        self.used = 0
        self.met: list[np.ndarray] = []  # numbers looked up in this batch

    def _forget(self) -> None:
        """Keep the pieces that were met in most batches, of half the room at most, and none met in one only."""
        uses = self.uses[: len(self.index)]
        kept = np.flatnonzero(uses > 1)
        if len(kept) > self.limit // 2:
            kept = np.sort(kept[np.argsort(-uses[kept], kind="stable")[: self.limit // 2]])
        sizes = self.sizes[kept].astype(np.int64)
        ends = np.cumsum(sizes)
        if self.used > 8 * self.limit and (not len(ends) or ends[-1] > 4 * self.limit):
            self._reset()
            return
        keys = list(self.index)
        ids = self.ids[np.repeat(self.starts[kept] - ends + sizes, sizes) + np.arange(sizes.sum())]
        tables = self.sizes[kept], self.chars[kept], np.ones(len(kept), np.int32)
        self._reset()
        self.index = {keys[n]: m for m, n in enumerate(kept.tolist())}
        self._grow(len(kept), len(ids))
        self.starts[: len(kept)] = ends - sizes
        self.sizes[: len(kept)], self.chars[: len(kept)], self.uses[: len(kept)] = tables
        self.ids[: len(ids)] = ids
        self.used = len(ids)

    def _grow(self, pieces: int, ids: int) -> None:
        while pieces > len(self.sizes):
            for name in ("starts", "sizes", "chars", "uses"):
                table = getattr(self, name)
                setattr(self, name, np.concatenate([table, np.zeros_like(table)]))
        while ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])

    def _number(self, keys: list[str]) -> np.ndarray:
        """Numbers of keys; keys that are met for the first time get the next ones."""
        index = self.index
        numbers = np.fromiter(map(index.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            first, missed = len(index), [keys[n] for n in new.tolist()]
            fresh = list(dict.fromkeys(missed))
            index.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            self.unseen += fresh
            alike = len(fresh) < len(missed)
            numbers[new] = list(map(index.__getitem__, missed)) if alike else first + np.arange(len(new))
        self.met.append(numbers)
        return numbers

    def _learn(self) -> None:
        """Encode the pieces seen for the first time."""
        unseen, self.unseen = self.unseen, []
        first = len(self.index) - len(unseen)
        for at in range(0, len(unseen), 1 << 13):
            some = unseen[at : at + (1 << 13)]
            column = pa.array(some, pa.large_string())
            alone = pc.match_substring_regex(column, _NO_WORD).to_numpy(zero_copy_only=False)
            widths = pc.binary_length(column).to_numpy().astype(np.int64)
            # A key with a space stands for a piece of one character less.
            spaced = pc.match_substring(column, " ").to_numpy(zero_copy_only=False)
            self._grow(first + at + len(some), 0)
            places = first + at + np.arange(len(some))
            self.chars[places] = pc.utf8_length(column).to_numpy() + np.where(spaced, -1, 1)
            for mine in (np.flatnonzero(~alone), np.flatnonzero(alone)):
                if not len(mine):
                    continue
                keys = [some[n] for n in mine.tolist()]
                sizes, flat = self._coded([literal(k) for k in keys]) if alone[mine[0]] else self._coded_words(keys, widths[mine])
                self._grow(0, self.used + len(flat))
                self.sizes[places[mine]] = sizes
                self.starts[places[mine]] = self.used + np.cumsum(sizes) - sizes
                self.ids[self.used : self.used + len(flat)] = flat
                self.used += len(flat)

    def _listed(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of every piece, pieces of each part), looked up piece by piece."""
        keys: list[str] = []
        counts = np.zeros(len(parts), np.int64)
        for n, part in enumerate(parts):
            own = self._keys(part)
            counts[n] = len(own)
            keys += own
        return self._number(keys), counts

    def _found(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same; Arrow cuts regular texts, and each of their different pieces is looked up once."""
        if sum(map(len, parts)) < _FEW_CHARS:
            return self._listed(parts)
        column = pa.array(parts, pa.large_string())
        odd = pc.match_substring_regex(column, _ARROW_IRREGULAR)
        cut = pc.split_pattern(column.filter(pc.invert(odd)), " ")
        pieces = cut.flatten().dictionary_encode()
        keys = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = self._number(keys)[pieces.indices.to_numpy()]
        counts = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum(counts) - counts
        # The first piece of a text has no space in front.
        which[firsts] = self._number([" " + keys[n] for n in pieces.indices.to_numpy()[firsts]])
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return which, counts
        both, own = np.zeros(len(parts), np.int64), iter(np.split(which, firsts[1:]) if len(firsts) else [])
        others, both[odd] = self._listed([part for part, is_odd in zip(parts, odd, strict=True) if is_odd])
        both[~odd] = counts
        other = iter(np.split(others, np.cumsum(both[odd])[:-1]))
        return np.concatenate([next(other if is_odd else own) for is_odd in odd]), both

    def _numbers(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of every piece, pieces of each part); new pieces are encoded."""
        if len(self.index) > self.limit or self.used > 8 * self.limit:
            self._forget()
        which, counts = self._found(parts)
        if self.unseen:
            self._learn()
        for numbers in self.met:
            self.uses[numbers] += 1
        self.met = []
        return which, counts

    def _encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        which, counts = self._numbers(parts)
        sizes = self.sizes[which].astype(np.int64)
        ends = np.cumsum(sizes)
        # Places are few enough for 32 bits: some ids for each of ``limit`` pieces and of one batch.
        places = np.repeat((self.starts[which] - ends + sizes).astype(np.int32), sizes)
        places += np.arange(len(places), dtype=np.int32)
        flat = self.ids[places]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, np.diff(bounds)

    def piece_counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(characters, ids) of every piece of some texts, and the pieces of each text."""
        chars, sizes = [], []
        pieces = np.zeros(len(texts), np.int64)
        held: list[tuple[int, str]] = []
        total = 0

        def flush() -> None:
            which, counts = self._numbers([part for _, part in held])
            np.add.at(pieces, [n for n, _ in held], counts)
            chars.append(self.chars[which].astype(np.int64))
            sizes.append(self.sizes[which].astype(np.int64))
            held.clear()

        for n, text in enumerate(texts):
            for part in segments(self._prepared(text)) if text else ():
                held.append((n, part))
                total += len(part)
                if total > _BATCH_CHARS:
                    flush()
                    total = 0
        flush()
        return np.concatenate(chars), np.concatenate(sizes), pieces

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn (null counts as empty)."""
        waiting: list[list[str]] = []
        held = 0
        for text in texts:
            parts = list(segments(self._prepared(text))) if text else []
            waiting.append(parts)
            held += len(text or "")
            if held > _BATCH_CHARS:
                yield from self._flush(waiting)
                waiting, held = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[str]]) -> Iterator[np.ndarray]:
        if len(waiting) == 1 and len(waiting[0]) > 1:  # one very long text: a part at a time
            yield np.concatenate([self._encode_parts([part])[0] for part in waiting[0]])
            return
        flat, sizes = self._encode_parts([part for parts in waiting for part in parts])
        at = part = 0
        for parts in waiting:
            n = int(sizes[part : part + len(parts)].sum())
            yield flat[at : at + n]
            at, part = at + n, part + len(parts)


_encoders: dict[tuple[type, str], PieceEncoder] = {}


def encoder(path: str, kind: type[PieceEncoder] = PieceEncoder) -> PieceEncoder:
    """One encoder for each worker process and file."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]
