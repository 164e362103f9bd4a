"""SentencePiece models run by the tokenizers library.

The model file is parsed field by field; its normaliser, white-space marker, scores and byte fallback
are rebuilt as a tokenizer of that library. For a BPE model the merges follow from the scores.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_text
from .tokens import PieceEncoder, encoder, key_of

MARKER = "▁"
# Kinds of pieces and of models in the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        else:
            if wire == 2:
                size, at = varint(at)
            else:
                size = {1: 8, 5: 4}[wire]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)


def parse_model(data: bytes) -> Model:
    """The parts of a model file that encoding and decoding need (fixed field numbers)."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            model.suffix_marker = bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first; of one piece the shortest left part first."""
    known = {piece for piece, _, kind in model.pieces if kind == NORMAL}
    out = []
    for rank, (piece, score, kind) in enumerate(model.pieces):
        if kind == NORMAL:
            out += [
                (-score, rank, piece[:n], piece[n:])
                for n in range(1, len(piece)) if piece[:n] in known and piece[n:] in known
            ]
    return [(left, right) for *_, left, right in sorted(out, key=lambda m: m[:2])]


def build_tokenizer(model: Model, prefixed: bool = True):
    """The model as a tokenizer. Without ``prefixed`` texts must come with the marker they need."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if model.suffix_marker or not model.escape or any(kind == USER_DEFINED for *_, kind in model.pieces):
        raise ValueError("models with suffix markers, plain spaces or user-defined pieces are not supported")
    unknown = model.unknown
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {piece: n for n, (piece, *_) in enumerate(model.pieces)}
        core = models.BPE(
            vocabulary, _merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model kind {model.kind} is not supported")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if prefixed and model.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARKER)])
    parts = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(parts)
    return tokenizer


_CUT = re.compile(r"(?<=[^ ])(?= )")


class SentencePieceEncoder(PieceEncoder):
    """Ids of whole texts; a piece is the white-space run in front of a word, and the word.

    Pieces may be encoded alone only if no vocabulary entry has a marker behind another character,
    and if the normaliser leaves texts as they are; otherwise whole texts are encoded.
    """

    def _load(self, path: str):
        # Two threads for a batch; the variables count when the library first makes its threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        import sentencepiece

        with open(path, "rb") as file:
            data = file.read()
        model = parse_model(data)
        self.split = (
            not any(MARKER in piece.lstrip(MARKER) for piece, *_ in model.pieces)
            and not model.charsmap and not model.squeeze and model.dummy_prefix
        )
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.whole = build_tokenizer(model)
        #: Pieces whose ids are not those of the reference.
        self.differing = 0
        return build_tokenizer(model, prefixed=False) if self.split else self.whole

    def _widths(self) -> np.ndarray:
        return np.zeros(0, np.int64)

    def _coded_words(self, words: list[str], widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._coded([" " + word for word in words])  # one by one, as each is compared with the reference

    def _found(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._listed(parts)

    def _prepared(self, text: str) -> str:
        return " " + text if self.split else text

    def _keys(self, text: str) -> list[str]:
        if not self.split:
            return [" " + text]
        if "  " in text:
            return [key_of(piece) for piece in _CUT.split(text)]
        return text.split(" ")[1:] if text[0] == " " else [key_of(piece) for piece in _CUT.split(text)]

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        found = super()._ids(pieces)
        # The reference adds the marker in front itself.
        plain = [piece[1:] if self.split and piece[:1] == " " else piece for piece in pieces]
        marker = [self.reference.piece_to_id(MARKER)]
        for n, ids in enumerate(self.reference.encode(plain)):
            if self.split and pieces[n] == " ":  # a marker alone, which no text of its own gives
                ids = marker
            if ids != found[n]:
                self.differing += 1
                found[n] = ids
        return found

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


class ByteDecoder:
    """UTF-8 bytes of many ids at once, from a table with the bytes of every id.

    The table holds what the library's decoder makes of a single id: a piece with its markers as
    spaces, or the byte of a fallback piece. The dummy prefix in front of a text is left out.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            model = parse_model(file.read())
        entries = [
            bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(MARKER, " ").encode()
            for piece, _, kind in model.pieces
        ]
        self.strip = model.dummy_prefix
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = np.frombuffer(b"".join(entries), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        data = self.table[at].tobytes()
        return data[1:] if self.strip and data[:1] == b" " else data


def _coded(path: str):
    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, SentencePieceEncoder)
        back = ByteDecoder(path)
        for part in parts:
            out: list[tuple] = []
            seen = coder.differing
            texts = (t.as_py() for t in part.column("body"))
            again = ((t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column("body"))
            for doc, ids, text in zip(part.column("doc").to_pylist(), coder.encode(texts), again, strict=True):
                out.append((doc, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), back(ids) == text))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            differing = pa.array(np.full(len(out), coder.differing - seen), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*arrays, differing], ["doc", "n_ids", "ids_crc32", "round_trip", "differing_pieces"]
            )

    return rows


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_ids, ids_crc32, round_trip, differing_pieces) for every row.

    Whole texts are encoded by the tokenizers library and decoded again; ``round_trip`` tells whether
    the text came back. Every piece that a worker meets for the first time is also encoded by the
    sentencepiece library; ``differing_pieces`` counts, for the batch of rows, the new pieces whose ids
    were not the same, and then the ids of the model's own library are used. Null texts count as empty
    and have no ids. Repeated rows and null ids are treated like others; other columns are not read.
    """
    return keyed_text(docs, id_col, text_col).mapInArrow(
        _coded(path), "doc long, n_ids long, ids_crc32 long, round_trip boolean, differing_pieces long"
    )
