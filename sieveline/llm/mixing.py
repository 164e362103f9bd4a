"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks.

A block holds whole documents. Its ids are dealt to lanes, runs of neighbouring ids that are coded side
by side: in every step each lane codes its next id, and then all lanes' ids update one model, so the
work of a step is done on arrays. The model predicts one id from the last two ids (order 2), one from
the last id (order 1), and has the counts of all ids (order 0). The chances that the order-2 and the
order-1 id are right are mixed from the three orders in the logistic domain, with weights that are
learned on the way; any other id is coded by its count.

What the orders say is a small number of states: how often each prediction was right of late, whether
the two agree, and how frequent the predicted id is. Chances are mixed once for each state, not for each
id, and the weights learn from the numbers of right and wrong predictions in each state. All sums are of
whole numbers, so a reader does exactly what the writer did; every block starts afresh.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"SLM3"
HEADER = struct.Struct("<4sIQIIIII")  # magic, documents, ids, alphabet, lanes, steps, CRC of ids, CRC of the rest
LANES = 16384
STEPS = 128  # least ids in a lane where there are enough of them
_SLOTS = 20  # bits of the order-2 table
_SCALE = 22  # most bits of the range that ids not predicted are dealt
_U = np.uint64
# A range of 62 bits gives off 16 at a time, once they are settled or fewer than 39 are left of it.
_TOP, _BOTTOM, _WORD = _U(1 << 46), _U(1 << 39), _U((1 << 62) - 1)
_LEVELS = 8  # classes of an id's frequency, for prediction
_LEVEL_OF = np.searchsorted([1, 2, 4, 8, 16, 32, 64], np.arange(65), side="right").astype(np.int32)  # by the share in 1/1024

# Chances are in 1/4096, their logits in 1/256.
_STRETCH = np.array([0] + [round(256 * math.log(p / (4096 - p))) for p in range(1, 4096)], np.int64)
_REACH = 2047
_SQUASH = np.array(
    [min(4088, max(8, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-_REACH, _REACH + 1)], np.int64
)
_LEVEL_LOGIT = np.array([_STRETCH[max(1, min(4095, 1 << (k + 2)))] for k in range(_LEVELS)], np.int64)
# A state is (order-2 trust, order-1 trust, agreement, level of the order-2 id).
_STATES = 16 * 16 * 2 * _LEVELS
_STATE = np.arange(_STATES)
_T2, _T1, _AGREE, _LEVEL = _STATE >> 8, _STATE >> 4 & 15, _STATE >> 3 & 1, _STATE & 7
_STATES1 = 16 * _LEVELS
# What a wrong or right prediction adds to id * 16 + trust, by right * 16 + trust.
_TRUST = np.arange(16)
_STEP = np.concatenate([-((_TRUST + 1) >> 1), _TRUST < 15]).astype(np.int32)


def _squash(x: np.ndarray) -> np.ndarray:
    return _SQUASH[np.clip(np.rint(x), -_REACH, _REACH).astype(np.int64) + _REACH]


class _Model:
    """What writer and reader know before a step; ``update`` takes what they learn in it."""

    def __init__(self, alphabet: int, reads: bool = False) -> None:
        self.alphabet = alphabet
        self.scale = max(20, min(_SCALE, alphabet.bit_length() + 4))
        self.shift = _U(self.scale)
        self.reads = reads
        # Predicted id and trust in it, as id * 16 + trust.
        self.second = np.zeros(1 << _SLOTS, np.int32)
        self.first = np.zeros(alphabet, np.int32)
        self.right2 = np.array([200 + 240 * k for k in range(16)], np.int64)
        self.right1 = np.array([200 + 240 * k for k in range(16)], np.int64)
        # Weights for a disagreeing and an agreeing order-1 id, and for the order-1 id alone.
        self.weights = np.array([[0.9, 0.3, 0.1], [0.7, 0.6, 0.1]])
        self.alone = np.array([0.9, 0.1])
        self.counts = np.zeros(alphabet, np.int64)
        self.recent: list[np.ndarray] = []
        self.met: list[np.ndarray] = []
        self.met1: list[np.ndarray] = []
        self.step = 0
        self._rank()
        self._mix()

    def _rank(self) -> None:
        """Each id's part of the range, and the level of its frequency."""
        total = max(1, int(self.counts.sum()))
        room = (1 << self.scale) - self.alphabet
        sizes = (self.counts * ((room - 1) / total)).astype(np.int64) + 1
        ends = np.cumsum(sizes)
        self.sizes, self.starts, self.last = sizes.view(_U), (ends - sizes).view(_U), _U(ends[-1] - 1)
        self.level = _LEVEL_OF[np.minimum((self.counts * (1024 / total)).astype(np.int64), 64)]
        if self.reads:
            self.at = np.repeat(np.arange(self.alphabet, dtype=np.int32), sizes)

    def _mix(self) -> None:
        """The chances in every state, as shares of 65536 parts of the range."""
        one = _STRETCH[self.right1]
        self.inputs = np.stack([_STRETCH[self.right2][_T2], one[_T1] * (2 * _AGREE - 1), _LEVEL_LOGIT[_LEVEL]])
        w = self.weights[_AGREE]
        self.p2 = _squash(w[:, 0] * self.inputs[0] + w[:, 1] * self.inputs[1] + w[:, 2] * self.inputs[2])
        self.share2 = (self.p2 << 4).astype(_U)
        self.inputs1 = np.stack([np.repeat(one, _LEVELS), np.tile(_LEVEL_LOGIT, 16)])
        self.p1 = _squash(self.alone[0] * self.inputs1[0] + self.alone[1] * self.inputs1[1])
        # The second half is for order-1 ids that are the order-2 id, and have no share of their own.
        self.part1 = np.concatenate([self.p1, np.zeros(_STATES1, np.int64)]).view(_U)

    def predict(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Order-2 and order-1 ids, and up to where in 65536 the one and then the other reaches."""
        mixed = last.view(np.uint32) * np.uint32(0x9E3779B1) + before.view(np.uint32) * np.uint32(0x85EBCA77)
        mixed >>= np.uint32(7)
        mixed &= np.uint32((1 << _SLOTS) - 1)
        self.slot, self.prior = mixed.astype(np.int64), last
        self.v2, self.v1 = self.second[self.slot], self.first[last]
        c2, c1 = self.v2 >> 4, self.v1 >> 4
        self.t2, self.t1 = self.v2 & 15, self.v1 & 15
        same = (c1 == c2).view(np.int8)
        self.state = (self.t2 << 8) + (self.t1 << 4) + (same << 3) + self.level[c2]
        self.state1 = (self.t1 << 3) + same * np.int32(_STATES1) + self.level[c1]
        reach2 = self.share2[self.state]
        reach1 = (_U(65536) - reach2) * self.part1[self.state1]
        reach1 >>= _U(12)
        reach1 += reach2
        self.c1 = c1
        return c2, c1, reach2, reach1

    def update(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """``hit1`` is true where the order-1 id alone was right, and had a share to be coded by."""
        self.met.append(self.state + hit2 * np.int32(_STATES))
        self.met1.append(self.state1 + hit2 * np.int32(2 * _STATES1) + hit1 * np.int32(4 * _STATES1))
        fresh = ids << 4
        for table, slot, value, trust, right in (
            (self.second, self.slot, self.v2, self.t2, hit2),
            (self.first, self.prior, self.v1, self.t1, self.c1 == ids),
        ):
            known = trust + right * np.int32(16)
            value = value + _STEP[known]
            # An id that was wrong and not trusted gives way.
            value += (fresh - value) * (known == 0)
            table[slot] = value
        self.recent.append(ids)
        self.step += 1
        if self.step % 16 == 0 or self.step & (self.step - 1) == 0:
            self._learn()

    def _learn(self) -> None:
        wrong, right = np.bincount(np.concatenate(self.met), minlength=2 * _STATES).reshape(2, -1)
        n = wrong + right
        missed1, *_, right_1 = np.bincount(np.concatenate(self.met1), minlength=5 * _STATES1).reshape(5, -1)
        n_1 = missed1 + right_1
        n2, r2 = (m.reshape(16, -1).sum(axis=1) for m in (n, right))
        self.right2 += (r2 * 4095 - n2 * self.right2) // (n2 + 256)
        # The order-1 id was right where it agreed and order 2 was right, or where it alone was.
        n1, r1 = (
            m.reshape(16, 16, 2, -1)[:, :, 1].sum(axis=(0, 2)) + m1.reshape(16, -1).sum(axis=1)
            for m, m1 in ((n, n_1), (right, right_1))
        )
        self.right1 += (r1 * 4095 - n1 * self.right1) // (n1 + 256)
        for right_now in (self.right2, self.right1):
            np.clip(right_now, 8, 4088, out=right_now)
        error = (right << 12) - n * self.p2
        for agree in (0, 1):
            own = _AGREE == agree
            total = int(n[own].sum()) + 1
            for row in range(3):
                self.weights[agree, row] += int((error[own] * self.inputs[row, own]).sum()) / total * 2.0**-21
        error = (right_1 << 12) - n_1 * self.p1
        total = int(n_1.sum()) + 1
        for row in range(2):
            self.alone[row] += int((error * self.inputs1[row]).sum()) / total * 2.0**-21
        self.counts += np.bincount(np.concatenate(self.recent), minlength=self.alphabet)
        self.recent, self.met, self.met1 = [], [], []
        self._rank()
        self._mix()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def _settled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """True for lanes whose next 16 bits are settled; a range about to get too small is cut short."""
    settled = (low ^ (low + span)) < _TOP
    tight = span < _BOTTOM
    tight &= ~settled
    if tight.any():
        span[tight] = (_U(0) - low[tight]) & (_BOTTOM - _U(1))
        settled |= tight
    return settled


class _Ranges:
    """The lanes' ranges: where they begin, how long they are, and their parts in a step."""

    def __init__(self, lanes: int) -> None:
        self.low, self.span = np.zeros(lanes, _U), np.full(lanes, _WORD, _U)
        self.bounds = np.zeros((4, lanes), _U)
        self.lanes, self.lane = lanes, np.arange(lanes)

    def cut(self, on: int, reach2: np.ndarray, reach1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of the order-2 id and of the order-1 id end; the third part is for all others."""
        part = self.span[:on] >> _U(16)
        first, second = self.bounds[1, :on], self.bounds[2, :on]
        np.multiply(reach2, part, out=first)
        np.multiply(reach1, part, out=second)
        np.left_shift(part, _U(16), out=self.bounds[3, :on])
        return first, second

    def take(self, on: int, part: np.ndarray) -> None:
        """Go on with part 0, 1 or 2 of each range."""
        place = part * np.int64(self.lanes) + self.lane[:on]
        begin = self.bounds.ravel()[place]
        place += self.lanes
        self.low[:on] += begin
        np.subtract(self.bounds.ravel()[place], begin, out=self.span[:on])

    def take_share(self, which: np.ndarray, start: np.ndarray, size: np.ndarray, part: np.ndarray) -> None:
        self.low[which] += start * part
        self.span[which] = size * part

    def shift(self, on: int, moved) -> None:
        """Give off settled bits, 16 at a time; ``moved`` is called with the lanes before each time."""
        low, span = self.low[:on], self.span[:on]
        settled = _settled(low, span)
        which = np.flatnonzero(settled)
        moved(which)
        by = settled.astype(_U) << _U(4)
        low <<= by
        low &= _WORD
        span <<= by
        # Few have 16 bits more.
        which = which[_settled_again(low, span, which)]
        while len(which):
            moved(which)
            low[which] = (low[which] << _U(16)) & _WORD
            span[which] <<= _U(16)
            which = which[_settled_again(low, span, which)]


def _settled_again(low: np.ndarray, span: np.ndarray, which: np.ndarray) -> np.ndarray:
    own = span[which]
    settled = _settled(low[which], own)
    span[which] = own
    return settled


def encode_ids(ids: np.ndarray, alphabet: int) -> tuple[list[int], bytes]:
    """Bytes of each lane, and all their bytes one after the other."""
    n = len(ids)
    lanes, steps = _shape(n)
    model, ranges = _Model(alphabet), _Ranges(lanes)
    room = 3 * steps + 4
    # All lanes' first words, then all second ones: lanes get on alike, so what is written lies together.
    out = np.zeros(room * lanes, "<u2")
    at = np.arange(lanes)
    last, before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)

    def write(which: np.ndarray) -> None:
        place = at[which]
        out[place] = ranges.low[which] >> _U(46)
        place += lanes
        at[which] = place

    for step in range(steps):
        on = -(-(n - step) // steps)  # lanes that still have an id
        now = grid[step, :on]
        c2, c1, reach2, reach1 = model.predict(last[:on], before[:on])
        hit2 = now == c2
        hit1 = (now == c1) & ~hit2 & (reach1 > reach2)
        beyond = ~(hit2 | hit1)
        ranges.cut(on, reach2, reach1)
        ranges.take(on, hit1 + 2 * beyond.view(np.int8))
        others = np.flatnonzero(beyond)
        own = now[others]
        ranges.take_share(others, model.starts[own], model.sizes[own], ranges.span[others] >> model.shift)
        ranges.shift(on, write)
        model.update(now, hit2, hit1)
        before[:on] = last[:on]
        last[:on] = now
    # 32 bits name a number inside what is left of the range; the reader goes on with zeros.
    final = (ranges.low + _U((1 << 30) - 1)) >> _U(30)
    out[at], out[at + lanes] = final >> _U(16), final & _U(65535)
    used = at // lanes + 2
    room = int(used.max())
    kept = np.arange(room)[None, :] < used[:, None]
    return (2 * used).tolist(), np.ascontiguousarray(out[: room * lanes].reshape(room, lanes).T)[kept].tobytes()


def decode_ids(n: int, alphabet: int, lanes: int, steps: int, sizes: np.ndarray, data: bytes) -> np.ndarray:
    model, ranges = _Model(alphabet, reads=True), _Ranges(lanes)
    # Laid out as the writer had them, with as many zeros behind each lane's words as can be asked for.
    words = sizes // 2
    room = int(words.max(initial=0)) + 4
    raw = np.zeros((lanes, room), "<u2")
    raw[np.arange(room)[None, :] < words[:, None]] = np.frombuffer(data, "<u2")
    raw = np.ascontiguousarray(raw.T).ravel()
    at = np.arange(lanes)
    # The number has 62 bits: three words and 14 bits of a fourth, of which two bits wait.
    number = np.zeros(lanes, _U)
    for k in range(3):
        number = (number << _U(16)) | raw[at + k * lanes]
    at += 3 * lanes
    number = (number << _U(14)) | (raw[at] >> np.uint16(2))
    last, before = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    grid = np.zeros((steps, lanes), np.int32)

    def read(which: np.ndarray) -> None:
        place = at[which]
        new = (raw[place].astype(_U) << _U(14)) & _U(65535)
        place += lanes
        new |= raw[place] >> np.uint16(2)
        at[which] = place
        number[which] = ((number[which] << _U(16)) & _WORD) | new

    for step in range(steps):
        on = -(-(n - step) // steps)
        c2, c1, reach2, reach1 = model.predict(last[:on], before[:on])
        first, second = ranges.cut(on, reach2, reach1)
        inside = number[:on] - ranges.low[:on]
        missed2, beyond = inside >= first, inside >= second
        hit2, hit1 = ~missed2, missed2 & ~beyond
        ranges.take(on, missed2.view(np.int8) + beyond.view(np.int8))
        others = np.flatnonzero(beyond)
        part = ranges.span[others] >> model.shift
        own = model.at[np.minimum((number[others] - ranges.low[others]) // part, model.last).view(np.int64)]
        ranges.take_share(others, model.starts[own], model.sizes[own], part)
        now = c2 + (c1 - c2) * hit1
        now[others] = own
        ranges.shift(on, read)
        model.update(now, hit2, hit1)
        before[:on] = last[:on]
        last[:on] = now
        grid[step, :on] = now
    return grid.T.ravel()[:n]


def write_block(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of whole documents: ids of the documents, their sizes, and all their token ids."""
    alphabet = int(ids.max()) + 1 if len(ids) else 1
    if alphabet >= 1 << (_SCALE - 1):
        raise ValueError(f"ids must be under {1 << (_SCALE - 1)}")
    lanes, steps = _shape(len(ids))
    lane_sizes, data = encode_ids(ids, alphabet) if len(ids) else ([0], b"")
    body = b"".join(
        [zlib.compress(np.asarray(docs, "<i8").tobytes() + np.asarray(sizes, "<u4").tobytes(), 1),
         np.asarray(lane_sizes, "<u4").tobytes(), data]
    )
    index = len(body) - len(data) - 4 * len(lane_sizes)
    crc = zlib.crc32(np.asarray(ids, "<u4").tobytes())
    body = struct.pack("<I", index) + body
    head = HEADER.pack(MAGIC, len(docs), len(ids), alphabet, lanes, steps, crc, 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, sizes, ids); ValueError if the block is damaged."""
    if len(block) < HEADER.size + 4:
        raise ValueError("the block is too short")
    magic, n_docs, n, alphabet, lanes, steps, crc, rest = HEADER.unpack_from(block)
    body = block[HEADER.size :]
    if magic != MAGIC or zlib.crc32(body, zlib.crc32(block[: HEADER.size - 4])) != rest:
        raise ValueError("the block is damaged")
    (index,) = struct.unpack_from("<I", body)
    table = zlib.decompress(body[4 : 4 + index])
    docs = np.frombuffer(table, "<i8", n_docs)
    sizes = np.frombuffer(table, "<u4", n_docs, 8 * n_docs)
    lane_sizes = np.frombuffer(body, "<u4", lanes, 4 + index).astype(np.int64)
    data = body[4 + index + 4 * lanes :]
    ids = decode_ids(n, alphabet, lanes, steps, lane_sizes, data) if n else np.zeros(0, np.int64)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the ids of the block do not match their checksum")
    return docs, sizes, ids
