"""An adaptive context-mixing range coder for token ids, many blocks at a time.

A block holds up to ``BLOCK`` ids and is coded on its own: model and coder start
afresh, so blocks decode independently.  Three predictions of the next id are
mixed:

* order 2 and order 1: the id that last followed the two ids, or the one id,
  before (all chance on one id);
* order 0: a distribution over all ids: the ids of the block so far by their
  frequency, and a fixed falling one for those it hasn't had.

The mixture gives an id x the chance w2 [x = a2] + w1 [x = a1] + w0 q0(x).  Its
weights depend on how often in a row orders 2 and 1 were right; after each id
every weight grows by the share that its order had in that id's chance, as in
online expectation maximisation.  Coding goes by the chain rule: first whether
the id is a2 or a1, with these ids' whole chances, order 0 included, or is in
the block already, or new; then, for the last two, which it is, by order 0.
q0(a2) and q0(a1) are read off a table of counts by the ids' low bits.

All blocks of a batch go in lock step, one numpy operation for all of them;
the arithmetic uses only integers and + - * / on doubles, which are the same on
every machine.  The range coder is carry-less with a 64-bit state and writes
16-bit words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
LANES = 2048
_TABLES = 512, 1024  # entries of the tables of order 1 and order 2
_COUNTS = 512
_SURE = 4  # confidence counts 0 (nothing said yet) to this
_CONTEXTS = (_SURE + 1) ** 2
_ONE = 1 << 16
_LOW, _U16, _U32, _U48 = np.uint64((1 << 32) - 1), np.uint64(16), np.uint64(1 << 32), np.uint64(48)
_NEW_BITS = 24


def _first_weights() -> np.ndarray:
    """Weights of order 2, 1 and 0 at the start, for each pair of confidences."""
    s2, s1 = (x.ravel() for x in np.meshgrid(np.arange(_SURE + 1), np.arange(_SURE + 1), indexing="ij"))
    return np.stack([0.4 * s2, 0.2 * s1, np.ones(_CONTEXTS)], 1)


def _new_ids() -> np.ndarray:
    """Cumulative chances of ids that the block hasn't had, falling with the id, of a total of 2**_NEW_BITS."""
    share = np.cumsum(1 / (np.arange(_ONE) + 512))
    return np.concatenate([[0], (share / share[-1] * ((1 << _NEW_BITS) - _ONE)).astype(np.int64) + np.arange(1, _ONE + 1)])


_WEIGHTS, _NEW = _first_weights(), _new_ids()


class _Model:
    """What both sides know before an id: everything a block has shown so far.  Flat arrays, one stretch for each lane."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.lane = lane
        self.table_at = [lane * size for size in _TABLES]
        self.tables = [np.zeros(lanes * size, np.uint32) for size in _TABLES]  # confidence and id
        self.context_at, self.weights = lane * _CONTEXTS, np.tile(_WEIGHTS, (lanes, 1))
        self.count_at, self.counts = lane * _COUNTS, np.zeros(lanes * _COUNTS, np.uint16)
        self.again = np.full((2, lanes), 1.0)  # of ids that no order foretold: those the block had before, the others
        self.last = [np.zeros(lanes, np.int64) for _ in range(2)]
        self.had, self.bits = None, 0
        self.t = 0

    def sort_past(self, ids: np.ndarray) -> bool:
        """At each power of two of ids, sort those so far: an id's places in the order are its chances."""
        t, n = self.t, ids.shape[1]
        if t < 16 or t & (t - 1):
            return False
        had = np.sort(ids[:t], axis=0).T.copy()
        place = np.arange(t, dtype=np.int32)
        fresh = np.ones((n, t), bool)
        fresh[:, 1:] = had[:, 1:] != had[:, :-1]
        first = np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
        last = np.ones((n, t), bool)
        last[:, :-1] = fresh[:, 1:]
        end = np.minimum.accumulate(np.where(last, place + 1, np.int32(t))[:, ::-1], axis=1)[:, ::-1]
        self.bits, self.size = t.bit_length() - 1, t
        self.had, self.first, self.many = had.reshape(-1), first.reshape(-1), (end - first).reshape(-1)
        return True

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where the sorted past has each of the coming ids first, or -1: (step, lane)."""
        key = (self.lane[:, None] << 16) + self.had.reshape(len(self.lane), -1)
        want = ((self.lane[:, None] << 16) + ids[self.t : 2 * self.t].T).reshape(-1)
        key = key.reshape(-1)
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        return np.where(key[at] == want, at, -1).reshape(len(self.lane), -1).T.copy()

    def foresee(self, m: int) -> None:
        """Sets what order 2 and order 1 foretell, and where the four events end in a total of 2**16."""
        x1, x2 = self.last[0][:m], self.last[1][:m]
        one = x1 * 40503
        self.i1, self.i2 = self.table_at[0][:m] + ((one >> 3) & (_TABLES[0] - 1)), self.table_at[1][:m] + (((one + x2 * 30011) >> 2) & (_TABLES[1] - 1))
        e1, e2 = self.tables[0].take(self.i1), self.tables[1].take(self.i2)
        self.s1, self.s2 = s1, s2 = (e1 >> 16).astype(np.int64), (e2 >> 16).astype(np.int64)
        self.id1, self.id2 = id1, id2 = (e1 & 0xFFFF).astype(np.int64), (e2 & 0xFFFF).astype(np.int64)
        self.have2 = s2 > 0
        self.have1 = (s1 > 0) & ~((id1 == id2) & self.have2)
        self.j = self.context_at[:m] + s2 * (_SURE + 1) + s1
        w = self.weights.take(self.j, axis=0)
        w2, w1, w0 = w[:, 0] * self.have2, w[:, 1] * self.have1, w[:, 2]
        share = w0 / (self.t + 1)
        self.w0 = w0
        at = self.count_at[:m]
        f2 = w2 + share * self.counts.take(at + (id2 & (_COUNTS - 1))) * self.have2
        f1 = w1 + share * self.counts.take(at + (id1 & (_COUNTS - 1))) * self.have1
        self.part2, self.part1 = w2 / (f2 + 1e-9), w1 / (f1 + 1e-9)
        scale = (_ONE - 16) / (f2 + f1 + w0)
        a = (f2 * scale).astype(np.int64) + 4 * self.have2
        b = a + (f1 * scale).astype(np.int64) + 4 * self.have1
        if self.had is None:
            self.ends = a, b, b
        else:
            again = self.again[:, :m]
            self.ends = a, b, b + 2 + ((_ONE - 4 - b) * (again[0] / (again[0] + again[1]))).astype(np.int64)

    def span(self, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where an event starts in the total, and its frequency."""
        a, b, c = self.ends
        start = np.choose(event, (0, a, b, c))
        return start, np.choose(event, (a, b, c, _ONE)) - start

    def learn(self, m: int, x: np.ndarray, event: np.ndarray) -> None:
        is2, is1 = event == 0, event == 1
        grown = np.empty((m, 3))
        grown[:, 0], grown[:, 1] = is2 * self.part2, is1 * self.part1
        grown[:, 2] = 1 - grown[:, 0] - grown[:, 1]
        self.weights[self.j] += grown
        if self.had is not None:
            again = self.again[:, :m]
            again *= 0.99
            again[0] += event == 2
            again[1] += event == 3
            again += 0.01
        for table, at, said, sure in ((self.tables[0], self.i1, self.id1, self.s1), (self.tables[1], self.i2, self.id2, self.s2)):
            table[at] = np.where((said == x) & (sure > 0), np.minimum(sure + 1, _SURE), 1) << 16 | x
        self.counts[self.count_at[:m] + (x & (_COUNTS - 1))] += 1
        self.last[1][:m] = self.last[0][:m]
        self.last[0][:m] = x
        self.t += 1


def _narrow(low: np.ndarray, width: np.ndarray, lanes, start: np.ndarray, freq: np.ndarray, bits, emit) -> None:
    """Code an interval of the total 2**bits in ``lanes`` (a slice or ids) and write words while a width is under 2**32."""
    r = width[lanes] >> bits
    low[lanes] += r * start.astype(np.uint64)
    r *= freq.astype(np.uint64)
    width[lanes] = r
    open_ = np.flatnonzero(r < _U32)
    if not isinstance(lanes, slice):
        open_ = lanes[open_]
    while len(open_):
        lo, wd = low[open_], width[open_]
        astride = ((lo ^ (lo + wd - np.uint64(1))) >> _U48) != 0
        wd = np.where(astride, (~lo + np.uint64(1)) & _LOW, wd) << _U16
        emit(open_, lo)
        low[open_], width[open_] = lo << _U16, wd
        open_ = open_[wd < _U32]


def _order(sizes: np.ndarray) -> np.ndarray:
    return np.argsort(-sizes, kind="stable")


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of uint16 ids coded on its own."""
    out: list[bytes] = []
    for at in range(0, len(blocks), LANES):
        out += _encode(blocks[at : at + LANES])
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    sizes = np.array([len(b) for b in blocks])
    order, n = _order(sizes), len(blocks)
    most = int(sizes.max(initial=0))
    ids = np.zeros((most, n), np.uint16)
    for row, k in enumerate(order):
        ids[: sizes[k], row] = blocks[k]
    left = sizes[order]
    model = _Model(n)
    low, width, pos = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64), np.zeros(n, np.int64)
    room = 4 * most + 16
    words, words_at = np.zeros(n * room, np.uint16), np.arange(n) * room

    def emit(lanes: np.ndarray, lo: np.ndarray) -> None:
        words[words_at[lanes] + pos[lanes]] = lo >> _U48
        pos[lanes] += 1

    for t in range(most):
        m = int(np.searchsorted(-left, -t, "left"))  # lanes with more than t ids
        x = ids[t, :m].astype(np.int64)
        if model.sort_past(ids):
            places, since = model.places(ids), t
        model.foresee(m)
        event = np.where(model.have2 & (model.id2 == x), 0, np.where(model.have1 & (model.id1 == x), 1, 3))
        rest = np.flatnonzero(event == 3)
        if model.had is not None:
            at = places[t - since].take(rest)
            found = at >= 0
            old, at, rest = rest[found], at[found], rest[~found]
            event[old] = 2
        _narrow(low, width, slice(0, m), *model.span(event), _U16, emit)
        if model.had is not None:
            _narrow(low, width, old, model.first[at], model.many[at], np.uint64(model.bits), emit)
        start = _NEW.take(x[rest])
        _narrow(low, width, rest, start, _NEW.take(x[rest] + 1) - start, np.uint64(_NEW_BITS), emit)
        model.learn(m, x, event)
    for _ in range(4):
        emit(np.arange(n), low)
        low <<= _U16
    result = [b""] * n
    for row, k in enumerate(order):
        result[k] = words[row * room : row * room + pos[row]].astype("<u2").tobytes()
    return result


def decode_blocks(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for at in range(0, len(coded), LANES):
        out += _decode(coded[at : at + LANES], np.array(sizes[at : at + LANES]))
    return out


def _decode(coded: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    order, n = _order(sizes), len(coded)
    most = int(sizes.max(initial=0))
    room = max((len(c) // 2 for c in coded), default=0) + 8
    words, words_at = np.zeros(n * room, np.uint16), np.arange(n) * room
    for row, k in enumerate(order):
        own = np.frombuffer(coded[k], "<u2")
        words[row * room : row * room + len(own)] = own
    left = sizes[order]
    model = _Model(n)
    low, width, pos, code = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64), np.full(n, 4, np.int64), np.zeros(n, np.uint64)
    for k in range(4):
        code = code << _U16 | words[words_at + k]
    ids = np.zeros((most, n), np.uint16)

    def emit(lanes: np.ndarray, lo: np.ndarray) -> None:
        code[lanes] = code[lanes] << _U16 | words[words_at[lanes] + pos[lanes]]
        pos[lanes] += 1

    def target(lanes, bits) -> np.ndarray:
        return np.minimum((code[lanes] - low[lanes]) // (width[lanes] >> bits), (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)

    for t in range(most):
        m = int(np.searchsorted(-left, -t, "left"))
        model.sort_past(ids)
        model.foresee(m)
        v = target(slice(0, m), _U16)
        event = sum((v >= end).astype(np.int64) for end in model.ends)
        _narrow(low, width, slice(0, m), *model.span(event), _U16, emit)
        x = np.where(event == 0, model.id2, model.id1)
        old, new = np.flatnonzero(event == 2), np.flatnonzero(event == 3)
        if len(old):
            bits = np.uint64(model.bits)
            at = old * model.size + target(old, bits)
            x[old] = model.had[at]
            _narrow(low, width, old, model.first[at], model.many[at], bits, emit)
        if len(new):
            x[new] = np.searchsorted(_NEW, target(new, np.uint64(_NEW_BITS)), "right") - 1
            start = _NEW.take(x[new])
            _narrow(low, width, new, start, _NEW.take(x[new] + 1) - start, np.uint64(_NEW_BITS), emit)
        ids[t, :m] = x
        model.learn(m, x, event)
    result = [np.empty(0, np.uint16)] * n
    for row, k in enumerate(order):
        result[k] = ids[: left[row], row].astype(np.uint16)
    return result
