"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks. Before them stands a start: how often each id is found in all
of them, and what mostly follows it. A block begins with a fresh coder and a model
reset to the start, and has a checksum; so with the start each can be decoded alone. Many
blocks are coded in lockstep: every variable of model and coder is an array with an
element a block (a lane), and the arithmetic is of integers only, so any machine decodes
what another has encoded.

The model mixes orders 0 to 2. Order 2 predicts the id that last followed the last two
in the block, and is believed by its confidence, which grows when it is right. Order 1
predicts what mostly follows the last id, by the start, and is believed by how often it
does. Both beliefs are multiplied by weights that the block learns from the errors; what
order 2 leaves goes to order 1, and what this leaves to order 0, which shares it among all ids
by the start's counts. The coder narrows its range to the part of the mixed
distribution that belongs to the id; a carry goes into digits already written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids in a block, and about how many blocks go in lockstep.
BLOCK, LANES = 1024, 4096
#: Order 0 shares 2**COUNT_BITS among the ids.
ID_BITS, COUNT_BITS = 16, 18
ORDER2 = 256
ONE = 1 << 12
U = np.uint64
LOW, FIRST_RANGE = U(1 << 32), U((1 << 64) - 1)
SHIFT, DIGIT = U(12 + COUNT_BITS), U(32)
HEAD, START = struct.Struct("<III"), struct.Struct("<II")
#: Probability of being right, in parts of ONE, of an entry by its confidence 0 (empty) to 7.
BELIEF = np.array([0, 1000, 2000, 2600, 2900, 3050, 3050, 3050], np.int32)
#: Weights are in parts of ONE, too, and follow errors by 1 / 2**RATE.
LEAST_WEIGHT, MOST_WEIGHT, RATE = 64, 5200, 5
MOST, UNIT = 7 << ID_BITS, 1 << ID_BITS
#: What follows an id less often isn't said in the start, and none is believed more.
LEAST_TIMES, MOST_LEVEL = 3, 3000


class Start:
    """What a part's blocks begin with: order 0's shares of the ids, and what mostly follows an id.

    ``low`` and ``size`` are an id's part of order 0's 2**COUNT_BITS, ``owner`` the id of each of these places, and
    ``next`` the id that mostly follows an id, and how often it does, in parts of ONE, above the id's 16 bits.
    """

    def __init__(self, found: np.ndarray, shares: np.ndarray, led: np.ndarray, follow: np.ndarray, level: np.ndarray):
        self.fields = found, shares, led, follow, level
        self.size = np.zeros(1 << ID_BITS, np.int32)
        self.size[found] = shares
        self.low = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.owner = np.repeat(found, shares).astype(np.int32)
        self.next = np.zeros(1 << ID_BITS, np.int32)
        self.next[led] = follow.astype(np.int32) + (level.astype(np.int32) << ID_BITS)

    @classmethod
    def of(cls, ids: np.ndarray) -> Start:
        all_of = np.zeros(1 << ID_BITS, np.int64)
        for k in range(0, len(ids), 1 << 20):
            all_of += np.bincount(ids[k : k + (1 << 20)], minlength=1 << ID_BITS)
        found = np.flatnonzero(all_of).astype(np.uint16)
        counts = all_of[found]
        total = 1 << COUNT_BITS
        shares = 1 + (counts * (total - len(found))) // max(len(ids), 1)
        if len(found):
            shares[counts.argmax()] += total - shares.sum()
        pairs = ids[:-1].astype(np.uint32)
        pairs <<= np.uint32(ID_BITS)
        pairs |= ids[1:]
        pairs.sort()
        heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(heads, append=len(pairs))
        pairs = pairs[heads]
        led, follow = (pairs >> np.uint32(ID_BITS)).astype(np.int64), (pairs & np.uint32(0xFFFF)).astype(np.int64)
        order = np.lexsort((follow, -times, led))
        led, follow, times = led[order], follow[order], times[order]
        first = np.ones(len(led), bool)
        first[1:] = led[1:] != led[:-1]
        led, follow, times = led[first], follow[first], times[first]
        level = np.minimum(times * ONE // np.maximum(all_of[led], 1), MOST_LEVEL)
        some = (times >= LEAST_TIMES) & (level > 0)
        return cls(found, shares, led[some], follow[some], level[some])

    def pack(self) -> bytes:
        found, shares, led, follow, level = self.fields
        columns = (np.diff(found, prepend=0), shares), (np.diff(led, prepend=0), follow, level)
        data = zlib.compress(b"".join(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns for x in c))
        return START.pack(len(found), len(led)) + struct.pack("<II", len(data), zlib.crc32(data)) + data

    @classmethod
    def unpack(cls, data: bytes) -> tuple[Start, int]:
        """The start, and how many bytes it took."""
        n, m = START.unpack_from(data)
        size, crc = struct.unpack_from("<II", data, START.size)
        body = data[START.size + 8 : START.size + 8 + size]
        if len(body) != size or zlib.crc32(body) != crc:
            raise Damaged("the start has another checksum")
        raw, at, columns = zlib.decompress(body), 0, []
        for k in (n, n, m, m, m):
            planes = np.frombuffer(raw, np.uint8, 4 * k, at).reshape(4, k)
            columns.append(np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64))
            at += 4 * k
        columns[0], columns[2] = np.cumsum(columns[0]), np.cumsum(columns[2])
        return cls(*columns), START.size + 8 + size


class Model:
    """Predictions of ``lanes`` blocks at the same place. An entry of order 2 is id + (confidence << 16)."""

    def __init__(self, lanes: int, start: Start):
        self.n, self.next = lanes, start.next
        self.base2 = np.arange(lanes) * ORDER2
        self.t2 = np.zeros(lanes * ORDER2, np.int32)
        self.weight = [np.full(lanes, ONE, np.int32) for _ in range(2)]
        self.last = np.zeros(lanes, np.int32)
        self.h1 = np.zeros(lanes, np.int32)
        self.h2 = np.zeros(lanes, np.int32)

    def narrow(self, n: int) -> None:
        """Goes on with the first n lanes."""
        if n != self.n:
            self.n = n
            self.base2, self.last, self.h1, self.h2 = (x[:n] for x in (self.base2, self.last, self.h1, self.h2))
            self.weight = [w[:n] for w in self.weight]

    def predict(self):
        """Ids of orders 2 and 1, and the parts of ONE that each has."""
        self.at = self.base2 + (((self.h1 ^ (self.h2 >> 3)) >> 6) & (ORDER2 - 1))
        self.held = self.t2.take(self.at)
        led = self.next.take(self.last)
        self.id2, self.id1 = self.held & 0xFFFF, led & 0xFFFF
        self.a = BELIEF.take(self.held >> ID_BITS) * self.weight[0] >> 12
        self.b = (ONE - self.a) * ((led >> ID_BITS) * self.weight[1] >> 12) >> 12
        return self.id2, self.id1, self.a, self.b

    def update(self, x: np.ndarray) -> None:
        hit2, hit1 = self.id2 == x, self.id1 == x
        for k, (hit, part) in enumerate(((hit2, self.a), (hit1, self.b))):
            w = self.weight[k]
            w += (hit * np.int32(ONE) - part) >> RATE
            np.maximum(w, LEAST_WEIGHT, out=w)
            np.minimum(w, MOST_WEIGHT, out=w)
        p = self.held
        right = p + (p < MOST) * np.int32(UNIT)
        wrong = np.where(p >= 3 * UNIT, p - np.int32(UNIT), x + np.int32(UNIT))
        self.t2[self.at] = np.where(hit2, right, wrong)
        self.h2, self.h1, self.last = self.h1, x * np.int32(40503), x


def _lengths(n: int, block: int) -> np.ndarray:
    return np.minimum(block, n - np.arange(0, n, block))


def _together(blocks: int) -> list[tuple[int, int]]:
    """First and behind the last block of runs of about LANES blocks, none of which is short while others are long."""
    cuts = np.linspace(0, blocks, max(1, round(blocks / LANES)) + 1).astype(int).tolist()
    return list(zip(cuts, cuts[1:])) if blocks else []


def encode(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """A start, and blocks of at most ``block`` ids each, with their heads. ids: uint16."""
    start = Start.of(ids)
    out = [start.pack()]
    for first, behind in _together(-(-len(ids) // block)):
        out += _encode(ids[first * block : behind * block], block, start)
    return out


def _encode(ids: np.ndarray, block: int, start: Start) -> list[bytes]:
    lengths = _lengths(len(ids), block)
    lanes = len(lengths)
    steps = int(lengths[0])
    rows = np.zeros(lanes * steps, np.uint16)
    rows[: len(ids)] = ids
    rows = rows.reshape(lanes, steps)
    table = np.empty((steps, lanes), np.uint16)
    for k in range(0, lanes, 256):
        table[:, k : k + 256] = rows[k : k + 256].T
    model = Model(lanes, start)
    low, span = np.zeros(lanes, U), np.full(lanes, FIRST_RANGE)
    #: A lane's digits begin at ``origin`` and go to ``place``.
    digits = np.zeros(lanes * (steps + 3), np.uint32)
    origin = np.arange(lanes) * (steps + 3)
    place = origin.copy()

    done = []
    for t in range(steps):
        n = lanes if t < lengths[-1] else lanes - 1
        if n < len(low):
            done.append((low[n:].copy(), n))
            model.narrow(n)
            low, span = low[:n], span[:n]
        x = table[t, :n].astype(np.int32)
        wide = x.astype(np.intp)
        i2, i1, a, b = model.predict()
        ab = a + b
        rest = ONE - ab
        begin, size = (ab << COUNT_BITS) + start.low.take(wide) * rest, start.size.take(wide) * rest
        at = np.flatnonzero((i1 == x) & (b > 0))
        begin[at], size[at] = a[at] << COUNT_BITS, b[at] << COUNT_BITS
        at = np.flatnonzero((i2 == x) & (a >= b) & (a > 0))
        begin[at], size[at] = 0, a[at] << COUNT_BITS
        unit = span >> SHIFT
        new = low + unit * begin.astype(U)
        _carry(digits, place, np.flatnonzero(new < low))
        low, span = new, unit * size.astype(U)
        at = np.flatnonzero(span < LOW)
        left = low[at]
        digits[place[at]] = left >> DIGIT
        place[at] += 1
        low[at] = left << DIGIT
        span[at] <<= DIGIT
        model.update(x)
    done.append((low, 0))
    for rest_low, first in done:
        at = np.arange(first, first + len(rest_low))
        for _ in range(2):
            digits[place[at]] = rest_low >> DIGIT
            place[at] += 1
            rest_low = rest_low << DIGIT
    out, raw = [], np.ascontiguousarray(ids, "<u2")
    for k in range(lanes):
        code = digits[origin[k] : place[k]].astype("<u4").tobytes()
        n = int(lengths[k])
        out.append(HEAD.pack(n, len(code), zlib.crc32(raw[k * block : k * block + n])) + code)
    return out


def _carry(digits: np.ndarray, place: np.ndarray, at: np.ndarray) -> None:
    """Adds one to the last digit written of the lanes ``at``, and goes on to those before where it overflows."""
    back = 1
    while len(at):
        digits[place[at] - back] += 1
        at = at[digits[place[at] - back] == 0]
        back += 1


class Damaged(ValueError):
    """A block whose checksum doesn't hold."""


def decode(data: bytes) -> np.ndarray:
    """The ids of the blocks that ``data`` holds one after the other."""
    if not data:
        return np.zeros(0, np.uint16)
    start, at = Start.unpack(data)
    heads, parts = [], []
    while at < len(data):
        n, size, crc = HEAD.unpack_from(data, at)
        heads.append((n, at + HEAD.size, size, crc))
        at += HEAD.size + size
    for first, behind in _together(len(heads)):
        parts += _decode(data, heads[first:behind], start)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _decode(data: bytes, heads: list, start: Start) -> list[np.ndarray]:
    order = sorted(range(len(heads)), key=lambda k: -heads[k][0])
    lengths = np.array([heads[k][0] for k in order])
    lanes, steps = len(heads), int(lengths[0])
    codes = [np.frombuffer(data, "<u4", heads[k][2] // 4, heads[k][1]) for k in order]
    place = np.concatenate([[0], np.cumsum([len(c) for c in codes])])[:-1].astype(np.int64)
    flat = np.concatenate([*codes, np.zeros(4, np.uint32)]).astype(U)
    code = np.zeros(lanes, U)
    for _ in range(2):
        code = (code << DIGIT) | flat[place]
        place += 1
    model = Model(lanes, start)
    span = np.full(lanes, FIRST_RANGE)
    table = np.zeros((steps, lanes), np.uint16)

    n = lanes
    for t in range(steps):
        if lengths[n - 1] <= t:
            n = int(np.searchsorted(-lengths, -t, side="left"))
            model.narrow(n)
            span, code, place = span[:n], code[:n], place[:n]
        i2, i1, a, b = model.predict()
        ab = a + b
        rest = ONE - ab
        unit = span >> SHIFT
        v = np.minimum(code // unit, U((1 << 12 + COUNT_BITS) - 1)).astype(np.int32)
        begin = ab << COUNT_BITS
        x = start.owner.take(np.maximum(v - begin, 0) // rest)
        begin += start.low.take(x) * rest
        size = start.size.take(x) * rest
        slot = v >> COUNT_BITS
        at = np.flatnonzero(slot < ab)
        if len(at):
            in_a = slot[at] < a[at]
            x[at] = np.where(in_a, i2[at], i1[at])
            begin[at] = np.where(in_a, 0, a[at] << COUNT_BITS)
            size[at] = np.where(in_a, a[at], b[at]) << COUNT_BITS
        code -= unit * begin.astype(U)
        span = unit * size.astype(U)
        at = np.flatnonzero(span < LOW)
        code[at] = (code[at] << DIGIT) | flat[place[at]]
        place[at] += 1
        span[at] <<= DIGIT
        table[t, :n] = x
        model.update(x)
    table = np.ascontiguousarray(table.T)
    out: list = [None] * lanes
    for lane, k in enumerate(order):
        ids = table[lane, : lengths[lane]]
        if zlib.crc32(np.ascontiguousarray(ids, "<u2")) != heads[k][3]:
            raise Damaged(f"block {k} has another checksum")
        out[k] = ids
    return out
