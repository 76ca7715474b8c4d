r"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block of up to ``BLOCK_IDS`` consecutive ids is cut into lanes, runs of the block that numpy codes in lockstep: each lane
has a range coder of its own, but all lanes share one model, which learns from all of them.  Nothing is carried from block to
block.

Model:

* order 2: the id that last followed the two previous ids, with a confidence; it learns after every step;
* order 1: how often each id has followed the previous id;
* order 0: how often each id has come at all, every id of the alphabet at least a little.

The kind of an id (0: order 2 predicts it, 1: order 1 has seen it after the previous id, 2: neither) has four experts: one
knows nothing, one how often the previous id was seen, one the confidence of order 2, one both.  Their adaptive distributions
are mixed linearly, with weights that follow the probability each expert gave to what came.  Ids of kind 1 are coded by
the order-1 frequencies, blended with those of order 0, ids of kind 2 by order 0 alone.  Frequencies and mixture are brought up to date after
runs of steps that grow with what has been seen (1, 1, 1, 2, 3, 4, ... steps up to ``MOST_IDS`` ids).

The coder is a carry-less range coder with a 64-bit interval that emits 32-bit words whenever the interval is shorter than
2**32.  Only integer arithmetic and IEEE additions, multiplications and divisions in a fixed order enter the probabilities,
so decoders agree everywhere.

A frame is ``magic, version, kind, count, crc32 of the decoded bytes, payload``.  Index frames hold doc ids and token
counts, block frames hold ids.  A reader checks every frame's CRC and raises on a mismatch.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 1 << 20
LANES, LANE_IDS = 2048, 128
MOST_IDS = 1 << 17
MAGIC = b"QSTB"
INDEX, BLOCK = 0, 1
_HEAD = struct.Struct("<4sBBxxII")
_BLOCK = struct.Struct("<BHI")  # raw low bits, lanes, largest symbol
#: Symbols have at most this many bits; the lower bits of longer ids are coded as they are.
SYMBOL_BITS = 18
_U = np.uint64
_SLOT_BITS = 18
#: An id's kind and, for kind 1, its pair share one interval of 2**28 parts.
_KIND_BITS, _PAIR_BITS = 12, 16
_BITS = _KIND_BITS + _PAIR_BITS
_PARTS = _U(1 << _BITS)
_BUCKETS, _SURE = 12, 8
_GAIN = 32  # of an observation against an id's least share in order 0
_BLEND = 16  # of order 0 in a context's line, against 16 for each pair seen
_MOST_PAIRS = 1 << _PAIR_BITS - 1
_TIMES_BITS = 24  # of a pair in a block
_PLACE = _U((1 << _PAIR_BITS) - 1)
_NO_CELL = _U(1 << 63)  # a cell: symbol, first place on the context's line, places less one
_HASH1, _HASH2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_WORD = _U(32)
_LOW = _U(0xFFFFFFFF)
_FULL = _U(1 << 32)


class _Model:
    """What the coder and the decoder of a block have seen; all lanes share it."""

    def __init__(self, lanes: int, largest: int) -> None:
        self.size = largest + 1
        self.bits = max(1, int(largest).bit_length())
        # pairs and their places on the line of a context fit 32 bits for alphabets up to 2**16
        self.key = np.uint32 if self.bits <= 16 else np.uint64
        self.last = np.zeros(1 << _SLOT_BITS, np.int32)  # symbol * 8 + confidence, 0 if empty
        self.before = np.zeros((2, lanes), np.int32)  # the last two rows of symbols
        self.seen = np.zeros(self.size, np.int64)
        self.bucket = np.zeros(self.size, np.int32)  # by how often an id was a previous id
        self.pairs = np.zeros(0, np.uint64)  # (previous symbol << bits | symbol) << _TIMES_BITS | times, rising
        self.counts = [np.zeros(s + (3,)) for s in ((1, 1), (1, _BUCKETS), (_SURE, 1), (_SURE, _BUCKETS))]
        self.score = np.ones(4)
        self._mix()
        self._order0()
        self._order1()

    @staticmethod
    def slot(prev1: np.ndarray, prev2: np.ndarray) -> np.ndarray:
        """Of the last two symbols; only the low 25 bits of the sum count, so 32 bits are enough."""
        return (prev1.view(np.uint32) * _HASH1 + prev2.view(np.uint32) * _HASH2) >> np.uint32(7) & np.uint32((1 << _SLOT_BITS) - 1)

    def remember(self, slot: np.ndarray, entry: np.ndarray, fresh: np.ndarray, hit: np.ndarray) -> None:
        """``fresh``: entries of what came, at the least confidence; of equal slots the last lane counts."""
        self.last[slot] = np.where(hit, np.minimum(entry + 1, entry | 7), fresh)

    def _mix(self) -> None:
        w = self.score * self.score
        w = w / w.sum()
        self.given = [(n + 0.3) / (n.sum(axis=-1, keepdims=True) + 0.9) for n in self.counts]
        p = sum(x * p for x, p in zip(w, self.given, strict=True))
        f = (p * ((1 << _KIND_BITS) - 3)).astype(np.int64) + 1
        self.edge0 = f[..., 0].ravel().astype(_U) << _U(_PAIR_BITS)
        self.share1 = f[..., 1].ravel().astype(_U)
        self.edge1 = self.edge0 + (self.share1 << _U(_PAIR_BITS))

    def _order0(self) -> None:
        self.freq = (self.seen * _GAIN + 1).astype(_U)
        self.line = np.concatenate([np.zeros(1, _U), np.cumsum(self.freq)])
        self.total = int(self.line[-1])

    def _order1(self) -> None:
        """Places of the pairs on their contexts' lines, 2**16 long: frequencies blended with the order-0 ones.

        All quotients are of integers below 2**53, whose rounded quotients have the right whole part."""
        if not len(self.pairs):
            self.at, self.cells = np.zeros(1, self.key), np.zeros(1, _U)
            return
        pairs = self.pairs.view(np.int64)
        context = pairs >> _TIMES_BITS + self.bits
        start = np.concatenate([[True], context[1:] != context[:-1]])
        first = np.flatnonzero(start)
        many = np.diff(first, append=len(context))
        group = np.cumsum(start) - 1
        if int(many.max()) > _MOST_PAIRS:  # of a wide alphabet: the others of the context stay with order 0
            self.pairs = self.pairs[np.arange(len(context)) - first.take(group) < _MOST_PAIRS]
            self._order1()
            return
        symbol = pairs >> _TIMES_BITS & (1 << self.bits) - 1
        # a context's line is shared by what it has seen, and a little by how frequent its ids are at all
        common = self.seen.take(symbol).astype(float)
        weight = (common * (many * float(_BLEND)).take(group) / np.add.reduceat(common, first).take(group)).astype(np.int64)
        weight += (pairs & (1 << _TIMES_BITS) - 1) << 4
        ends = np.concatenate([[0], np.cumsum(weight)])
        base = ends.take(first)
        sums = np.diff(base, append=ends[-1])
        # every pair keeps one place at least
        low = (ends[:-1] - base.take(group)).astype(float)
        low *= ((1 << _PAIR_BITS) - many).astype(float).take(group)
        low /= sums.astype(float).take(group)
        low = low.astype(np.int64)
        low += np.arange(len(low)) - first.take(group)
        less = np.empty_like(low)  # a width less one
        less[:-1] = low[1:] - low[:-1] - 1
        less[first + many - 1] = (1 << _PAIR_BITS) - 1 - low.take(first + many - 1)
        self.cells = (symbol << 2 * _PAIR_BITS | low << _PAIR_BITS | less).view(_U)
        self.at = (context << _PAIR_BITS | low).astype(self.key)

    def pairs_of(self, symbols: np.ndarray, prev1: np.ndarray) -> np.ndarray:
        return (prev1.astype(_U) << _U(self.bits) | symbols.astype(_U)).ravel()

    def match(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(different pairs, how often each comes, its place among the known ones, whether it is there) of a run's sorted pairs."""
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        fresh, times = found.take(first).astype(_U) << _U(_TIMES_BITS), np.diff(first, append=len(found))
        place = np.searchsorted(self.pairs, fresh)
        known = np.zeros(len(fresh), bool)
        if len(self.pairs):
            known = self.pairs.take(np.minimum(place, len(self.pairs) - 1)) >> _U(_TIMES_BITS) == fresh >> _U(_TIMES_BITS)
        return fresh, times, place, known

    def learn(self, symbols: np.ndarray, marks: np.ndarray, matched: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Take in a run: rows are steps, columns lanes; ``marks``: 3 * context + kind of each id."""
        new = np.bincount(marks.ravel(), minlength=_SURE * _BUCKETS * 3).reshape(_SURE, _BUCKETS, 3).astype(float)
        news = (new.sum(axis=(0, 1), keepdims=True), new.sum(axis=0, keepdims=True), new.sum(axis=1, keepdims=True), new)
        gave = np.array([(n * p).sum() for n, p in zip(news, self.given, strict=True)])
        self.score = self.score * 0.5 + gave / symbols.size
        self.counts = [c * 0.9 + n for c, n in zip(self.counts, news, strict=True)]
        self._mix()
        self.seen += np.bincount(symbols.ravel(), minlength=self.size)
        self._order0()
        # all but the last row have been previous ids, and before the first row stood noughts
        follows = self.seen - np.bincount(symbols[-1], minlength=self.size)
        follows[0] += symbols.shape[1]
        self.bucket = np.minimum(np.frexp(follows.astype(float))[1], _BUCKETS - 1).astype(np.int32)
        fresh, times, place, known = matched
        self.pairs[place[known]] += times[known].astype(_U)
        more = np.flatnonzero(~known)
        at = place.take(more) + np.arange(len(more))
        old = np.ones(len(self.pairs) + len(more), bool)
        old[at] = False
        pairs = np.empty(len(old), _U)
        pairs[old] = self.pairs
        pairs[at] = fresh.take(more) + times.take(more).astype(_U)
        self.pairs = pairs
        self._order1()


class _Writer:
    def __init__(self, lanes: int) -> None:
        self.lanes = lanes
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        self.words = np.zeros(64 * lanes, np.uint32)  # rows of a word for each lane
        self.next = np.arange(lanes)  # each lane's next place there
        self.rows = 0  # no lane has more words

    def _emit(self, who: np.ndarray) -> None:
        self.rows += 1
        if self.rows * self.lanes > len(self.words):
            self.rows = int(self.next.max()) // self.lanes + 1
            if self.rows * self.lanes > len(self.words):
                self.words = np.concatenate([self.words, np.zeros_like(self.words)])
        low, at = self.low.take(who), self.next.take(who)
        self.words[at] = low >> _WORD
        self.next[who] = at + self.lanes
        self.range[who] = np.minimum(self.range.take(who), _FULL - (low & _LOW)) << _WORD
        self.low[who] = low << _WORD

    def code(self, start: np.ndarray, freq: np.ndarray, bits: int) -> None:
        unit = self.range >> _U(bits)
        self.low += unit * start
        self.range = unit * freq
        short = np.flatnonzero(self.range < _FULL)
        if len(short):
            self._emit(short)

    def code_some(self, who: np.ndarray, start: np.ndarray, freq: np.ndarray, total: int) -> None:
        unit = self.range.take(who) // _U(total)
        self.low[who] += unit * start
        size = unit * freq
        self.range[who] = size
        short = who[size < _FULL]
        if len(short):
            self._emit(short)

    def finish(self) -> bytes:
        """Words per lane, then the words, a lane after the other; one last word tells a lane's interval from all others."""
        everyone = np.arange(len(self.low))
        self.low += _LOW  # the interval is at least 2**32 long: the next whole word is inside
        self._emit(everyone)
        n = self.next // self.lanes
        rows = np.arange(int(n.max()))[None, :] < n[:, None]
        words = self.words.reshape(-1, self.lanes)[: rows.shape[1]]
        return n.astype("<u4").tobytes() + np.ascontiguousarray(words.T)[rows].astype("<u4").tobytes()


class _Reader:
    def __init__(self, lanes: int, data: bytes) -> None:
        n = np.frombuffer(data, "<u4", lanes).astype(np.int64)
        flat = np.frombuffer(data, "<u4", offset=4 * lanes)
        if int(n.sum()) != len(flat):
            raise ValueError("a block of a token file is cut off")
        self.lanes = lanes
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
        words = np.zeros((lanes, int(n.max()) + 2), np.uint32)  # nought follows the last word
        words[np.arange(words.shape[1])[None, :] < n[:, None]] = flat
        self.words = np.ascontiguousarray(words.T).ravel()
        two = self.words[: 2 * lanes].reshape(2, lanes).astype(_U)
        self.ahead = (two[0] << _WORD) | two[1]  # the value that was read, less the interval's lower end
        self.next = np.arange(2 * lanes, 3 * lanes)  # each lane's next word

    def _fill(self, who: np.ndarray, size: np.ndarray) -> None:
        low, at = self.low.take(who), self.next.take(who)
        self.range[who] = np.minimum(size, _FULL - (low & _LOW)) << _WORD
        self.low[who] = low << _WORD
        self.ahead[who] = (self.ahead.take(who) << _WORD) | self.words.take(at)
        self.next[who] = at + self.lanes

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        self.low += start
        self.ahead -= start
        self.range = size
        who = np.flatnonzero(size < _FULL)
        if len(who):
            self._fill(who, size.take(who))

    def take_some(self, who: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.low[who] += start
        self.ahead[who] -= start
        self.range[who] = size
        short = np.flatnonzero(size < _FULL)
        if len(short):
            self._fill(who.take(short), size.take(short))


def _shape(count: int) -> tuple[int, int]:
    """(lanes, steps) of a block."""
    lanes = max(1, min(LANES, count // LANE_IDS))
    return lanes, -(-count // lanes)


def _run(done: int, lanes: int, steps: int) -> int:
    """Steps until the model learns next."""
    return max(1, min(done // 2, MOST_IDS // lanes, steps - done))


def _raw_bits(shift: int) -> list[int]:
    return [16] * (shift // 16) + ([shift % 16] if shift % 16 else [])


def _encode(ids: np.ndarray) -> bytes:
    lanes, steps = _shape(len(ids))
    shift = max(0, int(ids.max()).bit_length() - SYMBOL_BITS)
    whole = np.zeros(lanes * steps, np.uint32)
    whole[: len(ids)] = ids
    whole = np.ascontiguousarray(whole.reshape(lanes, steps).T)
    symbols, largest = (whole >> np.uint32(shift)).view(np.int32), int(ids.max()) >> shift
    model, writer = _Model(lanes, largest), _Writer(lanes)
    done = 0
    while done < steps:
        run = _run(done, lanes, steps)
        now = symbols[done : done + run]
        before = np.concatenate([model.before, now])
        prev1, slots = before[1:-1], model.slot(before[1:-1], before[:-2]).astype(np.int64)
        entries, hit2, fresh = np.empty_like(now), np.empty(now.shape, bool), now << 3 | 1
        for t in range(run):
            entry = entries[t] = model.last.take(slots[t])
            hit = hit2[t] = (entry >> 3 == now[t]) & (entry > 0)
            model.remember(slots[t], entry, fresh[t], hit)
        # a run is short enough to sort the place with the pair, in one word
        packed = model.pairs_of(now, prev1) << _U(17) | np.arange(now.size, dtype=_U)
        packed.sort()
        matched = model.match(packed >> _U(17))
        _, times, place, known = matched
        cells = np.where(known, model.cells.take(np.minimum(place, len(model.cells) - 1)), _NO_CELL)
        cell = np.empty(now.shape, _U)
        cell.ravel()[(packed & _U((1 << 17) - 1)).view(np.int64)] = np.repeat(cells, times)
        context = ((entries & 7) * np.int32(_BUCKETS) + model.bucket.take(prev1)).astype(np.int64)
        kind = np.where(hit2, np.int32(0), 1 + (cell == _NO_CELL).astype(np.int32))
        rest = np.flatnonzero(kind == 2)
        new = now.ravel().take(rest)
        low0, freq0 = model.line.take(new), model.freq.take(new)
        row, who = rest // lanes, rest % lanes
        cuts = np.searchsorted(row, np.arange(run + 1)).tolist()
        for t in range(run):
            edge0, edge1, share1 = (x.take(context[t]) for x in (model.edge0, model.edge1, model.share1))
            one = kind[t] == 1
            start = np.where(one, edge0 + share1 * (cell[t] >> _U(_PAIR_BITS) & _PLACE), edge1)
            freq = np.where(one, share1 * ((cell[t] & _PLACE) + _U(1)), _PARTS - edge1)
            start[hit2[t]] = 0
            writer.code(start, np.where(hit2[t], edge0, freq), _BITS)
            part = slice(cuts[t], cuts[t + 1])
            if cuts[t] < cuts[t + 1]:
                writer.code_some(who[part], low0[part], freq0[part], model.total)
            at = shift
            for bits in _raw_bits(shift):
                at -= bits
                writer.code((whole[done + t].astype(_U) >> _U(at)) & _U((1 << bits) - 1), np.ones(lanes, _U), bits)
        model.before = before[-2:]
        done += run
        if done < steps:
            model.learn(now, context * 3 + kind, matched)
    return _BLOCK.pack(shift, lanes, largest) + writer.finish()


def _decode(payload: bytes, count: int) -> np.ndarray:
    shift, lanes, largest = _BLOCK.unpack_from(payload)
    steps = -(-count // lanes)
    model, reader = _Model(lanes, largest), _Reader(lanes, payload[_BLOCK.size :])
    rows, whole = np.zeros((steps + 2, lanes), np.int32), np.zeros((steps, lanes), np.uint32)
    symbols = rows[2:]  # before them stand noughts
    marks = np.empty((steps, lanes), np.int32)
    most, done, lane_bits = _PARTS - _U(1), 0, lanes.bit_length()
    prev1 = np.zeros(lanes, np.int64)
    while done < steps:
        run = _run(done, lanes, steps)
        for t in range(done, done + run):
            slot = model.slot(rows[t + 1], rows[t]).astype(np.int64)
            entry = model.last.take(slot)
            context = ((entry & 7) * np.int32(_BUCKETS) + model.bucket.take(prev1)).astype(np.int64)
            edge0, edge1 = model.edge0.take(context), model.edge1.take(context)
            unit = reader.range >> _U(_BITS)
            part = np.minimum(reader.ahead // unit, most)
            past0, past1 = part >= edge0, part >= edge1
            start, size = np.where(past1, edge1, _U(0)), np.where(past1, _PARTS - edge1, edge0)
            now = entry >> 3
            who = np.flatnonzero(past0 != past1)
            if len(who):
                # below 2**28 over below 2**12: the rounded quotient has the right whole part
                target = (part.take(who) - edge0.take(who)).astype(float) / model.share1.take(context.take(who)).astype(float)
                # sorted targets are found several times as fast, as neighbours share a cache line
                packed = (prev1.take(who) << _PAIR_BITS | target.astype(np.int64)) << lane_bits | who
                packed.sort()
                who = packed & (1 << lane_bits) - 1
                cell = model.cells.take(np.searchsorted(model.at, (packed >> lane_bits).astype(model.key), "right") - 1)
                share1 = model.share1.take(context.take(who))
                start[who] = edge0.take(who) + share1 * (cell >> _U(_PAIR_BITS) & _PLACE)
                size[who] = share1 * ((cell & _PLACE) + _U(1))
                now[who] = cell >> _U(2 * _PAIR_BITS)
            reader.take(unit * start, unit * size)
            who = np.flatnonzero(past1)
            if len(who):
                unit = reader.range.take(who) // _U(model.total)
                target = np.minimum(reader.ahead.take(who) // unit, _U(model.total - 1))
                new = np.searchsorted(model.line, target, "right") - 1
                reader.take_some(who, unit * model.line.take(new), unit * model.freq.take(new))
                now[who] = new
            model.remember(slot, entry, now << 3 | 1, ~past0)
            symbols[t], marks[t] = now, context * 3 + past0 + past1
            prev1 = now.astype(np.int64)
            if shift:
                high = now.view(np.uint32)
                for bits in _raw_bits(shift):
                    unit = reader.range >> _U(bits)
                    low = np.minimum(reader.ahead // unit, _U((1 << bits) - 1))
                    reader.take(unit * low, unit)
                    high = high << np.uint32(bits) | low.astype(np.uint32)
                whole[t] = high
        part = slice(done, done + run)
        done += run
        if done < steps:
            found = model.pairs_of(symbols[part], rows[part.start + 1 : part.stop + 1]).astype(model.key)
            found.sort()
            model.learn(symbols[part], marks[part], model.match(found))
    return (whole if shift else symbols.view(np.uint32)).T.reshape(-1)[:count].astype("<u4")


def frame(kind: int, count: int, crc: int, payload: bytes) -> bytes:
    return _HEAD.pack(MAGIC, 2, kind, count, crc) + payload


def unframe(data: bytes) -> tuple[int, int, int, bytes]:
    """(kind, count, crc, payload)."""
    if len(data) < _HEAD.size:
        raise ValueError("not a frame of a token file")
    magic, version, kind, count, crc = _HEAD.unpack_from(data)
    if magic != MAGIC or version != 2:
        raise ValueError("not a frame of a token file")
    return kind, count, crc, data[_HEAD.size :]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Frames of consecutive blocks of at most ``BLOCK_IDS`` ids, all about equally long."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    parts = np.array_split(ids, -(-len(ids) // BLOCK_IDS)) if len(ids) else []
    return [frame(BLOCK, len(part), zlib.crc32(part.tobytes()), _encode(part)) for part in parts]


def decode_blocks(frames: list[bytes]) -> np.ndarray:
    """Ids of block frames, in order; raises where a checksum does not match."""
    out = [np.empty(0, "<u4")]
    for data in frames:
        _, count, crc, payload = unframe(data)
        try:
            got = _decode(payload, count)
        except (IndexError, struct.error) as e:  # ids that no encoder wrote
            raise ValueError("a block of a token file does not match its checksum") from e
        if zlib.crc32(got.tobytes()) != crc:
            raise ValueError("a block of a token file does not match its checksum")
        out.append(got)
    return np.concatenate(out)


def encode_index(doc_ids: np.ndarray, missing: np.ndarray, counts: np.ndarray) -> bytes:
    raw = doc_ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes() + missing.astype("u1").tobytes()
    return frame(INDEX, len(doc_ids), zlib.crc32(raw), zlib.compress(raw, 1))


def decode_index(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, n, crc, payload = unframe(data)
    raw = zlib.decompress(payload)
    if kind != INDEX or zlib.crc32(raw) != crc:
        raise ValueError("an index of a token file does not match its checksum")
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 16 * n).astype(bool), np.frombuffer(raw, "<i8", n, 8 * n)
