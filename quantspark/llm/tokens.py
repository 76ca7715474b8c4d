"""Exact ids of the ``tokenizers`` library at the cost of its distinct units.

A text is cut where a white-space run ends a word.  With ``spaces=False`` (tokenizers that drop white space) a unit is a
word; with ``spaces=True`` (byte-level ones) it is a word with the white space before it, and white space at the end
of a text is a unit of its own.  Both kinds of pre-tokenizer start a new match at each cut, so the ids of a text are the
ids of its units one after another.  The only exception are white-space characters beyond ASCII, which the pattern of a
byte-level tokenizer can join across a cut; texts with such a character are encoded whole.

Where a tokenizer's pattern is ``FINE`` and its normalizer lower-cases, words are cut further, between characters that no
match of the pattern spans, and capitals are lower-cased beforehand, so that fewer distinct units are left.  Only ASCII and letters
of two bytes that the normalizer composes with nothing before them take part.  A letter before any other character, which may be
a mark that the normalizer composes with it, stays as it is, and so do texts in which one of the tokenizer's own tokens stands.

Each distinct unit of a slice, found by its 64-bit hash, is encoded once by the library.  Units go to it in lots, joined by
the tokenizer's own special token: the library cuts a text there before anything else, so that each unit is encoded by
itself, and the special token's id marks where its ids end.  A lot that itself contains this token is encoded unit by unit.
Units of small letters alone are one match each and stay as they are when normalized, so the library's model gets them at once, by
its own interface for texts that are cut already; the suffix that it puts at the end of a word marks where their ids end.

Memory is bounded: a table keeps the ids of at most ``CACHE_UNITS`` units and ``CACHE_IDS`` ids, and a worker holds one
encoder.  When the table is full, new units are encoded for their slice only; when these have become
``STALE`` times as many as the table holds, the texts have changed and the table is filled anew.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa

from . import kernel

ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
CACHE_UNITS, CACHE_IDS, STALE = 500_000, 3_000_000, 4
TABLE_BITS = 20
LOT = 8192
FINE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _DIGIT, _SIGN, _APOSTROPHE = 1, 2, 3, 4  # 0: bytes beyond ASCII, white space and control characters


def _cuts() -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte, whether ``FINE`` always ends a match between two classes, at 5 * first + second)."""
    classes, cut = np.zeros(256, np.uint8), np.zeros((5, 5), bool)
    classes[0x21:0x7F] = _SIGN
    classes[0x30:0x3A], classes[0x41:0x5B], classes[0x61:0x7B], classes[0x27] = _DIGIT, _LETTER, _LETTER, _APOSTROPHE
    cut[_DIGIT, 1:] = cut[1:, _DIGIT] = True  # a digit is a match of its own
    # no match goes on behind a letter with a sign; only one that begins with an apostrophe goes on behind a sign with a letter
    cut[_LETTER, _SIGN] = cut[_LETTER, _APOSTROPHE] = cut[_SIGN, _LETTER] = True
    return classes, cut.ravel()


_CLASSES, _CUT = _cuts()


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For characters of at most two bytes: (letters that NFC leaves alone, those that are small too, the small one of each).

    A letter whose small form has another length in bytes counts as its own."""
    letter, small, lower = np.zeros(2048, bool), np.zeros(2048, bool), np.arange(2048)
    for i in range(2048):
        c = chr(i)
        # the small form of U+0130 ends with a mark, which a match of signs takes up
        letter[i] = unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1
        small[i] = letter[i] and c.lower() == c
        if letter[i] and len(c.lower().encode()) == len(c.encode()):
            lower[i] = ord(c.lower())
    return letter, small, lower


_LETTERS, _SMALL, _LOWER = _letters()


def _byte_chars() -> str:
    """The character that stands for each byte in the vocabularies of byte-level tokenizers; a space, which parts words, is itself."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    chars = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return "".join(chars[b] for b in range(256))


_BYTE_CHARS = _byte_chars()
_PARTED = "".join(" " if b == 0x20 else c for b, c in enumerate(_BYTE_CHARS))


def _pairs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, code points) of the characters of two bytes."""
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    return lead, (data.take(lead).astype(np.int64) & 31) << 6 | data.take(lead + 1) & 63


def _is_small(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a small letter."""
    out = _SMALL[:256][data] & (data < 128)
    lead, code = _pairs(data)
    lead = lead[_SMALL.take(code)]
    out[lead] = out[lead + 1] = True
    return out
_RAW_TABLE = kernel._TABLES[False].copy()  # noqa: SLF001
_RAW_TABLE[kernel.SPACE] = np.random.Generator(np.random.PCG64(8)).integers(1, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The runs values[starts[i] : starts[i] + counts[i]] for i in pick, one after another."""
    n = counts[pick]
    ends = np.cumsum(n)
    at = np.repeat(starts[pick] - (ends - n), n)
    at += np.arange(len(at))
    return values.take(at)


class Encoder:
    """Encodes Arrow text columns; one per Python worker and file."""

    _held: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, spaces: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaces = spaces
        marks = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark_id, self.mark = max(marks, default=(-1, ""))
        self.own = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fine = not spaces and self._is_fine()
        self.model, self.ends = self._word_model() if self.fine else (None, np.zeros(0, bool))
        self.starts, self.counts, self.odd = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, bool)
        self.ids = np.zeros(1 << 18, np.uint32)
        self._clear()

    @classmethod
    def of(cls, path: str, spaces: bool) -> Encoder:
        if (path, spaces) not in cls._held:
            cls._held.clear()
            cls._held[path, spaces] = cls(path, spaces)
        return cls._held[path, spaces]

    def _is_fine(self) -> bool:
        """Whether the tokenizer lower-cases, splits by ``FINE`` and has only tokens of its own that are found as they are."""
        state = lambda part: json.loads(part.__getstate__()) if part is not None else {}
        norm, pre = state(self.tokenizer.normalizer), state(self.tokenizer.pre_tokenizer)
        first = (pre.get("pretokenizers") or [{}])[0]
        split = [first.get(k) for k in ("type", "pattern", "behavior", "invert")] == ["Split", {"Regex": FINE}, "Removed", True]
        after = [(p["type"], p.get("use_regex"), p.get("add_prefix_space")) for p in (pre.get("pretokenizers") or [])[1:]]
        lower = [(n["type"], n.get("pattern"), n.get("content")) for n in norm.get("normalizers") or []]
        plain = all(t.content.isascii() and not t.normalized for t in self.tokenizer.get_added_tokens_decoder().values())
        return plain and split and after == [("ByteLevel", False, False)] and lower == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]

    def _word_model(self):
        """(the model alone, which ids end a word), where every word ends with such an id, or (None, nothing)."""
        from tokenizers import Tokenizer

        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.tokenizer.get_vocab()
        # the suffix has to hold a sign, so that no part of a word of letters looks like it
        if not suffix or not set(suffix) & set("<>/_#@") or any(c + suffix not in vocab for c in _BYTE_CHARS):
            return None, np.zeros(0, bool)
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        return Tokenizer(self.tokenizer.model), ends

    def _refine(self, words: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start, end, units before each row): words cut as finely as ``FINE`` allows, capitals lower-cased."""
        data = words.data
        low = data.tobytes().lower()
        if not len(words.start) or any(own in low for own in self.own):
            return data, words.start, words.end, words.ptr
        cut = np.zeros(len(data) + 1, bool)
        kinds = _CLASSES[data]
        lead, code = _pairs(data)
        letter = _LETTERS.take(code)
        lead, code = lead[letter], code[letter]
        kinds[lead] = kinds[lead + 1] = _LETTER
        cut[1:-1] = _CUT[kinds[:-1] * np.uint8(5) + kinds[1:]]
        cut[words.offsets] = False
        first, last = cut, cut.copy()
        first[words.start] = True
        last[words.end] = True
        start, end = np.flatnonzero(first), np.flatnonzero(last)
        alone = np.ones(len(data), bool)
        alone[:-1] = (data[1:] < 128) | (kinds[1:] == _LETTER)
        folded = np.where(alone, np.frombuffer(low, np.uint8), data)
        capital = (_LOWER.take(code) != code) & alone.take(lead + 1)
        lead, code = lead[capital], _LOWER.take(code[capital])
        folded[lead], folded[lead + 1] = 0xC0 | code >> 6, 0x80 | code & 63
        return folded, start, end, np.searchsorted(start, words.offsets)

    def _clear(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)  # open addressing; 0 is free
        self.index = np.zeros(1 << TABLE_BITS, np.int32)
        self.known = self.known_ids = self.passed = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each known unit, -1 for the others."""
        place = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        found = self.keys[place]
        out = np.where(found == hashes, self.index[place], -1)
        left = np.flatnonzero((found != hashes) & (found != 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << TABLE_BITS) - 1)
            found = self.keys[place[left]]
            same = found == hashes[left]
            out[left[same]] = self.index[place[left[same]]]
            left = left[~same & (found != 0)]
        return out

    def _insert(self, hashes: np.ndarray, first: int) -> None:
        """Number new, different hashes from ``first`` on."""
        place = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[place[left]] == 0
            self.keys[place[left[free]]] = hashes[left[free]]  # of several for one place the last stays
            mine = free & (self.keys[place[left]] == hashes[left])
            self.index[place[left[mine]]] = first + left[mine]
            left = left[~mine]
            place[left] = (place[left] + 1) & ((1 << TABLE_BITS) - 1)

    def _units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start, end, units before each row)."""
        words = kernel.words_of(column)
        if self.fine:
            return self._refine(words)
        if not self.spaces:
            return words.data, words.start, words.end, words.ptr
        low, high, counts = words.offsets[:-1], words.offsets[1:], words.counts
        start = np.empty_like(words.start)
        start[1:] = words.end[:-1]
        some = counts > 0
        start[words.ptr[:-1][some]] = low[some]
        tail_from = low.copy()
        tail_from[some] = words.end[words.ptr[1:][some] - 1]
        tail = np.flatnonzero(tail_from < high)
        at = words.ptr[1:][tail]
        ptr = words.ptr.copy()
        ptr[1:] += np.cumsum(tail_from < high)
        return words.data, np.insert(start, at, tail_from[tail]), np.insert(words.end, at, high[tail]), ptr

    def _lot(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per unit, whether a unit has odd white space) of the units data[start : start + size]."""
        mark = np.frombuffer(self.mark.encode(), np.uint8)
        ends = np.cumsum(size + len(mark))
        joined = np.empty(int(ends[-1]), np.uint8)
        inside = np.ones(len(joined), bool)
        inside[((ends - len(mark))[:, None] + np.arange(len(mark))).ravel()] = False
        joined[inside] = ragged(data, start, size, np.arange(len(start)))
        joined[~inside] = np.tile(mark, len(start))
        text = joined.tobytes().decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.mark_id)
        odd = np.zeros(len(start), bool)
        if len(cuts) != len(start) or (self.spaces and ODD_SPACE.search(text)):
            units = [data[a : a + n].tobytes().decode() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
            odd = np.fromiter((self.spaces and ODD_SPACE.search(u) is not None for u in units), bool, len(units))
            if len(cuts) != len(start):
                found = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
                return np.array([x for one in found for x in one], np.uint32), np.fromiter(map(len, found), np.int64, len(found)), odd
        return np.delete(ids, cuts), np.diff(cuts, prepend=-1) - 1, odd

    def _lot_of_words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``_lot`` gives, for units of small letters."""
        ends = np.cumsum(size + 1)
        joined = np.full(int(ends[-1]), 0x20, np.uint8)
        inside = np.ones(len(joined), bool)
        inside[ends - 1] = False
        joined[inside] = ragged(data, start, size, np.arange(len(start)))
        words = codecs.charmap_decode(joined[:-1].tobytes(), "strict", _PARTED)[0].split(" ")
        ids = np.array(self.model.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends.take(ids)), prepend=-1), np.zeros(len(start), bool)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[int, int]:
        """Put the ids of units behind the known ones; (units, ids) that are there now."""
        units, total, size = self.known + len(start), self.known_ids, end - start
        while units > len(self.starts):
            self.starts, self.counts, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts, self.odd))
        words = np.zeros(len(start), bool)
        if self.model is not None:
            others = np.concatenate([[0], np.cumsum(~_is_small(ragged(data, start, size, np.arange(len(start)))), dtype=np.int64)])
            ends = np.cumsum(size)
            words = others.take(ends) == others.take(ends - size)
        for which, lot in ((np.flatnonzero(words), self._lot_of_words), (np.flatnonzero(~words), self._lot)):
            for at in range(0, len(which), LOT):
                part = which[at : at + LOT]
                ids, counts, odd = lot(data, start.take(part), size.take(part))
                while total + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                here = self.known + part
                self.starts[here], self.counts[here], self.odd[here] = total + np.cumsum(counts) - counts, counts, odd
                self.ids[total : total + len(ids)] = ids
                total += len(ids)
        return units, total

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after another, ids per row); null counts as empty."""
        data, start, end, ptr = self._units(column)
        hashes = kernel.span_hashes(data, start, end, table=_RAW_TABLE if self.spaces else None)
        hashes[hashes == 0] = 1
        place = self._find(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            if self.passed > STALE * CACHE_UNITS:
                self._clear()
                missing = np.arange(len(hashes))
            new, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            first = missing[first]
            units, total = self._learn(data, start[first], end[first])
            place[missing] = self.known + which
            if units <= CACHE_UNITS and total <= CACHE_IDS:
                self._insert(new, self.known)
                self.known, self.known_ids = units, total
            else:
                self.passed += len(new)
        ids = ragged(self.ids, self.starts, self.counts, place)
        sums = np.concatenate([[0], np.cumsum(self.counts[place])])
        counts = np.diff(sums[ptr])
        if self.spaces and len(place) and self.odd[place].any():
            odd_sums = np.concatenate([[0], np.cumsum(self.odd[place])])
            rows = np.flatnonzero(np.diff(odd_sums[ptr]))
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for row in rows:
                parts[row] = np.array(self.tokenizer.encode(column[int(row)].as_py(), add_special_tokens=False).ids, np.uint32)
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            ids = np.concatenate(parts)
        return ids, counts
