"""Exact token ids of byte-pair encoders, one distinct pre-token at a time.

A byte-pair encoder merges inside a pre-token only.  So a text's ids are those of its
pre-tokens, and a pre-token that has been encoded once need not be merged again.  The split
into pre-tokens is done here with array code for texts made of characters on which every
Unicode version agrees.  Where words are counted alone, a word with any other character goes
to the library by itself; where blanks belong to pre-tokens, a text with one goes as a whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from spotcheck.llm.textbytes import prefix_hash, slice_hash, spread, words

LETTER, DIGIT, OTHER, SPACE, BAD, CONT = range(6)
_BYTE = np.full(256, BAD, np.uint8)
_BYTE[0x21:0x7F] = OTHER
_BYTE[0x30:0x3A] = DIGIT
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B] = LETTER
_BYTE[[9, 10, 13, 32]] = SPACE
_BYTE[0x80:0xC0] = CONT
_BYTE[[0xC2, 0xC3, 0xC4, 0xC5]] = LETTER  # looked up with their next byte


def _two_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the characters U+0080 to U+017F, by lead and next byte."""
    kind, lower = np.full((256, 256), BAD, np.uint8), np.zeros((256, 256), np.uint8)
    for point in range(0xA1, 0x180):
        char = chr(point)
        lead, rest = char.encode()
        family = unicodedata.category(char)[0]
        low = char.lower().encode()
        if family == "N" or len(low) != 2 or low[0] != lead:
            continue
        kind[lead, rest], lower[lead, rest] = LETTER if family == "L" else OTHER, low[1]
    return kind, lower


_TWO, _TWO_LOWER = _two_bytes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_Q = ord("'")


def classes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes (in lower case if asked), the class of each, and which of them need the library."""
    kind = _BYTE[data]
    bad = kind == BAD
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        data = data.copy()
        nxt = np.minimum(lead + 1, len(data) - 1)
        pair = _TWO[data[lead], data[nxt]]
        bad[lead] = pair == BAD
        kind[lead] = kind[nxt] = pair
        if lower:
            data[nxt[pair != BAD]] = _TWO_LOWER[data[lead], data[nxt]][pair != BAD]
    if lower:
        data = _LOWER[data]
    # a special token's string may stand in the text
    bad[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    return data, kind, bad


def texts_of(bad: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have such a byte."""
    hard = np.zeros(len(offsets) - 1, bool)
    hard[np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1] = True
    return hard


def _contractions(data: np.ndarray, kind: np.ndarray, start: np.ndarray, fresh: np.ndarray) -> None:
    """Make 's 't 're 've 'm 'll 'd pieces of their own where an apostrophe begins a piece."""
    n = len(data)
    at = np.flatnonzero((data[: n - 1] == _Q) & start[: n - 1])
    at = at[(kind[at + 1] == LETTER) & ~fresh[at + 1]]
    one = data[at + 1]
    two_ok = at + 2 < n
    two = np.where(two_ok & ~fresh[np.minimum(at + 2, n - 1)], data[np.minimum(at + 2, n - 1)], 0)
    short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for hit, size in ((short, 2), (long & ~short, 3)):
        a = at[hit]
        start[a + 1] = False
        if size == 3:
            start[a + 2] = False
        start[a[a + size < n] + size] = True


def split(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of safe texts.

    ``spaces``: white space belongs to pre-tokens, one blank leads the next (byte-level
    encoders); else it is dropped and digits stand alone (word encoders).
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    start = fresh[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    if spaces:
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh[1:-1])
        start[last] = True
        start[last[data[last] == 0x20] + 1] = False
    else:
        start |= kind == DIGIT
    _contractions(data, kind, start, fresh[:-1])
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    if not spaces:
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


class HashTable:
    """Open addressing from 64-bit hashes to positions in a list of values."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at = np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each hash, -1 if it is not there."""
        slot = (h >> self.shift).astype(np.int64)
        out = self.at[slot]
        wrong = np.flatnonzero((self.keys[slot] != h) & (out >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            s = slot[wrong]
            out[wrong] = self.at[s]
            wrong = wrong[(self.keys[s] != h[wrong]) & (self.at[s] >= 0)]
        return out

    def add(self, h: np.ndarray, positions: np.ndarray) -> None:
        """Distinct hashes that are not there yet."""
        slot, left = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.at[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.at[slot[won]] = h[won], positions[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask


class Encoder:
    """Ids or counts of whole texts, exactly as the tokenizers library gives them.

    path: a tokenizer file of that library.  spaces: see ``split``.  whole: strings that are
    known to be one token each, with their ids (see ``whole_tokens``).  room: distinct
    pre-tokens that are remembered at once; beyond it the memory starts anew.
    """

    def __init__(self, path: str, spaces: bool, whole: dict[str, int] | None = None, room: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaces, self.room = spaces, room
        self.whole = whole or {}
        self._reset()

    def _reset(self) -> None:
        self.table = HashTable(max(self.room, 2 * len(self.whole)).bit_length())
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        if self.whole:
            strings = [s.encode() for s in self.whole]
            ends = np.cumsum([len(s) for s in strings])
            starts = np.append(0, ends[:-1])
            prefix = prefix_hash(np.frombuffer(b"".join(strings), np.uint8))
            self._learn(slice_hash(prefix, starts, ends), np.array(list(self.whole.values()), np.uint32), np.ones(len(strings), np.int64))

    def _learn(self, h: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        self.table.add(h, np.arange(len(self.size), len(self.size) + len(h), dtype=np.int32))
        self.first = np.append(self.first, (len(self.flat) + np.cumsum(size) - size).astype(np.int32))
        self.flat, self.size = np.append(self.flat, flat), np.append(self.size, size.astype(np.int32))

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd_words(self, data: np.ndarray, offsets: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text in words that hold a bad byte, each distinct word merged once; and the bytes with blanks for them."""
        starts, ends, of = words(data, offsets, _BYTE == SPACE)
        before = np.append(0, np.cumsum(bad))
        some = before[ends] > before[starts]
        starts, ends, of = starts[some], ends[some], of[some]
        raw = data.tobytes()
        each = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        distinct = sorted(set(each))
        sizes = {w: len(ids) for w, ids in zip(distinct, self.library_ids([w.decode("utf-8", "replace") for w in distinct]), strict=True)}
        data = data.copy()
        data[np.repeat(starts, ends - starts) + spread(ends - starts)] = 0x20
        return np.bincount(of, [sizes[w] for w in each], len(offsets) - 1).astype(np.int64), data

    def encode(self, data: np.ndarray, offsets: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """For texts in one buffer: tokens in each, and the ids of all in turn if wanted."""
        n = len(offsets) - 1
        low, kind, bad = classes(data, offsets, lower=not self.spaces)
        odd, whole_words = None, None
        if bad.any() and not self.spaces and want_ids:
            # such words are pre-tokens of their own here, at their places; what stays is split as usual
            at, to, _ = words(data, offsets, _BYTE == SPACE)
            before = np.append(0, np.cumsum(bad))
            some = before[to] > before[at]
            whole_words = at[some], to[some]
            blank = data.copy()
            blank[np.repeat(whole_words[0], whole_words[1] - whole_words[0]) + spread(whole_words[1] - whole_words[0])] = 0x20
            low, kind, bad = classes(blank, offsets, lower=True)
        elif bad.any() and not self.spaces and not want_ids:
            # no pre-token of a word encoder spans white space: words with such a byte go to the library by themselves
            odd, data = self._odd_words(data, offsets, bad)
            low, kind, bad = classes(data, offsets, lower=True)
        hard = texts_of(bad, offsets)
        starts, ends = split(low, kind, offsets, self.spaces)
        if whole_words is not None:
            low = np.where(blank == data, low, data)
            starts, ends = np.append(starts, whole_words[0]), np.append(ends, whole_words[1])
            turn = np.argsort(starts, kind="stable")
            starts, ends = starts[turn], ends[turn]
        text = np.searchsorted(offsets, starts, "right") - 1
        if hard.any():
            easy = ~hard[text]
            starts, ends, text = starts[easy], ends[easy], text[easy]
        h = slice_hash(prefix_hash(low), starts, ends)
        if len(self.size) > self.room:
            self._reset()
        at = self.table.find(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            unseen, one = np.unique(h[new], return_index=True)
            raw, one = low.tobytes(), new[one]
            got = self.library_ids([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            if len(self.size) + len(unseen) > 1.5 * self.room:  # one very varied chunk: a larger table for it
                self.room = len(self.size) + len(unseen)
                known, slots = self.table.keys[self.table.at >= 0], self.table.at[self.table.at >= 0]
                self.table = HashTable(self.room.bit_length())
                self.table.add(known, slots)
            self._learn(unseen, np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64))
            at[new] = self.table.find(h[new])
        size = self.size[at]
        counts = np.bincount(text, size, n).astype(np.int64)
        if odd is not None:
            counts += odd
        by_library = {}
        if hard.any():
            rows = np.flatnonzero(hard)
            raw = data.tobytes()
            by_library = dict(zip(rows.tolist(), self.library_ids([raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in rows]), strict=True))
            for i, ids in by_library.items():
                counts[i] = len(ids)
        if not want_ids:
            return counts, None
        flat = self.flat[np.repeat(self.first[at], size) + spread(size)]
        if by_library:
            out, ends_of = np.zeros(int(counts.sum()), np.uint32), np.cumsum(counts)
            out[~np.repeat(hard, counts)] = flat
            for i, ids in by_library.items():
                out[ends_of[i] - counts[i] : ends_of[i]] = ids
            flat = out
        return counts, flat


def whole_tokens(path: str) -> dict[str, int]:
    """The vocabulary's strings that, encoded alone, are one token: proven by encoding each.

    Found once, offline, from the tokenizer file; bounded by the vocabulary.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    strings = sorted({library.id_to_token(i).removesuffix("</w>") for i in range(library.get_vocab_size(False))})
    byte_of, raws = _byte_letters(), []
    for s in strings:
        if s and all(c in byte_of for c in s):
            raw = bytes(byte_of[c] for c in s)
            if raw.decode("utf-8", "ignore").encode() == raw:  # not part of a character
                raws.append(raw)
    data = np.frombuffer(b"".join(raws), np.uint8)
    offsets = np.append(0, np.cumsum([len(r) for r in raws]))
    low, kind, bad = classes(data, offsets, lower=True)
    hard = texts_of(bad, offsets)
    starts, ends = split(low, kind, offsets, spaces=False)
    pieces = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(raws))
    covered = np.bincount(np.searchsorted(offsets, starts, "right") - 1, ends - starts, len(raws))
    same = np.add.reduceat(low != data, offsets[:-1]) == 0
    alone = [raws[i].decode() for i in np.flatnonzero(~hard & same & (pieces == 1) & (covered == np.diff(offsets)))]
    encoded = library.encode_batch_fast(alone, add_special_tokens=False)
    return {s: e.ids[0] for s, e in zip(alone, encoded, strict=True) if len(e.ids) == 1}


def _byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
