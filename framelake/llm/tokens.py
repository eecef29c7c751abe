"""Token ids by the tokenizers library, with a cache of pre-tokens.

Two common pre-tokenizers cut a text into pieces that are encoded apart from each other, so a piece's ids
can be kept and used again. Many texts are cut at once, on arrays of their code points: class changes mark
where pieces begin, each piece gets a 64-bit hash of its code points, and a hash table gives its place
among the known pieces; unknown ones are encoded by the library. Texts with characters on which
regular-expression dialects may differ are encoded whole, as are all texts of other tokenizers, and pieces
of over LONGEST characters are looked up by their text. The ids are the same in all ways.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: The pre-tokenizers that the cache knows (fixed values, as in the tokenizer files).
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Latin text; without controls, superscript digits, fractions and the dotted capital I.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")
LONGEST = 64
SEP, LETTER, DIGIT, SPACE, OTHER = range(5)
QUOTE = 39
TABLE_BITS = 22


def _classes() -> np.ndarray:
    def of(c: int) -> int:
        if c == 0:
            return SEP
        if chr(c) in "\t\n\r \xa0":
            return SPACE
        return LETTER if chr(c).isalpha() else DIGIT if 48 <= c <= 57 else OTHER

    return np.array([of(c) for c in range(0x250)], np.uint8)


_CLASS = _classes()
_RANDOM = np.random.default_rng(20240229)
_BY_CODE = _RANDOM.integers(1, 1 << 63, 0x250, np.uint64) * np.uint64(2) + np.uint64(1)
_BY_PLACE = _RANDOM.integers(1, 1 << 63, LONGEST, np.uint64) * np.uint64(2) + np.uint64(1)


def piece_starts(codes: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin, and the class of the first character of each; separators are pieces.

    words: white space is dropped and digits stand alone; else a space goes with what follows it.
    """
    kind = _CLASS[codes]
    begins = np.ones(len(kind), bool)
    begins[1:] = kind[1:] != kind[:-1]
    space = kind == SPACE
    if words:
        begins |= (kind == DIGIT) | (kind == SEP)
    else:
        begins |= kind == SEP
        solid = ~space & (kind != SEP)
        # the last white space before something starts a piece; if it is a plain space, it takes what follows along
        begins[:-1] |= space[:-1] & solid[1:]
        begins[1:] &= ~((codes[:-1] == 32) & solid[1:])
    quote = np.flatnonzero((codes[:-2] == QUOTE) & begins[:-2]) if len(codes) > 2 else np.zeros(0, int)
    if len(quote):
        a, b = codes[quote + 1], codes[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for own, n in ((one, 1), (two & ~one, 2)):
            at = quote[own]
            begins[at + 1] = False
            end = at + 1 + n
            end = end[end < len(codes)]
            begins[end[kind[end] == LETTER]] = True
    starts = np.flatnonzero(begins)
    return starts, kind[starts]


class Encoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, held: int = 3_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.held = held
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, cut = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        self.known, self.words = False, False
        if before is None and cut == BYTE_LEVEL:
            self.known = True
        elif before and [n["type"] for n in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            if [p.get("pattern", {}).get("Regex") for p in cut.get("pretokenizers", [])] == [WORD_SPLIT, None]:
                self.known = self.words = True
        self._forget()

    def _forget(self) -> None:
        """An empty cache. Piece k has key keys[k] and the ids pool[offset[k] : offset[k] + size[k]]; piece 0 is none."""
        self.slots = np.zeros((2, 1 << TABLE_BITS), np.int32)
        self.keys, self.offset, self.size = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.count, self.pool, self.filled = 1, np.zeros(1 << 14, np.uint32), 0
        self.odd: dict[str, int] = {}  # pieces that the table can't hold

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encoded(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece. Words go many to a text, which the pre-tokenizer parts again."""
        plain = [k for k, w in enumerate(pieces) if (w.isalpha() if self.words else w[0] == " " and w[1:].isalpha())]
        out: list[np.ndarray | None] = [None] * len(pieces)
        chunks = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        joined = [(" " if self.words else "").join([pieces[k] for k in c]) for c in chunks]
        for chunk, e in zip(chunks, self.tokenizer.encode_batch(joined, add_special_tokens=False)):
            ids, of = np.array(e.ids, np.uint32), np.array(e.word_ids, np.int64)
            stops = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)).tolist()
            if len(stops) != len(chunk):
                raise ValueError("the tokenizer parts words otherwise")
            at = 0
            for k, stop in zip(chunk, stops):
                out[k] = ids[at:stop]
                at = stop
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[k] for k in rest], add_special_tokens=False)):
            out[k] = np.array(e.ids, np.uint32)
        return out

    def _add(self, ids: list[np.ndarray]) -> np.ndarray:
        """Stores the ids of new pieces; their places."""
        n, sizes = len(ids), np.array([len(x) for x in ids], np.int64)
        while self.count + n > len(self.keys):
            self.keys, self.offset, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.offset, self.size))
        while self.filled + sizes.sum() > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        at = np.arange(self.count, self.count + n)
        self.size[at] = sizes
        self.offset[at] = self.filled + np.cumsum(sizes) - sizes
        if n:
            self.pool[self.filled : self.filled + sizes.sum()] = np.concatenate(ids)
        self.count, self.filled = self.count + n, self.filled + int(sizes.sum())
        return at

    def _places(self, joined: str, starts: np.ndarray, stops: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The place of every piece; new ones are encoded."""
        tries = [(h >> np.uint64(64 - TABLE_BITS)).astype(np.int32), (h & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int32)]
        place = self.slots[0][tries[0]]
        lost = np.flatnonzero(self.keys[place] != h)
        if not len(lost):
            return place
        second = self.slots[1][tries[1][lost]]
        hit = self.keys[second] == h[lost]
        place[lost[hit]] = second[hit]
        lost = lost[~hit]
        if not len(lost):
            return place
        _, first, of = np.unique(h[lost], return_index=True, return_inverse=True)
        new = lost[first]
        pieces = [joined[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist())]
        found = np.array([self.odd.get(p, 0) for p in pieces], np.int64) if self.odd else np.zeros(len(pieces), np.int64)
        unknown = np.flatnonzero(found == 0)
        at = self._add(self._encoded([pieces[k] for k in unknown]))
        found[unknown] = at
        for k, p in zip(unknown.tolist(), at.tolist()):
            key = h[new[k]]
            for probe in (0, 1):
                slot = tries[probe][new[k]]
                if key and not self.slots[probe][slot]:
                    self.slots[probe][slot] = p
                    self.keys[p] = key
                    break
            else:
                self.odd[pieces[k]] = p
        place[lost] = found[of]
        return place

    def _cut(self, texts: list[str]) -> list[bytes]:
        joined = "\0".join(texts) + "\0"
        if self.words:
            joined = joined.lower()
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, kind = piece_starts(codes, self.words)
        stops = np.append(starts[1:], len(codes))
        n = stops - starts
        place_in = np.arange(len(codes)) - np.repeat(starts, n)
        value = _BY_CODE[codes] * _BY_PLACE[np.minimum(place_in, LONGEST - 1)]
        h = np.add.reduceat(value, starts)
        h ^= h >> np.uint64(31)
        h[h == 0] = 1
        use = kind != SEP
        if self.words:
            use &= kind != SPACE
        long = use & (n > LONGEST)
        # no two long pieces may share a key: they are looked up by text
        at = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(use & ~long)
        at[short] = self._places(joined, starts[short], stops[short], h[short])
        for k in np.flatnonzero(long).tolist():
            p = joined[starts[k] : stops[k]]
            if p not in self.odd:
                self.odd[p] = int(self._add(self._encoded([p]))[0])
            at[k] = self.odd[p]
        size = self.size[at].astype(np.int64)
        total = np.cumsum(size)
        ids = self.pool[np.repeat(self.offset[at] - total + size, size) + np.arange(int(total[-1]))].astype("<u4").tobytes()
        ends = total[np.flatnonzero(kind == SEP)].tolist()
        return [ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.count > self.held:
            self._forget()
        out: list[bytes | None] = [None] * len(texts)
        cut = [i for i, t in enumerate(texts) if self.known and PLAIN.fullmatch(t)]
        part: list[int] = []
        size = 0
        for i in cut:  # about a million characters at a time
            part.append(i)
            size += len(texts[i])
            if size > 1 << 20 or i == cut[-1]:
                for k, x in zip(part, self._cut([texts[k] for k in part])):
                    out[k] = x
                part, size = [], 0
        for i, x in enumerate(out):
            if x is None:
                out[i] = self._raw([texts[i]])[0]
        return out


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, held: int = 3_000_000) -> Encoder:
    """The worker's encoder for a tokenizer file; it keeps about held pieces, of some 50 bytes each."""
    if (path, held) not in _ENCODERS:
        _ENCODERS[path, held] = Encoder(path, held)
    return _ENCODERS[path, held]
