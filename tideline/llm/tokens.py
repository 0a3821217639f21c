"""Token ids of whole texts by a byte-level BPE of the tokenizers library.

Byte-level BPE splits a text into pieces (letters, digits or signs, each with a blank before it) and merges inside
these. A text whose white space is single blanks and line feeds is cut with numpy, by the class of each character.
Each different piece goes to the library's BPE model once; its ids are then found by the bytes of the piece in a hash
table of numpy arrays, so that a piece costs no Python object, and a worker can keep many. Any other text (runs of
white space, tabs, special tokens) goes to the library whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .bpe import byte_letters
from .common import runs, single_thread

#: Bytes of text encoded at once, and different pieces kept in a worker's memory before it starts anew (some 60 bytes each).
ROOMY, TIGHT = (1 << 20, 1_500_000), (1 << 20, 500_000)
#: Ids of pieces kept.
IDS_KEPT = 16_000_000
#: Classes of characters: letters, digits, signs, the blank, the line feed, other white space (as any of the libraries sees it).
LETTER, DIGIT, SIGN, BLANK, FEED, ODD = range(6)
SPACE = r"[\s\x1c-\x1f\x85]"
#: A piece this long is found by a Python object.
LONG = 24
_PART = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


class Pieces:
    """Ids of byte strings, each different one computed once by `ids_of`, which gets its letters (see byte_letters)."""

    def __init__(self, ids_of: Callable[[str], list[int]]) -> None:
        self.ids_of, self.letters = ids_of, dict(enumerate(byte_letters()))
        self.clear()

    def clear(self) -> None:
        self.n = self.used = 0
        self.long: dict[bytes, int] = {}
        self.table = np.zeros(1 << 16, np.int32)  # 1 + index of a piece, at a place that its bytes tell, or at the next free one
        self.keys = np.zeros((1 << 14, 3), np.uint64)  # a piece's bytes, the last one its length
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.ids = np.zeros(1 << 16, np.int32)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    @staticmethod
    def _hashes(keys: list[np.ndarray]) -> np.ndarray:
        h = (keys[0] * _FACTORS[0] + keys[1]) * _FACTORS[1] + keys[2]
        h ^= h >> np.uint64(32)
        return h * _FACTORS[2]

    def find(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index into first and count of each piece raw[start:end]; behind the last one raw has LONG bytes more. No piece is empty."""
        size = end - start
        big = np.flatnonzero(size >= LONG)
        if not len(big):
            return self._find(raw, start, size)
        index = np.empty(len(start), np.int64)
        data = [raw[a:z].tobytes() for a, z in zip(start[big].tolist(), end[big].tolist(), strict=True)]
        if new := [w for w in dict.fromkeys(data) if w not in self.long]:
            self.long.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self._learn(b"".join(new), np.array([len(w) for w in new]), np.zeros((len(new), 3), np.uint64))
        index[big] = [self.long[w] for w in data]
        rest = np.flatnonzero(size < LONG)
        index[rest] = self._find(raw, start[rest], size[rest])
        return index

    def _find(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.int64)
        words = np.ndarray((len(raw) - 7,), "<u8", buffer=raw, strides=(1,))
        keys = [words[start] & _PART[np.minimum(size, 8)], np.zeros(len(start), np.uint64), size.astype(np.uint64) << np.uint64(56)]
        for i in (1, 2):
            more = np.flatnonzero(size > 8 * i)
            keys[i][more] |= words[start[more] + 8 * i] & _PART[np.minimum(size[more] - 8 * i, 8)]
        hashes = self._hashes(keys)
        slot = self._slots(hashes)
        at = self.table[slot] - 1
        open_ = np.flatnonzero(~self._same(at, keys))
        while len(open_):
            open_ = open_[at[open_] >= 0]
            slot[open_] = (slot[open_] + 1) & (len(self.table) - 1)
            at[open_] = self.table[slot[open_]] - 1
            open_ = open_[~self._same(at[open_], [k[open_] for k in keys])]
        if len(gone := np.flatnonzero(at < 0)):
            gone = gone[np.argsort(hashes[gone], kind="stable")]
            mine = np.stack([k[gone] for k in keys], axis=1)
            fresh = np.append(True, (mine[1:] != mine[:-1]).any(1))
            at[gone] = self.n + np.cumsum(fresh) - 1
            one = gone[fresh]
            index = at[one]
            self._learn(raw[runs(start[one], size[one])].tobytes(), size[one], mine[fresh])
            if 2 * self.n > len(self.table):
                self.table = np.zeros(1 << (4 * self.n).bit_length(), np.int32)
                index = np.flatnonzero(self.keys[: self.n, 2])
            self._put(index)
        return at

    def _same(self, at: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        got = self.keys[at]  # a free place gives the last row, which is free too
        same = got[:, 2] == keys[2]
        same &= got[:, 0] == keys[0]
        same &= got[:, 1] == keys[1]
        return same

    def _put(self, index: np.ndarray) -> None:
        slot = self._slots(self._hashes(list(self.keys[index].T)))
        while len(index):
            free = self.table[slot] == 0
            self.table[slot[free]] = index[free] + 1
            lost = self.table[slot] != index + 1
            index, slot = index[lost], (slot[lost] + 1) & (len(self.table) - 1)

    def _learn(self, data: bytes, size: np.ndarray, keys: np.ndarray) -> None:
        text, ends, ids_of = data.decode("latin-1").translate(self.letters), np.cumsum(size), self.ids_of
        flat, counts = [], []
        for a, z in zip((ends - size).tolist(), ends.tolist(), strict=True):
            flat += (ids := ids_of(text[a:z]))
            counts.append(len(ids))
        n, used = self.n + len(counts), self.used + len(flat)
        if n >= len(self.first):
            more = max(len(counts), len(self.first) // 2) + 1
            self.keys = np.concatenate([self.keys, np.zeros((more, 3), np.uint64)])
            self.first, self.count = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.first, self.count))
        if used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(flat), len(self.ids) // 2), np.int32)])
        self.keys[self.n : n], self.count[self.n : n] = keys, counts
        self.first[self.n : n] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : used] = flat
        self.n, self.used = n, used


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, SIGN, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (ODD, SPACE)):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")] = kind
    out[32], out[10] = BLANK, FEED
    return out


def classes(raw: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of UTF-8 text belongs to."""
    table = _classes()
    out = table[:256][raw]
    more = np.flatnonzero(raw >= 0xC0)
    if len(more):
        lead = raw[more]
        length = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        code = lead.astype(np.int64) & (0x7F >> length)
        for i in (1, 2, 3):
            on = np.flatnonzero(length > i)
            code[on] = code[on] << 6 | (raw[more[on] + i] & 0x3F)
        kind = table[code]
        out[more] = kind
        for i in (1, 2, 3):
            on = np.flatnonzero(length > i)
            out[more[on] + i] = kind[on]
    return out


class TextEncoder:
    def __init__(self, path: str, parts_kept: int) -> None:
        single_thread()
        self.parts_kept = parts_kept
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        tokenize = self.tokenizer.model.tokenize
        self.pieces = Pieces(lambda letters: [t.id for t in tokenize(letters)])
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _odd(self, raw: np.ndarray, begins: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts with white space that isn't a lone blank or line feed, or with a special token."""
        white = kind >= BLANK
        at = [np.flatnonzero(kind == ODD), np.flatnonzero(white[1:] & white[:-1] & ~begins[1:-1]) + 1]
        data, special = raw.tobytes(), []
        for token in self.special:
            found = data.find(token)
            while found >= 0:
                special.append(found)
                found = data.find(token, found + 1)
        return np.unique(np.searchsorted(offsets, np.concatenate([*at, np.array(special, np.int64)]), "right") - 1)

    @staticmethod
    def _starts(raw: np.ndarray, begins: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where each piece begins in texts that aren't odd."""
        cut = np.ones(len(raw), bool)
        cut[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK) | begins[1:-1]
        quotes = np.flatnonzero((raw == 39) & cut)
        if len(quotes):  # 's, 't, 'm, 'd, 're, 've and 'll are pieces of their own
            ends = np.append(begins, [True] * 2)
            after = np.append(raw, np.zeros(2, np.uint8))
            one, two = after[quotes + 1], after[quotes + 2]
            short = np.isin(one, list(b"stmd")) & ~ends[quotes + 1]
            pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
            pair &= ~ends[quotes + 1] & ~ends[quotes + 2]
            cut[quotes[short | pair] + 1] = False
            stops = np.concatenate([quotes[short] + 2, quotes[pair] + 3])
            cut[stops[stops < len(raw)]] = True
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, joined (uint32), and the number of ids of each text; null texts count as empty."""
        if self.pieces.n > self.parts_kept or self.pieces.used > IDS_KEPT:
            self.pieces.clear()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        odd, plain = np.zeros(0, np.int64), texts
        while True:
            data = np.frombuffer(plain.buffers()[1], "<i8")[plain.offset : plain.offset + len(plain) + 1]
            body = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[data[0] : data[-1]]
            offsets = data - data[0]
            begins = np.zeros(len(body) + 1, bool)  # one more: the end
            begins[offsets] = True
            kind = classes(body)
            if len(odd) or not len(odd := self._odd(body, begins, kind, offsets)):
                break
            plain = pc.if_else(pa.array(~np.isin(np.arange(len(texts)), odd)), texts, pa.scalar("", pa.large_string()))
        starts = self._starts(body, begins, kind)
        index = self.pieces.find(np.append(body, np.zeros(LONG, np.uint8)), starts, np.append(starts[1:], len(body)))
        lengths = self.pieces.count[index].astype(np.int64)
        flat = self.pieces.ids[runs(self.pieces.first[index], lengths)].astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offsets[1:])]
        counts = np.diff(ends, prepend=0)
        if not len(odd):
            return flat, counts
        whole = self.tokenizer.encode_batch_fast(texts.take(pa.array(odd)).to_pylist(), add_special_tokens=False)
        pieces, at = [], 0
        for i, e in zip(odd, whole, strict=True):
            start = int(ends[i])
            pieces += [flat[at:start], np.array(e.ids, np.uint32)]
            at, counts[i] = start, len(e.ids)
        return np.concatenate([*pieces, flat[at:]]), counts


@lru_cache(maxsize=2)
def encoder(path: str, parts_kept: int = ROOMY[1]) -> TextEncoder:
    """One encoder in each Python worker; what it has learnt serves the worker's next tasks too."""
    return TextEncoder(path, parts_kept)
