"""BPE encoding and decoding with batched numpy merge rounds.

The vocabulary file of a word-level BPE (words end in a marked symbol) is read as data; no tokenizer library is
called. Texts are normalised, cut at white space, and each different piece of a batch is merged once: the symbols
of many words lie in one flat array, a round looks up every adjacent pair in the sorted pair keys by binary search,
takes the pair of lowest rank in each word and merges it everywhere in that word, left to right. Words without a
known pair leave the array. A worker keeps what it has merged for its next batches, up to a fixed number of pieces.

Null texts count as empty; an empty text gives no ids and decodes to "". Rows are independent: repeated rows give
repeated results, an empty table gives an empty one, other columns are ignored. Very long texts are handled whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, slices

#: Different pieces kept in a worker's memory before it starts anew.
PIECES_KEPT = 500_000
#: White space as the vocabulary's normaliser sees it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        size = max(*vocab.values(), *added.values()) + 1
        names = [""] * size
        for token, i in (vocab | added).items():
            names[i] = token
        self.names = pa.array(names, pa.string())
        self.base = size
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, made
        self.split_added = regex.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.odd = "|".join([r"[\x00\x1c-\x1f]", *map(re.escape, added)])
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self._clear()

    def _clear(self) -> None:
        self.pieces: dict[str, int] = {"": 0}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(1, np.int64)
        self.count = np.zeros(1, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, joined, and the number of each; no word is empty."""
        n_words = len(words)
        size = np.fromiter(map(len, words), np.int64, n_words)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(n_words), size)
        done_symbols, done_words = [], []
        none = np.int64(len(self.keys))
        while len(symbols):
            pair = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), none - 1)
            rank = np.full(len(symbols), none)
            rank[:-1] = np.where((self.keys[at] == pair) & (word[:-1] == word[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(starts, append=len(word))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            hit = (rank == best) & (best < none)
            # of touching hits (a run of equal symbols) every other one is merged, from the left
            touch = np.flatnonzero(hit[1:] & hit[:-1] & (word[1:] == word[:-1])) + 1
            if len(touch):
                begin = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (word[1:] == word[:-1])]))
                place = touch - begin[np.searchsorted(begin, touch, "right") - 1]
                hit[touch[place % 2 == 1]] = False
            symbols = np.where(hit, self.made[np.minimum(rank, none - 1)], symbols)
            keep = np.ones(len(symbols), bool)
            keep[1:] = ~hit[:-1]
            going = best < none
            out = keep & ~going
            if out.any():
                done_symbols.append(symbols[out])
                done_words.append(word[out])
            stay = keep & going
            symbols, word = symbols[stay], word[stay]
        flat, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbols, done_words))
        order = np.argsort(of, kind="stable")
        return flat[order], np.bincount(of, minlength=n_words)

    def _learn(self, new: list[str]) -> None:
        known = len(self.pieces)
        self.pieces.update(zip(new, range(known, known + len(new)), strict=True))
        found = [[w.encode() for w in self.words.findall(p)] for p in new]
        n_words = np.fromiter(map(len, found), np.int64, len(found))
        flat, counts = self.merge([w for ws in found for w in ws])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(n_words)])]
        self.ids = np.concatenate([self.ids[: self.used], flat.astype(np.uint32)])
        self.first = np.concatenate([self.first, self.used + ends[:-1]])
        self.count = np.concatenate([self.count, np.diff(ends)])
        self.used += len(flat)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens; white space is any that str.split and the normaliser both know."""
        cut = pc.utf8_split_whitespace(texts)
        pieces = cut.flatten().dictionary_encode()
        words = pieces.dictionary.to_pylist()
        if new := [w for w in words if w not in self.pieces]:
            self._learn(new)
        known = np.fromiter(map(self.pieces.__getitem__, words), np.int64, len(words))
        index = known[pieces.indices.to_numpy()]
        lengths = self.count[index]
        flat = self.ids[runs(self.first[index], lengths)]
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        return flat, np.diff(np.concatenate([[0], np.cumsum(lengths)])[offsets])

    def _odd(self, text: str) -> np.ndarray:
        """Ids of a text with special tokens or control characters, piece by piece."""
        out = []
        for part in self.split_added.split(text):
            if part in self.added:
                out.append(np.array([self.added[part]], np.uint32))
            elif words := [w.encode() for w in self.words.findall(self.normal(part))]:
                out.append(self.merge(words)[0].astype(np.uint32))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's own lower case (no rule for a final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined (uint32), and the number of ids of each; null texts count as empty."""
        if len(self.pieces) > PIECES_KEPT:
            self._clear()
        odd = np.flatnonzero(pc.match_substring_regex(pc.fill_null(texts, ""), self.odd).to_numpy(zero_copy_only=False))
        strings = texts.to_pylist()
        strange = {int(i): self._odd(strings[i]) for i in odd}
        flat, counts = self._plain(pa.array(["" if i in strange or not t else self.normal(t) for i, t in enumerate(strings)], pa.string()))
        if strange:
            ends = np.cumsum(counts)
            flat = np.concatenate([x for i, at in zip(odd, np.split(flat, ends[odd])[:-1], strict=True) for x in (at, strange[int(i)])] + [flat[ends[odd[-1]] :]])
            counts[odd] = [len(strange[int(i)]) for i in odd]
        return flat, counts

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Token names joined by a blank, special tokens included: what a tokenizer without a decoder step gives."""
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.names.take(pa.array(flat))), " ")


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every text; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for b in slices(batch):
                flat, counts = bpe.encode(b["text"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
                yield pa.record_batch([b["doc_id"], ids, bpe.decode(flat, counts)], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids as little-endian unsigned 32-bit integers, decoded text as UTF-8."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for b in slices(batch):
                flat, counts = bpe.encode(b["text"])
                raw, ends = flat.astype("<u4").tobytes(), np.cumsum(counts)
                cut = memoryview(raw)
                ids = [hashlib.sha256(cut[4 * (e - n) : 4 * e]).hexdigest() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                decoded = bpe.decode(flat, counts)
                at, text = np.frombuffer(decoded.buffers()[1], np.int32)[: len(decoded) + 1].tolist(), memoryview(decoded.buffers()[2] or b"")
                texts = [hashlib.sha256(text[a:z]).hexdigest() for a, z in zip(at[:-1], at[1:], strict=True)]
                yield pa.record_batch([b["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
