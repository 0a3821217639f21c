"""Language-model scoring: a causal self-attention model over subword ids, with what the corpus repeats and how often its words occur.

A word's probability is that of its subwords in the attention model (see attention.py), which scores every subword once
in overlapping windows of its document with batched masked attention. Two corrections come from the whole corpus: the
word's share of the training words, and a memory of continuations: how often the same CONTEXT words before it stand
in the training documents, and how often this word followed there; every word with CONTEXT words before it in its text is
remembered. All texts are scored by this one model, training documents too, whose own words it has read. On request a
second score leaves a training document's own occurrences out of the counts, so that it is comparable to a held-out one's.

Counts cover all documents: a task reduces each slice of text to its different words and continuations (64-bit
hashes) with their training counts, slices send these to hash ranges, where they are summed, and the sums go back to the
slices that asked. So a word that stands everywhere is sent once per slice, and nothing about words meets in one place.
The attention model starts on the driver, from about WINDOWS windows of a few words drawn evenly from all training text:
they give its first parameters and which subwords form a class. Then it learns every subword of every training text:
tasks take Adam steps from the common model over all their texts, and the changes are averaged by Spark, each parameter
by how often a task used it; the shares of subwords in their class are those of all training text. Its size is that of
the public vocabulary, and it is broadcast. The last pass cuts each slice's words into subword ids, once
per different word, and scores.

Null texts count as empty: one token, the end. Repeated rows repeat; an empty table gives an empty result; other
columns are ignored. Without training documents the counts are zero and the model is its starting state.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .bpe import byte_letters
from .common import kept, runs, single_thread, slices
from .tokens import LONG, Pieces
from .words import joined, mix, per_text, spans, words

#: Bytes of text in a slice; slices per hash range of words, and the fewest and most ranges.
SLICE, PER_RANGE, FEWEST, MOST = 1 << 20, 4, 256, 1 << 16
#: Slices of a stored file; what a task reads of it at once.
SLICES_A_FILE = 8
#: Windows that the attention model starts from, about; rate of the steps of the pass over all training text.
WINDOWS, PASS_RATE = 40_000, 0.001
#: Changes of parameters are summed as whole numbers of this part of one, so that sums don't depend on their order.
GRAIN = 1 << 24
#: Words of a context; occurrences of a context at which its memory counts half.
CONTEXT, HALF = 4, 1.0
#: Weight of the attention model against the word's share.
ATTENTION = 0.5
#: Different words (some 60 bytes each), and subwords of them (4 bytes each), that a worker keeps before it starts anew.
WORDS_KEPT, IDS_KEPT = 1_000_000, 8_000_000
#: Each byte with A-Z as a-z.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Bits of a continuation's key that tell the context; the others tell the word.
CONTEXT_BITS = np.uint64(48)
#: The hash of the end of a document.
END = np.uint64(0xFFFFFFFFFFFFFFFF)


class Subwords:
    """Subword ids of words, by a byte-level BPE of the tokenizers library; each word is read with a blank before it."""

    def __init__(self, path: str) -> None:
        single_thread()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenize, blank = tokenizer.model.tokenize, byte_letters()[32]
        self.start = tokenizer.get_vocab_size()
        self.end, self.size = self.start + 1, self.start + 2
        self.pieces = Pieces(lambda letters: [t.id for t in tokenize(blank + letters)])

    @property
    def ids(self) -> np.ndarray:
        return self.pieces.ids

    def at(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in self.ids, and how many there are."""
        if self.pieces.n > WORDS_KEPT or self.pieces.used > IDS_KEPT:
            self.pieces.clear()
        index = self.pieces.find(np.append(LOWER[raw], np.zeros(LONG, np.uint8)), start, end)
        return self.pieces.first[index], self.pieces.count[index].astype(np.int64)

    def of(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same; the words are told apart by their bytes, not by their hashes."""
        return self.at(raw, start, end)


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


def _slices(docs: DataFrame) -> DataFrame:
    """(slice, doc_ids, learn, texts): rows of about SLICE bytes of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 33
        for batch in batches:
            for b in slices(batch, limit=SLICE):
                one = [pa.array([n]), *(pa.ListArray.from_arrays(pa.array([0, len(b)], pa.int32()), x) for x in (b["doc_id"], b["learn"], pc.fill_null(b["text"], "")))]
                yield pa.record_batch(one, ["slice", "doc_ids", "learn", "texts"])
                n += 1

    return docs.mapInArrow(work, "slice long, doc_ids array<long>, learn array<boolean>, texts array<string>")


def _different(texts: list[str]) -> tuple:
    raw, starts = joined(texts)
    begin, end, hashes = words(raw)
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(hashes)]
    back = np.empty(len(hashes), np.int64)
    back[order] = np.cumsum(new) - 1
    return raw, per_text(starts, begin), begin, end, ordered[new], order[new], back


def continuations(hashes: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words have a context, all of it in their own text, and the key of context and word."""
    n = len(hashes)
    if n <= CONTEXT:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    context = np.zeros(n - CONTEXT, np.uint64)
    for i in range(CONTEXT):
        context = context * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - CONTEXT + i]
    context = mix(context)
    place = np.arange(n) - np.repeat(first_word[:-1], np.diff(first_word))
    at = np.flatnonzero(place[CONTEXT:] >= CONTEXT)
    low = np.uint64(64) - CONTEXT_BITS
    return at + CONTEXT, (context[at] >> low) << low | mix(hashes[at + CONTEXT]) >> CONTEXT_BITS


def planes(values: np.ndarray) -> bytes:
    """All first bytes of the values, then all second ones, and so on: high bytes are alike, so that what is shuffled or stored compresses well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _counted(values: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each is taught."""
    unique, counts = np.unique(values, return_counts=True)
    rest = np.sort(values[~taught])  # few, so that no value's place among all is needed
    return unique, counts - np.bincount(np.searchsorted(unique, rest), minlength=len(unique))


def _asks(sliced: DataFrame, bits: int) -> DataFrame:
    """(slice, range, hashes, counts): each slice's different words (ranges from 0) and continuations (ranges from 2**bits), in order of hash, with their training counts, both in planes; a hash is given by its distance from the one before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                learn = np.array(batch["learn"][r].as_py(), bool)
                raw, starts = joined(batch["texts"][r].as_py())
                begin, _, hashes = words(raw)
                first_word = per_text(starts, begin)
                taught = np.repeat(learn, np.diff(first_word))
                unique, counts = _counted(hashes, taught)
                at, keys = continuations(hashes, first_word)
                kinds = [(0, np.append(unique, END), np.append(counts, learn.sum())), (1 << bits, *_counted(keys, taught[at]))]
                for base, keys, counts in kinds:
                    if not len(keys):
                        continue
                    where = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    edges = np.flatnonzero(np.diff(where, prepend=-1))
                    stops = np.append(edges[1:], len(where))
                    apart = np.diff(keys, prepend=np.uint64(0))
                    apart[edges] = keys[edges]
                    yield pa.record_batch(
                        [
                            pa.array(np.full(len(edges), batch["slice"][r].as_py())),
                            pa.array((where[edges] + base).astype(np.int32)),
                            pa.array([planes(apart[a:z]) for a, z in zip(edges, stops, strict=True)], pa.binary()),
                            pa.array([planes(counts[a:z].astype("<u4")) for a, z in zip(edges, stops, strict=True)], pa.binary()),
                        ],
                        ["slice", "range", "hashes", "counts"],
                    )

    return sliced.mapInArrow(work, "slice long, range int, hashes binary, counts binary")


def _answers(asks: DataFrame, bits: int) -> DataFrame:
    """(slice, range, wide, totals, tokens, distinct): the counts over all slices, of a continuation's context after those of the continuations, in planes of 8 bytes each if wide, else 4; the last two only in one row of a range of words."""

    def work(group: pa.Table) -> pa.Table:
        sizes = [len(x.as_py()) // 8 for x in group["hashes"]]
        hashes = np.concatenate([np.cumsum(from_planes(x.as_py(), "<u8"), dtype=np.uint64) for x in group["hashes"]])
        counts = np.concatenate([from_planes(x.as_py(), "<u4") for x in group["counts"]])
        ends = np.cumsum(sizes)
        unique, back = np.unique(hashes, return_inverse=True)
        totals = np.bincount(back, weights=counts).astype(np.int64)
        mine = [totals[back]]
        first = np.zeros((2, len(sizes)), np.int64)
        if group["range"][0].as_py() >> bits:
            context = unique >> (np.uint64(64) - CONTEXT_BITS)  # in order, as the keys are
            heads = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            mine.append(np.repeat(np.add.reduceat(totals, heads), np.diff(heads, append=len(context)))[back])
        else:
            first[:, 0] = counts.sum(dtype=np.int64), (totals > 0).sum()
        wide = max(int(m.max()) for m in mine) >= 1 << 32
        mine = [m.astype("<i8" if wide else "<u4") for m in mine]
        rows = pa.array([planes(np.concatenate([m[z - n : z] for m in mine])) for z, n in zip(ends, sizes, strict=True)], pa.binary())
        return pa.table([group["slice"], group["range"], pa.array([wide] * len(sizes)), rows, *map(pa.array, first)], ["slice", "range", "wide", "totals", "tokens", "distinct"])

    return asks.groupBy("range").applyInArrow(work, "slice long, range int, wide boolean, totals binary, tokens long, distinct long")


def _windows(sliced: DataFrame, path: str, most: int) -> DataFrame:
    """(first, window): about `most` windows (see attention.fitted) to start from, at words drawn evenly from all words to learn from."""
    n_slices = max(1, sliced.count())
    block = attention.BLOCK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path)
        for batch in batches:
            for r in range(len(batch)):
                rng = np.random.default_rng(batch["slice"][r].as_py() & 0xFFFFFFFF)
                learn = np.flatnonzero(np.array(batch["learn"][r].as_py(), bool))
                texts = batch["texts"][r].as_py()
                raw, starts = joined([texts[i] for i in learn.tolist()])
                begin, end = spans(raw)
                first_word = per_text(starts, begin)
                share = most / n_slices * min(1.0, len(raw) / SLICE)
                drawn = rng.integers(0, max(1, len(begin)), int(share) + int(rng.random() < share % 1) if len(begin) else 0)
                of = np.searchsorted(first_word, drawn, "right") - 1
                lo, hi = np.maximum(first_word[of], drawn - block), np.minimum(first_word[of + 1], drawn + block)
                near = runs(lo, hi - lo)
                at, n = sub.at(raw, begin[near], end[near])
                stops = np.cumsum(hi - lo)
                outside, out = [attention.OUTSIDE] * (2 * block), []
                for w, t, a, z, stop in zip(drawn.tolist(), of.tolist(), lo.tolist(), hi.tolist(), stops.tolist(), strict=True):
                    own = slice(stop - (z - a), stop)
                    begins, ends = int(a == first_word[t]), int(z == first_word[t + 1])
                    ids = [*outside, *[sub.start] * begins, *sub.ids[runs(at[own], n[own])].tolist(), *[sub.end] * ends, *outside]
                    here = int(n[own][: w - a].sum()) + 2 * block + begins - 1  # the input before the word
                    out.append(np.array(ids[here - block : here + block + 1], "<i4").tobytes())
                yield pa.record_batch([pa.array([True] * len(out), pa.bool_()), pa.array(out, pa.binary())], ["first", "window"])

    return sliced.select("slice", "learn", "texts").mapInArrow(work, "first boolean, window binary")


def _ids(texts: list[str], sub: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of all texts, joined, and how many each text has."""
    raw, starts = joined(texts)
    begin, end = spans(raw)
    at, n = sub.at(raw, begin, end)
    return sub.ids[runs(at, n)], np.diff(np.concatenate([[0], np.cumsum(n)])[per_text(starts, begin)])


def _model(windows: DataFrame, size: int, sliced: DataFrame | None = None, path: str = "") -> attention.Model:
    """The attention model from a stored table of windows (see _windows): started on the driver from the first ones, then one pass of all tasks over all texts of `sliced` to learn from (without it: over the other windows), whose changes are averaged."""
    spark, width = windows.sparkSession, 2 * attention.BLOCK + 1
    rows = windows.where("first").select("window").collect()  # about WINDOWS rows of 132 bytes
    state = attention.fitted(np.frombuffer(b"".join(sorted(bytes(r[0]) for r in rows)), "<i4").reshape(-1, width), size)
    common = spark.sparkContext.broadcast(state)
    names, of_texts = [f"d{i}" for i in range(attention.D)], sliced is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(size, np.int64)

        def windows_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            got = np.frombuffer(b"".join(batch["window"].to_pylist()), "<i4").reshape(-1, width).astype(np.int64)
            for i in range(0, len(got), attention.BATCH):
                yield got[i : i + attention.BATCH]

        def texts_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            sub = subwords(path)
            for r in range(len(batch)):
                ids, per = _ids(batch["texts"][r].values.filter(batch["learn"][r].values).to_pylist(), sub)
                times[:] += np.bincount(ids, minlength=size)
                times[sub.end] += len(per)
                yield from attention.covered(ids, per, sub.start, sub.end, np.random.default_rng(batch["slice"][r].as_py() & 0xFFFFFFFF))

        reads = texts_of if of_texts else windows_of
        some = (w for batch in batches for w in reads(batch))
        for at, weight, change in attention.moved(common.value, some, PASS_RATE):
            whole = np.round(change.astype(np.float64) * weight[:, None] * GRAIN).astype(np.int64)
            seen = np.where(at < size, times[np.minimum(at, size - 1)], 0)
            yield pa.record_batch([pa.array(at), pa.array(seen), pa.array(weight), *map(pa.array, whole.T.copy())], ["row", "times", "weight", *names])
            only = np.setdiff1d(np.flatnonzero(times), at)  # ids that nothing follows: ends
            nothing = pa.array(np.zeros(len(only), np.int64))
            yield pa.record_batch([pa.array(only), pa.array(times[only]), *[nothing] * (1 + len(names))], ["row", "times", "weight", *names])

    schema = ", ".join(f"{c} long" for c in ("row", "times", "weight", *names))
    source = windows.where("not first").select("window") if sliced is None else sliced.select("slice", "learn", "texts")
    changes = source.mapInArrow(work, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("times", "weight", *names)])
    moved, times = state.rows().astype(np.float64), np.zeros(size)
    if got := changes.select("row", "times", "weight", *names).collect():  # a row for each subword of the vocabulary and each part of the model
        table = np.array(got, np.float64)
        at = table[:, 0].astype(np.int64)
        moved[at] += table[:, 3:] / np.maximum(table[:, 2:3], 1) / GRAIN
        times[at[at < size]] = table[at < size, 1]
    state = state.of_rows(moved)
    if times.any():
        state.share = attention.shares(state.cls, times + attention.UNSEEN)
    return state.model()


def _elsewhere(totals: np.ndarray, values: np.ndarray, text: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """The counts of the values without those of the same text, if that is learned from."""
    mine = np.flatnonzero(learn[text] & (totals > 0))
    _, back, own = np.unique(mix(values[mine] + np.uint64(0x9E3779B97F4A7C15) * text[mine].astype(np.uint64)), return_inverse=True, return_counts=True)
    out = totals.copy()
    out[mine] -= own[back]
    return out


def score_slice(texts: list[str], learn: np.ndarray, totals: np.ndarray, known: np.ndarray, tokens: int, distinct: int, sub: Subwords, model: attention.Model, left_out: bool = False) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base and model score (log10) of each text; with left_out also the score without the own occurrences of a text to learn from.

    totals: training counts of its different words by hash, then of the end; known: of its different continuations by key, and of their contexts (rows)."""
    raw, first_word, begin, end, unique, first, back = _different(texts)
    n = len(texts)
    per = np.diff(first_word)
    # the words of each text and then its end; an end is one subword
    ends = np.cumsum(per + 1) - 1
    is_end = np.zeros(len(back) + n, bool)
    is_end[ends] = True
    spot = np.flatnonzero(~is_end)  # of each word
    count = np.empty(len(is_end), np.int64)
    count[spot], count[is_end] = totals[back], totals[-1]
    owner = np.repeat(np.arange(n), per + 1)
    at, size = sub.at(raw, begin[first], end[first])
    y_size = np.ones(len(is_end), np.int64)
    y_size[spot] = size[back]
    y_first = np.cumsum(y_size) - y_size
    y = np.full(int(y_size.sum()), sub.end, np.int64)
    y[runs(y_first[spot], y_size[spot])] = sub.ids[runs(at[back], size[back])]
    x = np.concatenate([[sub.start], y[:-1]]) if len(y) else y
    text = np.repeat(np.arange(n), np.bincount(owner, weights=y_size, minlength=n).astype(np.int64))
    x[np.flatnonzero(np.diff(text, prepend=-1))] = sub.start
    chance = np.add.reduceat(model.log_prob(x, y, text).astype(np.float64), y_first) if len(y) else np.zeros(0)
    hashes = np.empty(len(is_end), np.uint64)
    hashes[spot], hashes[is_end] = unique[back], END
    where, keys = continuations(unique[back], first_word)
    _, place = np.unique(keys, return_inverse=True)
    here, whose = spot[where], owner[spot[where]]

    def summed(others: np.ndarray | int, counts: np.ndarray, hits: np.ndarray, seen: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            by_count = np.log(counts / np.maximum(others, 1))
        out = np.logaddexp(np.log(ATTENTION) + chance, np.log1p(-ATTENTION) + by_count)
        told, n, k = here[seen > 0], seen[seen > 0], hits[seen > 0]
        out[told] = np.logaddexp(out[told] - np.log1p(n / HALF), np.log(np.maximum(k / (n + HALF), 1e-300)))
        return np.bincount(owner, weights=out, minlength=len(texts)) / np.log(10)

    if not tokens:
        scores = [np.bincount(owner, weights=chance, minlength=n) / np.log(10)] * (1 + left_out)
    else:
        known = known[:, place]
        scores = [summed(tokens, count, *known)]
    if left_out and tokens:
        rest = tokens - np.where(learn, per + 1, 0)[owner]
        hits = _elsewhere(known[0], keys, whose, learn)
        seen = _elsewhere(known[1], keys >> (np.uint64(64) - CONTEXT_BITS), whose, learn)
        scores.append(summed(rest, _elsewhere(count, hashes, owner, learn), hits, seen))
    base = np.bincount(owner, weights=np.log10((count + 1) / (tokens + distinct + 1)), minlength=n)
    return per + 1, np.bincount(owner, weights=count > 0, minlength=n).astype(np.int64), base, *scores


def score(docs: DataFrame, path: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", left_out: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, learnt) of every text, with left_out also score_left_out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), learn.alias("learn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sliced = kept(_slices(rows), "lm-slices", SLICES_A_FILE)
    ranges = min(MOST, max(FEWEST, sliced.count() // PER_RANGE))
    bits = (ranges - 1).bit_length()
    answers = kept(_answers(_asks(sliced, bits), bits), "lm-counts")
    whole = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct")).first()
    tokens, distinct = whole["tokens"], whole["distinct"]
    model = docs.sparkSession.sparkContext.broadcast(_model(kept(_windows(sliced, path, WINDOWS), "lm-windows"), Subwords(path).size, sliced, path))
    totals = answers.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("range", "wide", "totals"))).alias("parts"))  # two rows per range at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path)
        for batch in batches:
            for r in range(len(batch)):
                got = [(p["range"] >> bits, from_planes(p["totals"], "<i8" if p["wide"] else "<u4").astype(np.int64)) for p in batch["parts"][r].as_py()]
                known = [p.reshape(2, -1) for kind, p in got if kind]
                known = np.concatenate(known, axis=1) if known else np.zeros((2, 0), np.int64)
                learn = np.array(batch["learn"][r].as_py(), bool)
                n_tokens, n_known, base, *own = score_slice(batch["texts"][r].as_py(), learn, np.concatenate([p for kind, p in got if not kind]), known, tokens, distinct, sub, model.value, left_out)
                columns = [batch["doc_ids"][r].values, *map(pa.array, (n_tokens, n_known, np.full(len(base), tokens), base, own[0])), batch["learn"][r].values, *map(pa.array, own[1:])]
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "learnt", *["score_left_out"] * left_out])

    return sliced.join(totals, "slice").mapInArrow(work, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, learnt boolean" + ", score_left_out double" * left_out)
