"""N-gram Jaccard join with PartEnum signatures, and the classes of its links.

A document's set holds the distinct 64-bit hashes of its WORDS-word shingles. Two sets of similarity 0.8 or more
differ in at most a ninth of the sum of their sizes. Sizes fall into bands of ratio 1.25; a pair is looked for in the
band of its larger set, so a set signs for its own band and, as the smaller partner, for the next. For a band whose
sets can differ in k elements the hash domain is cut into partitions: with more than k of them one must be equal in
both sets, so each partition's content is a signature; for k up to 3 it is cut into k + 3 parts and every choice of
three is one. Empty partitions are signed only by sets with too few others, among each other. A smaller partner needs
just as many non-empty partitions as its own size allows differences, and one more. So no pair is missed.

For k above 3 subsets of one partition are enumerated, of about 1.06 k + 4 partitions: subsets of two of fewer
partitions would be more signatures a set than one of these.

Equal sets count as one throughout (64-bit digest of the set). Signatures travel in blocks per hash bucket, without
repetitions within a slice of text; a bucket sorts its signatures, gives every pair of a small group, and for a large
one the pairs with its first member and the list of members. A bucket that outgrows MOST_IN_BUCKET signatures (one
signature of very many sets) is passed on and grouped by Spark's own aggregation, its groups as rows, never as one
list. Two exact tests precede the full one: the sizes, and parity sketches (a bit per hash bucket, the parity of its
shingles; two sets differ in at least as many shingles as their sketches in bits). A Scheme can bring other signatures,
and a sketch to test before. Each set's most frequent pair is
verified first on the full sets, then what still spans two of the classes known; a verification counts 40 bits of
each shingle hash, and pairs that come within a few shingles of the limit are counted again on all 64. Where a large
group holds members of several classes after that, its members are compared by sketch in blocks of bounded size,
those of its largest class only with the others: a first round takes from each comparison only pairs that would join
its classes, a forest, and verifies those; the last one takes every pair whose classes still differ. Links' classes
come from label propagation with pointer jumping, in tables; nothing about documents is gathered on the driver.

classes() verifies only the links that its classes need; links() verifies and counts all of them, class by class.

A row is known by the 64-bit hash of its id and text, so ids that are null or repeat lose nothing. Null and empty
texts have no set, are linked with nothing and form their own class. Fewer words than WORDS make one shingle of all.
Repeated rows share a class. A class whose rows all have null ids has a null component_id. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices
from .words import joined, mix, per_text, words

#: Words of a shingle; similarity as a fraction (80 / 100).
WORDS, PERCENT = 5, 80
#: Bytes of text a task handles at once; signatures a bucket should hold, about; the fewest buckets.
SLICE, PER_BUCKET, FEWEST = 1 << 20, 1_000_000, 64
#: Signatures that a task holds of one bucket at most.
MOST_IN_BUCKET = 3_000_000
#: Members up to which a signature's group gives all its pairs.
SMALL_GROUP = 4
#: Members of a large group that a task compares with as many others, about.
BLOCK = 1_024
#: Sets of a block of links(), about, and how many shingles are compared at once there.
LINK_BLOCK, COLUMNS = 256, 4_096
#: Bytes of a shingle hash in the first count of a pair; shingles from the limit within which all eight bytes are counted.
SHORT, UNSURE = 5, 2
#: Rows up to which the ids of candidate sets are broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, starts = joined(texts)
    begin, _, h = words(raw)
    first = per_text(starts, begin)
    if len(h) >= n:
        rolled = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            rolled += h[i : len(h) - n + 1 + i] * _FACTORS[i]
        rolled = mix(rolled)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(rolled[a : z - n + 1]))
        elif z > a:
            out.append(mix((h[a:z] * _FACTORS[: z - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def bands(largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest size of each band, one beyond `largest`."""
    low, high = [1], [1]
    while low[-1] <= largest:
        low.append(high[-1] + 1)
        high.append(low[-1] * 100 // PERCENT)
    return np.array(low, np.int64), np.array(high, np.int64)


def _mark(band: np.ndarray | int, part: np.ndarray | int) -> np.ndarray:
    return mix(np.asarray(band, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(part, np.uint64) + np.uint64(1))


def _few(s: np.ndarray, band: int, k: int) -> np.ndarray:
    """Signatures of a small set: the contents of every three of k + 3 parts."""
    part = ((s >> np.uint64(32)) * np.uint64(k + 3)) >> np.uint64(32)
    chosen = [np.isin(part, c) for c in combinations(range(k + 3), 3)]
    content = np.array([mix(s[c]).sum(dtype=np.uint64) + np.uint64(c.sum()) for c in chosen], np.uint64)
    return mix(content ^ _mark(band, np.arange(len(chosen)) + (1 << 20)))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every set's signatures: (index of the set, signature)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, high = bands(int(sizes.max()))
    own_band = np.searchsorted(low, np.maximum(sizes, 1), "right") - 1
    flat = np.concatenate(sets)
    first = np.cumsum(sizes) - sizes
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat), dtype=np.uint64)])
    half = flat >> np.uint64(32)
    whose, found = [], []
    for step in (0, 1):  # as the larger partner, then as the smaller one
        band = own_band + step
        differ = 2 * high[band] * (100 - PERCENT) // (100 + PERCENT)
        at_most = np.minimum(differ, sizes * (100 - PERCENT) // PERCENT)  # differences to any partner
        takes_part = (differ > 0) & (sizes > 0) & ((step == 0) | (sizes * 100 // PERCENT >= low[band]))
        for i in np.flatnonzero(takes_part & (differ <= 3)):
            got = _few(sets[i], int(band[i]), int(differ[i]))
            whose.append(np.full(len(got), i))
            found.append(got)
        large = np.flatnonzero(takes_part & (differ > 3))
        if not len(large):
            continue
        parts = (106 * (differ + 1) + 99) // 100 + 3
        mine = np.repeat(np.arange(len(large)), sizes[large])
        at = np.repeat(first[large] - (np.cumsum(sizes[large]) - sizes[large]), sizes[large]) + np.arange(len(mine))
        # shingles are sorted, so a partition (a range of hashes) is a run
        part = (half[at] * parts[large][mine].astype(np.uint64)) >> np.uint64(32)
        edge = np.flatnonzero((np.diff(mine, prepend=-1) != 0) | (np.diff(part.astype(np.int64), prepend=-1) != 0))
        stop = np.append(edge[1:], len(mine))
        content = mixed[at[stop - 1] + 1] - mixed[at[edge]] + (stop - edge).astype(np.uint64)
        doc = mine[edge]
        sig = mix(content ^ _mark(band[large][doc], part[edge]))
        filled = np.bincount(doc, minlength=len(large))
        place = np.arange(len(doc)) - (np.cumsum(filled) - filled)[doc]
        enough = at_most[large] + 1
        keep = np.ones(len(doc), bool) if step == 0 else place < enough[doc]
        whose.append(large[doc[keep]])
        found.append(sig[keep])
        for j in np.flatnonzero(filled < enough):  # too few filled partitions: the empty ones count too
            empty = np.setdiff1d(np.arange(parts[large[j]]), part[edge][doc == j].astype(np.int64))
            whose.append(np.full(len(empty), large[j]))
            found.append(mix(_mark(int(band[large[j]]), empty) ^ np.uint64(0xE0)))
    if not whose:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(whose), np.concatenate(found)


@dataclass(frozen=True)
class Scheme:
    """How pairs are found: words of a shingle, similarity in percent, and the signatures of sets, of which each linked pair shares one.

    odd: another sketch of a set, of odd_bytes bytes, which in linked sets differs in most_odd bits at most; it is tested before the parities."""

    words: int
    percent: int
    signatures: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]
    odd: Callable[[np.ndarray], bytes] | None = None
    odd_bytes: int = 0
    most_odd: int = 0

    def sketch(self, s: np.ndarray) -> bytes:
        return (self.odd(s) if self.odd else b"") + parity(s)


PARTENUM = Scheme(WORDS, PERCENT, signatures)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, text): rows of one key are equal rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")


def _members(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, row_key, n_shingles, set_id); no set: null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=SLICE):
                sets = shingle_sets(b["text"].to_pylist(), scheme.words)
                ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
                yield pa.record_batch([b["doc_id"], b["row_key"], pa.array([len(s) for s in sets], pa.int64()), ids], ["doc_id", "row_key", "n_shingles", "set_id"])

    return docs.mapInArrow(work, "doc_id long, row_key long, n_shingles long, set_id long")


def _blocks(docs: DataFrame, buckets: int, scheme: Scheme = PARTENUM) -> DataFrame:
    """(bucket, sigs, ids): six bytes per signature, eight per set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch.select(["text"]), limit=SLICE):
                different = {set_id(s): s for s in shingle_sets(b["text"].to_pylist(), scheme.words) if len(s)}
                whose, sig = scheme.signatures(list(different.values()))
                if not len(sig):
                    continue
                ids = np.array(list(different), np.int64)[whose]
                bucket = ((sig & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                stops = np.append(edges[1:], len(order))
                short = np.ascontiguousarray(sig[order].view(np.uint8).reshape(-1, 8)[:, 2:])
                ids = ids[order]
                rows = [(int(bucket[order[a]]), short[a:z].tobytes(), ids[a:z].tobytes()) for a, z in zip(edges, stops, strict=True)]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "sigs", "ids"])

    return docs.mapInArrow(work, "bucket int, sigs binary, ids binary")


def _widen(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, 8 - width :] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


CANDIDATES = "a long, b long, n long, members binary, sigs binary, ids binary"


def _grouped(sigs: list[bytes], ids_of: list[bytes]) -> pa.RecordBatch:
    """The candidates of one bucket's signatures."""
    sig = np.concatenate([_widen(x, 6) for x in sigs])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in ids_of])
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
    sig, ids = sig[keep], ids[keep]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    size = np.diff(np.append(start, len(sig)))
    left, right, firsts, members = [], [], [], []
    for m in range(2, SMALL_GROUP + 1):
        at = start[size == m]
        for i, j in combinations(range(m), 2):
            left.append(ids[at + i])
            right.append(ids[at + j])
    for a, m in zip(start[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist(), strict=True):
        left.append(np.full(m - 1, ids[a]))
        right.append(ids[a + 1 : a + m])
        firsts.append(int(ids[a]))
        members.append(ids[a : a + m].tobytes())
    both = np.stack([np.concatenate(left), np.concatenate(right)], axis=1) if left else np.zeros((0, 2), np.int64)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    edge = np.flatnonzero(np.concatenate([[True], (both[1:] != both[:-1]).any(1)])) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(both)))
    groups = dict(zip(members, firsts, strict=True))
    n = len(groups)
    nothing = pa.nulls(len(edge) + n, pa.binary())
    columns = [
        pa.array(np.concatenate([both[edge, 0], np.array(list(groups.values()), np.int64)])),
        pa.array(np.concatenate([both[edge, 1], np.zeros(n, np.int64)])),
        pa.array(np.concatenate([count, np.zeros(n, np.int64)])),
        pa.array([None] * len(edge) + list(groups), pa.binary()),
        nothing,
        nothing,
    ]
    return pa.record_batch(columns, ["a", "b", "n", "members", "sigs", "ids"])


def _candidates(blocks: DataFrame, most: int) -> DataFrame:
    """Rows (a, b, n): pairs a < b that share n signatures of a bucket; rows with `members`: large groups, a their first; rows with `sigs`: blocks of buckets with more than `most` signatures."""

    def raw(sigs: list[bytes], ids: list[bytes]) -> pa.RecordBatch:
        none = pa.nulls(len(sigs), pa.int64())
        return pa.record_batch([none, none, none, pa.nulls(len(sigs), pa.binary()), pa.array(sigs, pa.binary()), pa.array(ids, pa.binary())], ["a", "b", "n", "members", "sigs", "ids"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sigs, ids = None, 0, [], []
        for batch in batches:
            for bucket, s, i in zip(batch["bucket"].to_pylist(), batch["sigs"], batch["ids"], strict=True):
                if bucket != now:
                    if sigs:
                        yield _grouped(sigs, ids) if held <= most else raw(sigs, ids)
                    now, held, sigs, ids = bucket, 0, [], []
                sigs.append(s.as_py())
                ids.append(i.as_py())
                held += len(ids[-1]) // 8
                if held > most:  # pass on what is held of an overgrown bucket, and all that follows
                    yield raw(sigs, ids)
                    sigs, ids = [], []
        if sigs:
            yield _grouped(sigs, ids) if held <= most else raw(sigs, ids)

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, CANDIDATES)


def _overgrown(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the blocks of overgrown buckets: pairs (a, b, n) with each group's first member, and groups as rows (group, id, first)."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, i in zip(b["sigs"], b["ids"], strict=True):
                yield pa.record_batch([pa.array(_widen(s.as_py(), 6).view(np.int64)), pa.array(np.frombuffer(i.as_py(), np.int64))], ["group", "id"])

    rows = kept(found.where("sigs is not null").select("sigs", "ids").mapInArrow(single, "group long, id long").distinct(), "jaccard-overgrown")
    firsts = rows.groupBy("group").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    rows = rows.join(firsts, "group")
    return rows.where("id != first").groupBy(F.col("first").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("n")), rows


def _sized_join(big: DataFrame, small: DataFrame, n: int, on: str) -> DataFrame:
    """Inner join that broadcasts the side of n rows while it is small."""
    return big.join(F.broadcast(small) if n <= MOST_BROADCAST else small, on)


def parity(s: np.ndarray) -> bytes:
    """A bit per bucket of the hashes' low bits: whether it holds an odd number; two to four times as many buckets as hashes."""
    size = 1 << max(7, int(len(s) - 1).bit_length() + 1)
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch with fewer buckets, as bytes."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _sets(docs: DataFrame, wanted: DataFrame, width: int, scheme: Scheme) -> DataFrame:
    """(set_id, size, sketch, hashes) of each wanted set (set_id, row_key), from one of its rows; `width` bytes per shingle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, limit=SLICE):
                sets = shingle_sets(b["text"].to_pylist(), scheme.words)
                first: dict[int, int] = {}  # equal rows, and another text with the key of a wanted one
                for i, (s, wanted_id) in enumerate(zip(sets, b["set_id"].to_pylist(), strict=True)):
                    if len(s) and wanted_id not in first and set_id(s) == wanted_id:
                        first[wanted_id] = i
                same = list(first.values())
                sets, b = [sets[i] for i in same], b.take(pa.array(same, pa.int64()))
                data = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, 8 - width :]).tobytes() for s in sets]
                columns = [b["set_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(map(scheme.sketch, sets), pa.binary()), pa.array(data, pa.binary())]
                yield pa.record_batch(columns, ["set_id", "size", "sketch", "hashes"])

    n = wanted.count()
    got = kept(_sized_join(docs, wanted, n, "row_key").select("set_id", "text").mapInArrow(work, "set_id long, size long, sketch binary, hashes binary"), "jaccard-shingles")
    return got if got.count() == n else got.dropDuplicates(["set_id"])  # more only where equal rows repeat


def _both(pairs: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    """pairs (a, b) with size and `what` of either."""
    for c in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("set_id").alias(c), F.col("size").alias(f"{c}_size"), F.col(what).alias(f"{c}_{what}")), c)
    return pairs


def most_apart(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """In how many shingles linked sets of these sizes differ at most; -1 if their sizes forbid a link."""
    apart = (n + m) * (100 - percent) // (100 + percent)
    return np.where(np.minimum(n, m) * 100 >= np.maximum(n, m) * percent, apart, -1)


def _possible(pairs: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs that sizes and sketches allow, with their other columns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = most_apart(batch["a_size"].to_numpy(), batch["b_size"].to_numpy(), scheme.percent)
            ok = most >= 0
            for i in np.flatnonzero(ok).tolist():
                x, y = (np.frombuffer(batch[c][i].as_py(), np.uint8) for c in ("a_sketch", "b_sketch"))
                if scheme.odd_bytes:
                    ok[i] = int(np.bitwise_count(x[: scheme.odd_bytes] ^ y[: scheme.odd_bytes]).sum()) <= scheme.most_odd
                    x, y = x[scheme.odd_bytes :], y[scheme.odd_bytes :]
                size = min(len(x), len(y))
                ok[i] = ok[i] and int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= most[i]
            yield batch.select(["a", "b", "n"]).filter(pa.array(ok))

    return _both(pairs, sets, "sketch").select("a", "b", "n", "a_size", "b_size", "a_sketch", "b_sketch").mapInArrow(work, "a long, b long, n long")


def in_common(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many hashes two sorted arrays share, and how many repeat within either."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    equal = int((both[1:] == both[:-1]).sum())
    repeats = int((a[1:] == a[:-1]).sum() + (b[1:] == b[:-1]).sum())
    return equal - repeats, repeats


def _compare(pairs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, sure, linked) of each pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure, linked = [], []
            for x, y, n, m in zip(batch["a_hashes"], batch["b_hashes"], batch["a_size"].to_pylist(), batch["b_size"].to_pylist(), strict=True):
                common, repeats = in_common(_widen(x.as_py(), width), _widen(y.as_py(), width))
                least = -(-percent * (n + m) // (100 + percent))  # links share so many at least
                linked.append(common >= least)
                sure.append(width == 8 or abs(common - least) > UNSURE + repeats)
            yield pa.record_batch([batch["a"], batch["b"], pa.array(sure, pa.bool_()), pa.array(linked, pa.bool_())], ["a", "b", "sure", "linked"])

    return _both(pairs.select("a", "b"), sets, "hashes").select("a", "b", "a_size", "b_size", "a_hashes", "b_hashes").mapInArrow(work, "a long, b long, sure boolean, linked boolean")


def _verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) that link. Hashes lose their last bytes first; where that can decide a pair, all bytes are fetched from its texts."""
    first = kept(_compare(pairs, sets, SHORT, scheme.percent), "jaccard-links")
    links = first.where("sure and linked").select("a", "b")
    close = first.where("not sure").select("a", "b")
    if close.isEmpty():
        return links
    wanted = kept(reps.join(close.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "set_id"), "jaccard-wanted")
    again = kept(_compare(close, _sets(docs, wanted, 8, scheme), 8, scheme.percent), "jaccard-links")
    return links.union(again.where("linked").select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(id, label): each linked id with the smallest id of its class."""
    edges = kept(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = kept(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        above = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        new = kept(lower.join(above, "label").select("id", "old", F.least("label", "above").alias("label")), "labels")
        labels = new.select("id", "label")
        if new.where("old != label").isEmpty():
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = PARTENUM) -> DataFrame:
    """(doc_id, row_key, n_shingles, set_id, label, component_id): a name of each row's class (null without a set), and the smallest doc_id in it."""
    rows = _keyed(docs, id_col, text_col)
    members = kept(_members(rows, scheme), "jaccard-members")
    total = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(FEWEST, int(total) // 2 // PER_BUCKET)
    found = kept(_candidates(_blocks(rows, buckets, scheme), MOST_IN_BUCKET), "jaccard-candidates")
    reps = kept(members.where("set_id is not null").groupBy("set_id").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("doc_id")), "jaccard-sets")
    of_set = reps.select("set_id", "row_key")
    pairs = found.where("members is null and sigs is null").select("a", "b", "n")
    wide = None
    if not found.where("sigs is not null").isEmpty():
        more, wide = _overgrown(found)
        pairs, wide = pairs.union(more), kept(wide, "jaccard-overgrown-groups")
    pairs = kept(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "jaccard-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    sets = _sets(rows, kept(of_set.join(wanted, "set_id"), "jaccard-wanted"), SHORT, scheme)
    possible = kept(_possible(pairs, sets, scheme), "jaccard-possible")
    best = possible.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
    early = kept(_verify(best, sets, rows, of_set, scheme), "jaccard-early")
    parent = early.select(F.col("b").alias("id"), F.col("a").alias("label"))

    def label(df: DataFrame, col: str) -> DataFrame:
        up = parent.select(F.col("id").alias(col), F.col("label").alias("up"))
        up2 = parent.select(F.col("id").alias(f"{col}_top"), F.col("label").alias("up2"))
        one = df.join(up, col, "left").withColumn(f"{col}_top", F.coalesce("up", col)).drop("up")
        return one.join(up2, f"{col}_top", "left").withColumn(f"{col}_top", F.coalesce("up2", f"{col}_top")).drop("up2")

    rest = label(label(possible.join(best, ["a", "b"], "left_anti"), "a"), "b").where("a_top != b_top").select("a", "b")
    links = early.union(_verify(kept(rest, "jaccard-rest"), sets, rows, of_set, scheme))
    label_of = components(links)
    # large groups whose first member missed someone of another class
    missed = _classes_of(pairs.select("a", "b"), label_of).where("a_label != b_label").select("a").distinct()
    groups = found.where("members is not null").select("a", "members").join(missed, "a", "left_semi").select("members").distinct()
    open_groups = _group_rows(groups)
    if wide is not None:
        open_groups = open_groups.union(wide.join(missed.withColumnRenamed("a", "first"), "first", "left_semi").select("group", "id"))
    open_groups = kept(open_groups, "jaccard-groups")
    if not open_groups.isEmpty():
        for forest in (True, False):
            more = kept(_verify(kept(_within(open_groups, label_of, sets, forest, scheme), "jaccard-rest"), sets, rows, of_set, scheme), "jaccard-more")
            if not more.isEmpty():
                links = links.union(more)
                label_of = components(links)
    least = reps.join(label_of.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    smallest = least.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    table = least.join(smallest, "label").select("set_id", "label", "component_id")
    return members.join(table, "set_id", "left").select("doc_id", "row_key", "n_shingles", "set_id", "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def _group_rows(groups: DataFrame) -> DataFrame:
    """(group, id) of each member of a group."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b["members"].to_pylist():
                ids = np.frombuffer(x, np.int64)
                key = int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
                yield pa.record_batch([pa.array(np.full(len(ids), key)), pa.array(ids)], ["group", "id"])

    return groups.mapInArrow(members, "group long, id long")


def _within(groups: DataFrame, label_of: DataFrame, sets: DataFrame, forest: bool, scheme: Scheme) -> DataFrame:
    """Distinct pairs (a, b) of members of a group that sizes and sketches allow and whose classes differ.

    forest: of these, no more pairs from a comparison than join its classes, were they all links. The members of a group's
    largest class and the others are cut into blocks of about BLOCK members each by hash; a task compares two blocks, of
    which one at least is of the others, so a member of the largest class is sent only where something can differ."""
    rows = groups.join(label_of, "id", "left").withColumn("label", F.coalesce("label", "id"))
    per = rows.groupBy("group", "label").agg(F.count("*").alias("n"))
    split = per.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n")).where("n_top < n")
    split = kept(split.select("group", "top", F.ceil((F.col("n") - F.col("n_top")) / BLOCK).alias("few"), F.ceil(F.col("n_top") / BLOCK).alias("many")), "jaccard-split")
    rows = _sized_join(rows, split, split.count(), "group").join(sets.select(F.col("set_id").alias("id"), "size", "sketch"), "id")
    in_top, key = F.col("label") == F.col("top"), F.xxhash64("id")
    rows = rows.withColumn("own", F.when(in_top, F.col("few") + F.pmod(key, F.col("many"))).otherwise(F.pmod(key, F.col("few"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(in_top, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        ids, size, label, own = (group[c].to_numpy() for c in ("id", "size", "label", "own"))
        raw = [np.frombuffer(x, np.uint8) for x in group["sketch"].to_pylist()]
        odd, raw = np.stack([x[: scheme.odd_bytes] for x in raw]), [x[scheme.odd_bytes :] for x in raw]
        width = min(map(len, raw))
        bits = np.stack([_folded(x, width) for x in raw])
        same_block = key[1].as_py() == key[2].as_py()
        root = label.copy()
        left, right = [], []
        for i in range(len(ids)):
            near = np.flatnonzero((root != root[i]) & (ids > ids[i]) & (same_block | (own != own[i])))
            most = most_apart(size[i], size[near], scheme.percent)
            near, most = near[most >= 0], most[most >= 0]
            if scheme.odd_bytes:
                few = np.bitwise_count(odd[near] ^ odd[i]).sum(1, dtype=np.int64) <= scheme.most_odd
                near, most = near[few], most[few]
            near = near[np.bitwise_count(bits[near] ^ bits[i]).sum(1, dtype=np.int64) <= most]
            if forest and len(near):
                roots, at = np.unique(root[near], return_index=True)
                near = near[at]
                root[np.isin(root, roots)] = root[i]
            left.append(np.full(len(near), ids[i]))
            right.append(ids[near])
        return pa.table([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    keyed = rows.select("group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "size", "label", "own", "sketch")
    return keyed.groupBy("group", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def _classes_of(pairs: DataFrame, label_of: DataFrame) -> DataFrame:
    """pairs with a_label and b_label; an id without links is its own class."""
    for c in ("a", "b"):
        pairs = pairs.join(label_of.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")), c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
    return pairs


def _links_in(ids: np.ndarray, copies: np.ndarray, own: np.ndarray, hashes: list[np.ndarray], within: bool) -> np.ndarray:
    """Of each set, the copies of the other sets that it links to; within: else only of those in the other block."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    whose = np.repeat(np.arange(len(ids)), sizes)
    _, column, seen = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    number = np.cumsum(seen > 1) - 1
    whose, column = whose[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    whose, column = whose[order], column[order]
    common = np.zeros((len(ids), len(ids)), np.float32)  # whole numbers below 2**24
    for at in range(0, int((seen > 1).sum()), COLUMNS):
        a, z = np.searchsorted(column, (at, at + COLUMNS))
        holds = np.zeros((len(ids), min(COLUMNS, int(column[z - 1]) - at + 1)), np.float32)
        holds[whose[a:z], column[a:z] - at] = 1
        common += holds @ holds.T
    both = common.astype(np.int64)
    linked = 100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, False)
    if not within:
        linked &= own[:, None] != own[None, :]
    return linked @ copies


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): the number of other rows that each row links to, all of them verified.

    A link joins two rows of a class, so every two different sets of a class are compared on their full sets, equal ones being linked anyway. A class of more than LINK_BLOCK sets is cut into blocks by hash of the set, and a task compares two blocks; smaller classes share tasks."""
    rows = _keyed(docs, id_col, text_col)
    found = kept(classes(rows), "links-classes")
    of = kept(found.where("set_id is not null").groupBy("set_id").agg(F.min("label").alias("label"), F.min("row_key").alias("row_key"), F.count("*").alias("copies")), "links-sets")
    classes_of_many = kept(of.groupBy("label").agg(F.count("*").alias("m")).where("m > 1"), "links-labels")
    large = F.broadcast(classes_of_many.where(F.col("m") > LINK_BLOCK))  # one for LINK_BLOCK sets at most
    small = classes_of_many.where(F.col("m") <= LINK_BLOCK)
    n_small = small.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    n_buckets = max(1, n_small // (2 * LINK_BLOCK))
    zero = F.lit(0).cast("long")
    blocks = F.ceil(F.col("m") / LINK_BLOCK)
    in_large = of.join(large, "label").withColumn("own", F.pmod(F.xxhash64("set_id"), blocks)).withColumn("other", F.explode(F.sequence(zero, blocks - 1)))
    in_large = in_large.select("set_id", "row_key", "label", "copies", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("label").alias("cell"))
    in_small = _sized_join(of.join(large, "label", "left_anti"), small, n_small, "label")
    in_small = in_small.select("set_id", "row_key", "label", "copies", zero.alias("own"), zero.alias("x"), zero.alias("y"), F.pmod(F.xxhash64("label"), F.lit(n_buckets)).alias("cell"))
    placed = kept(in_large.union(in_small), "links-places")
    hashes = _sets(rows, kept(placed.select("row_key", "set_id").distinct(), "links-wanted"), 8, PARTENUM).select("set_id", "hashes")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        label, ids = group["label"].to_numpy(), group["set_id"].to_numpy()
        order = np.lexsort((ids, label))
        order = order[np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(label[order]) != 0)])]  # a set of repeated rows comes more than once
        label, ids = label[order], ids[order]
        copies, own = group["copies"].to_numpy()[order], group["own"].to_numpy()[order]
        raw = group["hashes"].take(pa.array(order))
        edge = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        n = np.zeros(len(ids), np.int64)
        for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True):
            if z - a > 1:
                n[a:z] = _links_in(ids[a:z], copies[a:z], own[a:z], [_widen(x.as_py(), 8) for x in raw[a:z]], key[1].as_py() == key[2].as_py())
        return pa.table([pa.array(ids), pa.array(n)], ["set_id", "n"])

    counted = placed.drop("row_key").join(hashes, "set_id").groupBy("cell", "x", "y").applyInArrow(compare, "set_id long, n long")
    others = kept(counted.groupBy("set_id").agg(F.sum("n").alias("n")).where("n > 0"), "links-counted")
    copies = found.where("set_id is not null").groupBy("set_id").agg((F.count("*") - 1).alias("equal"))
    of_set = kept(copies.join(others, "set_id", "left").select("set_id", (F.col("equal") + F.coalesce("n", F.lit(0))).alias("n_links")).where("n_links > 0"), "links-of-sets")
    return found.join(of_set, "set_id", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) less all but one of each class: that of the smallest doc_id (nulls last), then of the smallest hash of id and text; of equal rows (doc_id and text) one stays."""
    found = kept(classes(docs), "jaccard-classes")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = found.where("label is not null").groupBy("label").agg(F.min(rank).alias("first"))
    gone = kept(found.join(first, "label").where(F.col("row_key") != F.col("first.row_key")).select("row_key").distinct(), "jaccard-gone")
    keyed = docs.withColumn("_row_key", F.xxhash64("doc_id", "text"))

    def without(df: DataFrame, keys: DataFrame, n: int, how: str) -> DataFrame:
        keys = keys.select(F.col("row_key").alias("_row_key"))
        return df.join(F.broadcast(keys) if n <= MOST_BROADCAST else keys, "_row_key", how)

    rest = without(keyed, gone, gone.count(), "left_anti")
    again = kept(found.where("label is not null").groupBy("row_key").count().where("count > 1").select("row_key"), "jaccard-repeated")
    m = again.count()
    if not m:
        return rest.select(docs.columns)
    return without(rest, again, m, "left_anti").select(docs.columns).union(without(rest, again, m, "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns))
