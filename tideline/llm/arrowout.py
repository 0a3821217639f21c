"""Token ids in Arrow stream files of fixed-size lists.

Documents are dealt by ranges of doc_id, each task encodes its range in ascending order and writes two stream files
to the shared folder: the sequences (`ids` and `mask`, fixed-size lists; every record batch but the last holds the
same number of equal-length sequences, so any sequence lies at a computable place of a memory map) and the documents
(doc_id, start, n_tokens within the shard). Each document ends with an end id; a shard's last sequence is padded and
its mask is false there. A task begins a new shard after SHARD ids, at a document's end, so a file's size doesn't grow with the
input (but for a single longer document); shards are numbered in order. Files appear under their final name only when whole, and a task that runs again writes the
same bytes, so a lost executor costs its tasks alone.

Null texts count as empty (their end id remains). Equal doc_ids, and null ones, which come first, are ordered by a
hash of the text. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, shared_dir, slices
from .tokens import ROOMY, encoder

#: Ids in a sequence, and sequences in a record batch.
SEQUENCE, BATCH = 1024, 256
#: Ids of a shard, about; shards of a task at most.
SHARD, SHARDS = 1 << 26, 1 << 20


def stream_schema(vocabulary: int, sequence: int = SEQUENCE) -> pa.Schema:
    """Ids take 16 bits where the vocabulary allows."""
    width = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(width, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _Shard:
    """The two stream files of one task; they get their names in close()."""

    def __init__(self, folder: str, shard: int, schema: pa.Schema) -> None:
        self.store, root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(root, recursive=True)
        self.schema, self.sequence = schema, schema.field("ids").type.list_size
        self.names = [f"{root}/{kind}-{shard:014d}.arrows" for kind in ("sequences", "documents")]
        self.drafts = [f"{n}.{uuid.uuid4().hex}" for n in self.names]
        self.files = [self.store.open_output_stream(d) for d in self.drafts]
        self.out = [pa.ipc.new_stream(f, s) for f, s in zip(self.files, (schema, DOCUMENTS), strict=True)]
        self.rest = np.zeros(0, schema.field("ids").type.value_type.to_pandas_dtype())
        self.total = 0

    def _write(self, ids: np.ndarray, valid: int) -> None:
        mask = pa.array(np.arange(len(ids)) < valid)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.sequence) for x in (pa.array(ids), mask)]
        self.out[0].write_batch(pa.record_batch(lists, schema=self.schema))

    def add(self, doc_ids: pa.Array, flat: np.ndarray, counts: np.ndarray) -> None:
        starts = self.total + np.cumsum(counts) - counts
        self.out[1].write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(counts)], schema=DOCUMENTS))
        self.total += len(flat)
        self.rest = np.concatenate([self.rest, flat.astype(self.rest.dtype)])
        step = BATCH * self.sequence
        whole = len(self.rest) // step * step
        for at in range(0, whole, step):
            self._write(self.rest[at : at + step], step)
        self.rest = self.rest[whole:]

    def close(self) -> None:
        if valid := len(self.rest):
            self._write(np.pad(self.rest, (0, -valid % self.sequence)), valid)
        for x in [*self.out, *self.files]:
            x.close()
        for draft, name in zip(self.drafts, self.names, strict=True):
            if self.store.get_file_info(name).type != fs.FileType.NotFound:
                self.store.delete_file(name)
            self.store.move(draft, name)


def write_streams(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents below `folder`; returns a row per shard: shard, n_documents, n_tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, n = TaskContext.get().partitionId() * SHARDS, None, 0
        enc = encoder(path)
        for batch in batches:
            for b in slices(batch, limit=ROOMY[0]):
                out = out or _Shard(folder, shard, stream_schema(enc.tokenizer.get_vocab_size()))
                flat, counts = enc.encode(b["text"])
                out.add(b["doc_id"], np.insert(flat, np.cumsum(counts), end_id), counts + 1)
                n += len(b)
                if out.total >= SHARD:
                    out.close()
                    yield pa.record_batch([pa.array([shard]), pa.array([n]), pa.array([out.total])], ["shard", "n_documents", "n_tokens"])
                    shard, out, n = shard + 1, None, 0
        if out:
            out.close()
            yield pa.record_batch([pa.array([shard]), pa.array([n]), pa.array([out.total])], ["shard", "n_documents", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(rows.rdd.getNumPartitions(), *order).sortWithinPartitions(*order)
    return kept(dealt.mapInArrow(work, "shard long, n_documents long, n_tokens long"), "arrow-manifest")


class SequenceFile:
    """Random access to one shard's sequences and masks; on a local disk nothing is copied."""

    def __init__(self, folder: str, shard: int) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        local = isinstance(store, fs.LocalFileSystem)
        opened = [(pa.memory_map(n) if local else store.open_input_file(n)) for n in (f"{root}/{kind}-{shard:014d}.arrows" for kind in ("sequences", "documents"))]
        self.batches = list(pa.ipc.open_stream(opened[0]))
        self.documents = pa.ipc.open_stream(opened[1])
        self.flat = [b["ids"].flatten().to_numpy() for b in self.batches]
        self.size = self.batches[0].schema.field("ids").type.list_size
        self.per_batch = len(self.batches[0])

    def sequence(self, i: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of sequence i."""
        batch = self.batches[i // self.per_batch]
        return batch["ids"][i % self.per_batch].values, batch["mask"][i % self.per_batch].values

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, a view of each batch that holds some."""
        step = self.per_batch * self.size
        while n:
            b, at = divmod(start, step)
            view = self.flat[b][at : at + n]
            yield view
            start, n = start + len(view), n - len(view)


def read_streams(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, from the files; start counts all ids before it."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", before.alias("before"))  # a row for each file

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = SequenceFile(folder, shard)
                for docs in file.documents:
                    sums = []
                    for start, n in zip(docs["start"].to_pylist(), docs["n_tokens"].to_pylist(), strict=True):
                        crc = 0
                        for view in file.tokens(start, n):
                            crc = zlib.crc32(view.astype("<u4"), crc)
                        sums.append(crc)
                    starts = np.asarray(docs["start"]) + base
                    yield pa.record_batch([docs["doc_id"], pa.array(starts), docs["n_tokens"], pa.array(sums, pa.int64()), pa.array(np.full(len(docs), shard))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    n = max(1, manifest.count())
    return shards.repartition(n, "shard").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def round_trip(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    folder = folder or shared_dir(docs.sparkSession, "arrow-streams")
    return read_streams(write_streams(docs, path, folder, end_id), folder)
