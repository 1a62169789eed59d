"""Token ids as Arrow IPC files of fixed-size-list batches: equal-length sequences and masks, read in place.

All documents' ids follow one another in ascending id order, each document closed by an end id, cut into sequences of
one length. Each part of the id range is one file; a batch holds SEQUENCES sequences and their masks (true: a real id),
so that sequence i lies in batch i // SEQUENCES at a known offset, and a memory-mapped reader touches no other bytes.
An index table holds each document's part, file, first id and length; a document's place in the whole is its place in
the part plus the ids of the parts before.

Documents are encoded where they are read and only ids are shuffled, by part. A file has a fresh name in each attempt
of a task, and only the names in the written index count, so lost executors and repeated tasks leave no wrong file.

Cases: null is the empty text, which gives the end id alone; very long texts run over several sequences and batches;
a null document id goes first; repeated ids keep all their rows, their order being open; an empty table gives an empty
index and no file; only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

#: Ids of a sequence.
LENGTH = 2048
#: Sequences of a batch.
SEQUENCES = 256
#: Chunks in the younger half of a worker's cache; their ids are small.
CACHE = 900_000


def id_type(vocabulary_size: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary_size <= 1 << 16 else "<u4")


def part_bounds(docs: DataFrame, id_col: str, parts: int) -> list[int]:
    """Ids that cut the documents into about equal parts."""
    if parts < 2:
        return []
    found = docs.select(F.col(id_col).cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in found})


def encode(docs: DataFrame, path: str, end_id: int, bounds: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: part, id, ids as packed bytes with the end id."""

    def run(batches):
        codec = bpe.load(path)
        kind = id_type(len(codec.tokens))
        end, cut = np.array([end_id], kind).tobytes(), np.array(bounds, dtype=np.int64)

        def compute(chunks):
            return codec.encode_packed(chunks, kind)

        for batch in batches:
            text, packed = common.texts(batch, text_col), []
            for a, b in bpe.groups(text):
                for parts in bpe.values_of(codec, "ids", bpe.chunk_lists(text[a:b]), compute, CACHE):
                    parts.append(end)
                    packed.append(b"".join(parts))
            keys = batch.column(id_col).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cut, keys, "right").astype(np.int32)), batch.column(id_col), pa.array(packed, pa.binary())], ["part", id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"part int, {id_col} {docs.schema[id_col].dataType.simpleString()}, ids binary")


def write_files(encoded: DataFrame, folder: str, kind: np.dtype, id_col: str = "doc_id", length: int = LENGTH, sequences: int = SEQUENCES) -> DataFrame:
    """Writes each task's rows, sorted by id, as one file; returns id, part, file, first (of its part), n_tokens."""
    block = length * sequences
    value = pa.from_numpy_dtype(kind)
    schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])

    def run(batches):
        store, base = pafs.FileSystem.from_uri(folder)
        name, sink, writer = f"{uuid.uuid4().hex}.arrow", None, None
        held: list[np.ndarray] = []
        waiting = first = 0

        def put(flat: np.ndarray) -> None:
            rows = -(-len(flat) // length)
            ids, mask = np.zeros(rows * length, kind), np.zeros(rows * length, bool)
            ids[: len(flat)], mask[: len(flat)] = flat, True
            writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema))

        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{name}")
                writer = pa.ipc.new_file(sink, schema)
            sizes = []
            for packed in batch.column("ids"):
                flat = np.frombuffer(packed.as_buffer(), kind)
                sizes.append(len(flat))
                held.append(flat)
                waiting += len(flat)
                if waiting >= block:
                    joined = np.concatenate(held)
                    for at in range(0, waiting - block + 1, block):
                        put(joined[at : at + block])
                    held = [joined[waiting - waiting % block :].copy()]
                    waiting %= block
            held = [np.concatenate(held)] if held else []
            starts = first + np.concatenate([[0], np.cumsum(sizes)])
            first = int(starts[-1])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("part"), pa.array([name] * len(sizes), pa.string()), pa.array(starts[:-1], pa.int64()), pa.array(sizes, pa.int64())], [id_col, "part", "file", "first", "n_tokens"])
        if writer is not None:
            if waiting:
                put(np.concatenate(held))
            writer.close()
            sink.close()

    return encoded.mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, part int, file string, first long, n_tokens long")


class Reader:
    """Random access to one file's ids; batches are views of the mapped file where it is local."""

    def __init__(self, folder: str, name: str):
        store, base = pafs.FileSystem.from_uri(folder)
        path = f"{base}/{name}"
        self.file = pa.ipc.open_file(pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.last: tuple[int, np.ndarray | None] = (-1, None)
        self.block = self.length * self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def flat(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            self.last = (k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True))
        return self.last[1]

    def ids(self, first: int, n: int) -> np.ndarray:
        """The n ids from position first on."""
        pieces, end = [], first + n
        while first < end:
            k, at = divmod(first, self.block)
            piece = self.flat(k)[at : at + end - first]
            pieces.append(piece)
            first += len(piece)
        return pieces[0] if len(pieces) == 1 else np.concatenate(pieces) if pieces else np.zeros(0, np.uint16)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence i and its mask."""
        k, row = divmod(i, self.block // self.length)
        batch = self.file.get_batch(k)
        return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)


def read_digests(index: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Reads each document's ids back from the files: id, part, first, n_tokens, ids_crc32."""

    def run(batches):
        name, reader = None, None
        for batch in batches:
            crc = []
            for file, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n_tokens"))):
                if file != name:
                    name, reader = file, Reader(folder, file)
                crc.append(zlib.crc32(reader.ids(first, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("part"), batch.column("first"), batch.column("n_tokens"), pa.array(crc, pa.int64())], [id_col, "part", "first", "n_tokens", "ids_crc32"])

    return index.mapInArrow(run, f"{id_col} {index.schema[id_col].dataType.simpleString()}, part int, first long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, length: int = LENGTH, sequences: int = SEQUENCES) -> tuple[DataFrame, str]:
    """Encodes and writes all documents; returns the written index and the files' folder."""
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = parts or max(1, docs.rdd.getNumPartitions())
    bounds = part_bounds(docs, id_col, parts)
    folder = common.shared_dir(spark, "token-files")
    encoded = encode(docs, path, end_id, bounds, id_col, text_col)
    dealt = encoded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions(F.col(id_col).asc_nulls_first())
    return common.materialize(write_files(dealt, folder, id_type(len(bpe.load(path).tokens)), id_col, length, sequences), "token-index"), folder


def with_starts(read: DataFrame, index: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before: one total for each part, and so a small table."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return read.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("first"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = token_files(common.documents(spark, sf_dir), bpe.vocabulary("word_bpe_49k.json"), 1)
    return with_starts(read_digests(index, folder), index).select("doc_id", "start", "n_tokens", "ids_crc32")
