"""Token-ID output: Arrow files of equal-length sequences and masks, for zero-copy random access.

A folder holds, for each shard, ``NNNNN.arrow`` and ``NNNNN.index.arrow``. The first is an Arrow IPC file whose record
batches have two fixed-size lists, ``input_ids`` (uint16 where the vocabulary has room in it, else uint32) and ``mask``
(bits, 0 for padding): the shard's ids one after another, cut into sequences of ``length``, the last one padded. Being of
fixed size and not compressed, sequence k is a slice of the mapped file, which ``Shard`` gives without a copy. The index has doc_id, start (the shard's ids before the document) and n_tokens. Shards are ranges
of doc_id in ascending order, and a document lies in one shard.

Null texts are empty, so a document has its end id at least. Rows with equal ids all stay, in no set order among themselves;
null ids come first. Of further columns nothing is read. No document: no file.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radquery.llm.shared import AtomicFile, files_for, new_dir, open_mapped, write_table
from radquery.llm.token_ids import encoding
from radquery.llm.words import slices

MANIFEST = "shard long, documents long, tokens long, path string"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
ROWS_PER_BATCH = 64
#: Text that is encoded at once.
SLICE_BYTES = 8 << 20


def _sequences(ids: np.ndarray, valid: int, length: int, schema: pa.Schema) -> pa.RecordBatch:
    values = pa.array(ids.astype(schema.field(0).type.value_type.to_pandas_dtype())), pa.array(np.arange(len(ids)) < valid)
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(x, length) for x in values], schema=schema)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, length: int = 2048, shards: int | None = None) -> DataFrame:
    """Writes the files and returns a manifest row for each shard; an action on it does the work, once. Without ``shards`` their
    number follows the bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0 if shards is None else 0
    shards = shards or files_for(size)
    with encoding(tokenizer) as encoder:
        narrow = max(encoder.largest_id, end_id) < 1 << 16
    types = {"input_ids": pa.uint16() if narrow else pa.uint32(), "mask": pa.bool_()}
    schema = pa.schema([pa.field(n, pa.list_(pa.field("item", t, False), length), False) for n, t in types.items()])

    def write(batches):
        shard, block = TaskContext.get().partitionId(), ROWS_PER_BATCH * length
        path, documents, total = f"{folder}/{shard:05d}", 0, 0
        carry, buffered = [], 0
        first = next(batches, None)
        if first is None:
            return
        with encoding(tokenizer) as encoder, AtomicFile(f"{path}.index.arrow") as index, ipc.new_file(index, INDEX) as entries, AtomicFile(f"{path}.arrow") as out, ipc.new_file(out, schema) as writer:
            for part in (p for b in itertools.chain([first], batches) for p in slices(b, most=SLICE_BYTES)):
                ids, offsets = encoder.encode(part.column(1), end_id)
                entries.write_batch(pa.record_batch([part.column(0), total + offsets[:-1], np.diff(offsets)], schema=INDEX))
                documents, total = documents + part.num_rows, total + len(ids)
                carry, buffered = [*carry, ids], buffered + len(ids)
                if buffered >= block:
                    ids = np.concatenate(carry)
                    whole = len(ids) // block * block
                    for at in range(0, whole, block):
                        writer.write_batch(_sequences(ids[at : at + block], block, length, schema))
                    carry, buffered = [ids[whole:].copy()], len(ids) - whole
            if buffered:
                ids = np.concatenate(carry)
                writer.write_batch(_sequences(np.pad(ids, (0, -len(ids) % length)), len(ids), length, schema))
        yield pa.record_batch([[shard], [documents], [total], [path]], names=["shard", "documents", "tokens", "path"])

    # Rows of one id, or without any, are dealt out by a hash of the text as well, so a frequent id makes no large shard.
    salted = docs.select("doc_id", "text", F.xxhash64("text").alias("_salt"))
    ranged = salted.repartitionByRange(shards, F.asc_nulls_first("doc_id"), "_salt").sortWithinPartitions(F.asc_nulls_first("doc_id"), "_salt")
    return ranged.select("doc_id", "text").mapInArrow(write, MANIFEST)


class Shard:
    """A shard's files. On a mounted folder they are mapped, and what ``sequence`` and ``tokens`` return are views of the map."""

    def __init__(self, path: str):
        self.sequences, self.index = ipc.open_file(open_mapped(f"{path}.arrow")), ipc.open_file(open_mapped(f"{path}.index.arrow"))
        self.length = self.sequences.schema.field(0).type.list_size
        self.block, self.batch = None, None

    def _batch(self, block: int) -> pa.RecordBatch:
        if block != self.block:
            self.block, self.batch = block, self.sequences.get_batch(block)
        return self.batch

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and the mask of sequence ``k``; every batch but the last has ROWS_PER_BATCH of them."""
        batch, at = self._batch(k // ROWS_PER_BATCH), k % ROWS_PER_BATCH
        return batch.column(0)[at].values.to_numpy(), batch.column(1)[at].values

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, in parts that lie in one batch each."""
        size = ROWS_PER_BATCH * self.length
        while n > 0:
            flat = self._batch(start // size).column(0).flatten().to_numpy()
            part = flat[start % size : start % size + n]
            yield part
            start, n = start + len(part), n - len(part)


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ``manifest``: the rows of ``write_shards``, stored; what comes before a shard is a running total over them.
    """
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    rows = manifest.select(F.coalesce(before, F.lit(0)).alias("base"), "path")

    def read(batches):
        for base, path in ((b, p) for batch in batches for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            shard = Shard(path)
            for k in range(shard.index.num_record_batches):
                part = shard.index.get_batch(k)
                starts, counts = part.column(1).to_numpy(), part.column(2).to_numpy()
                crc = np.zeros(len(starts), dtype=np.int64)
                for i, (start, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
                    for ids in shard.tokens(start, n):
                        crc[i] = zlib.crc32(ids.astype(np.uint32), crc[i])
                yield pa.record_batch([part.column(0), base + starts, counts, crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_arrow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    manifest = write_shards(docs, new_dir(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(write_table(manifest, "manifest"))
