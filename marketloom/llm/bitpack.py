"""Token ids in files of fixed-width bit packing.

A file holds a range of documents in order. Each id takes the fewest bits that the vocabulary needs.
Layout, all integers little-endian:

* ``MAGIC`` (4 bytes), u32 bits, u32 block length in ids, u64 documents, u64 ids, u64 blocks
* documents x (i64 doc_id, u64 end of its ids in the file; its highest bit marks a null doc_id)
* (blocks + 1) x u64 offset of each block from the start of the packed part
* the packed part: each block starts at a byte; id k of a block takes bits [k * bits, (k + 1) * bits)

Any document or span of ids is read from the header, the offsets and the blocks that hold it.

Files are written by tasks under a name of their own and then renamed, so a task that runs again
replaces nothing half-written; only files named by the returned manifest count.

Null and empty texts hold the end id alone. Rows with a null doc_id come first. Repeated rows and
doc_ids are separate documents, in no particular order among themselves. A task holds the ids of one
file, which ends with the document that fills it, so a very long text is held whole. Only doc_id and
text are read; other columns, whatever their names, are not. Empty input gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, saved, scratch_path
from .tokens import encoder

MAGIC = b"FWB1"
HEAD = struct.Struct("<4sIIQQQ")
BLOCK = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, ``bits`` bits each, lowest bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    rows = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(rows.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = raw[: n * bits // 8].reshape(n, bits // 8)
    else:
        rows = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
        packed = np.packbits(rows, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
    return out.reshape(-1).view("<u4")


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    index = np.empty((len(doc_ids), 2), "<i8")
    index[:, 0], index[:, 1] = [d or 0 for d in doc_ids], np.cumsum(lengths)
    index[:, 1] |= np.array([d is None for d in doc_ids], "i8") << 63
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids), len(blocks))
    return b"".join([head, index.tobytes(), offsets.tobytes(), *blocks])


class PackedFile:
    """Random access to a packed file through any object with ``seek`` and ``read``."""

    def __init__(self, source):
        self.source = source
        magic, self.bits, self.block, self.docs, self.ids, blocks = HEAD.unpack(source.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        index = np.frombuffer(source.read(16 * self.docs), "<i8").reshape(-1, 2)
        self.ends = index[:, 1] & np.int64((1 << 63) - 1)
        self.doc_ids = [None if end < 0 else d for d, end in index.tolist()]
        self.offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<u8")
        self.start = HEAD.size + 16 * self.docs + 8 * (blocks + 1)

    def span(self, begin: int, end: int) -> np.ndarray:
        """The ids at [begin, end) of the file, from the blocks that hold them."""
        if begin >= end:
            return np.zeros(0, "<u4")
        first, last = begin // self.block, (end - 1) // self.block
        self.source.seek(self.start + int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        parts, at = [], 0
        for k in range(first, last + 1):
            size = int(self.offsets[k + 1] - self.offsets[k])
            n = min(self.block, self.ids - k * self.block)
            parts.append(unpack(data[at : at + size], n, self.bits))
            at += size
        return np.concatenate(parts)[begin - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark gives it, so that tasks write where Spark reads."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()


MANIFEST = "part int, file int, path string, docs long, ids long, bytes long"


def write_packed(docs: DataFrame, folder: str, tokenizer_path: str, vocabulary: int, end_id: int, file_ids: int = 1 << 22) -> DataFrame:
    """Encode ``doc_id, text`` in ascending doc_id order into packed files under ``folder``.

    Returns the manifest, one row for each file: range partition, file number in it, path, counts.
    A file ends with the document that takes it past ``file_ids`` ids.
    """
    bits = bits_for(vocabulary)
    folder = qualified(docs.sparkSession, folder)
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        held: list[tuple[int, bytes]] = []
        count, files, part = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal count, files
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            data = encode_file([d for d, _ in held], np.array([len(x) // 4 for _, x in held], "i8"), ids, bits)
            name = f"ids-{part:05d}-{files:05d}-{uuid.uuid4().hex}.fwb"
            with fs.open_output_stream(f"{root}/_{name}.tmp") as out:
                out.write(data)
            fs.move(f"{root}/_{name}.tmp", f"{root}/{name}")
            row = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": pa.array([files], pa.int32()), "path": [f"{folder.rstrip('/')}/{name}"], "docs": [len(held)], "ids": [len(ids)], "bytes": [len(data)]}
            )
            held.clear()
            count, files = 0, files + 1
            return row

        fs.create_dir(root, recursive=True)
        with encoder(tokenizer_path) as own:
            for batch in batches:
                for doc_id, text, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    held.append((doc_id, own.encode(text) + end))
                    count += len(held[-1][1]) // 4
                    if count >= file_ids:
                        yield flush()
            if held:
                yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("part", F.spark_partition_id())
    return saved(ordered.mapInArrow(write, MANIFEST), "manifest")


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_packed(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files in ``manifest``: doc_id, global start, ids and their crc32."""
    from pyspark.sql import Window

    sums = manifest.groupBy("part").agg(F.sum("ids").alias("_part_ids"))
    before = lambda *by: Window.partitionBy(*by)
    # a row for each range partition, whose number the settings bound
    starts = sums.select("part", F.coalesce(F.sum("_part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part_start"))
    w = before("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("_start", F.coalesce(F.sum("ids").over(w), F.lit(0)))
    files = files.join(F.broadcast(starts), "part").select("path", (F.col("_start") + F.col("_part_start")).cast("long").alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _store(path)
                with fs.open_input_file(at) as source:
                    file = PackedFile(source)
                    ids = file.span(0, file.ids)
                ends = file.ends.tolist()
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(file.doc_ids, pa.int64()),
                        "start": pa.array([start + b for b in begins], pa.int64()),
                        "n_tokens": pa.array([e - b for b, e in zip(begins, ends, strict=True)], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[b:e]) for b, e in zip(begins, ends, strict=True)], pa.int64()),
                    }
                )

    # rows are short and stand for whole files: dealt by their number, not by their size
    n = min(manifest.count(), 16 * partitions(manifest.sparkSession))
    return files.repartition(max(1, n), "path").mapInArrow(read, DOCUMENTS)


def packed_ids(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int) -> DataFrame:
    """Write ``docs`` as packed files in the shared folder, then read them back (``DOCUMENTS``)."""
    folder = scratch_path(docs.sparkSession, "packed-ids")
    return read_packed(write_packed(docs, folder, tokenizer_path, vocabulary, end_id))
