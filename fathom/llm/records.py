"""Token ids in length-delimited binary shards, with an offset index beside each.

A record: uint64 length, uint32 masked checksum of the length's bytes, payload,
uint32 masked checksum of the payload; little endian. The checksum is CRC-32,
masked by a rotation and a constant so that a checksum of data that holds
checksums stays useful. Payload: int64 document id (null: the smallest int64),
uint8 bytes per id (2 or 4), the ids. The index has for every record int64
document id, uint64 offset, uint64 framed size, so that a reader can shuffle
records without scanning a shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.base import bounded_batches, scratch
from fathom.llm.tokens import encoder

NO_ID = -(1 << 63)
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """(payload, place after it); an error where lengths or checksums don't hold."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"broken record length at byte {at}")
    end = at + 12 + struct.unpack("<Q", head)[0]
    payload = data[at + 12 : end]
    if struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"broken record at byte {at}")
    return payload, end + 4


def pack_ids(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<qB", NO_ID if doc_id is None else doc_id, width) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack_from("<qB", payload)
    return None if doc_id == NO_ID else doc_id, np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4")


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str, shards: int) -> DataFrame:
    """Writes docs (doc_id, text) in ascending doc_id order, nulls first and ties by a
    hash of the text, to `shards` files or fewer under path, a place that pyarrow.fs can open
    on every executor. Returns the manifest, kept as Parquet under path: file,
    shard, n_docs, n_tokens. A null text is empty; a rerun task writes a new file,
    and the manifest names only those of the tasks that counted."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        store, root = pafs.FileSystem.from_uri(path)
        name = f"shard-{part:06d}-{uuid.uuid4().hex}"
        store.create_dir(root, recursive=True)
        docs_n = tokens_n = at = 0
        with store.open_output_stream(f"{root}/{name}.rec") as out, store.open_output_stream(f"{root}/{name}.idx") as index:
            for batch in batches:
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.texts(batch.column("text"), end_id), strict=True):
                    record = frame(pack_ids(doc_id, ids))
                    out.write(record)
                    rows.append((NO_ID if doc_id is None else doc_id, at, len(record)))
                    at += len(record)
                    docs_n, tokens_n = docs_n + 1, tokens_n + len(ids)
                index.write(np.array(rows, INDEX).tobytes())
        if docs_n:
            yield pa.RecordBatch.from_pylist([{"file": name, "shard": part, "n_docs": docs_n, "n_tokens": tokens_n}], pa.schema([("file", pa.string()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows.select("doc_id", "text").mapInArrow(write, "file string, shard int, n_docs long, n_tokens long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """shard, row (in its shard), doc_id, ids (int array) of every record, checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, shard, start in zip(*(batch.column(c).to_pylist() for c in ("file", "shard", "start")), strict=True):
                at = 0
                with store.open_input_stream(f"{root}/{file}.idx") as index, store.open_input_stream(f"{root}/{file}.rec") as records:
                    while some := index.read(INDEX.itemsize * 512):
                        row = []
                        for doc_id, _, size in np.frombuffer(some, INDEX).tolist():
                            payload, end = unframe(records.read(size), 0)
                            found, ids = unpack_ids(payload)
                            if end != size or (NO_ID if found is None else found) != doc_id:
                                raise ValueError(f"{file}: the index doesn't match record {at + len(row)}")
                            row.append((found, start, ids))
                            start += len(ids)
                        lengths = np.array([len(x[2]) for x in row])
                        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(np.concatenate([x[2] for x in row]).astype(np.int32)))
                        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(row), pa.int32()), pa.array(range(at, at + len(row)), pa.int64()), pa.array([x[0] for x in row], pa.int64()), pa.array([x[1] for x in row], pa.int64()), ids], ["shard", "row", "doc_id", "start", "ids"])
                        at += len(row)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return placed(manifest, before).mapInArrow(read, "shard int, row long, doc_id long, start long, ids array<int>")


def read_index(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, doc_id, offset, size) of every record, from the index files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with store.open_input_stream(f"{root}/{file}.idx") as index:
                    while some := index.read(INDEX.itemsize * 65536):
                        rows = np.frombuffer(some, INDEX)
                        columns = [pa.array([file] * len(rows)), pa.array(rows["doc_id"], mask=rows["doc_id"] == NO_ID), *(pa.array(rows[c].astype(np.int64)) for c in ("offset", "size"))]
                        yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "offset", "size"])

    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(read, "file string, doc_id long, offset long, size long")


def read_at(path: str, places: DataFrame) -> DataFrame:
    """places (file, offset, size) with the doc_id and ids of each record, in the order in
    which the rows come: a reader that shuffles the index seeks each record by itself."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        name, file = None, None
        for batch in batches:
            found = []
            for this, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size")), strict=True):
                if this != name:
                    name, file = this, store.open_input_file(f"{root}/{this}.rec")
                file.seek(offset)
                payload, end = unframe(file.read(size), 0)
                if end != size:
                    raise ValueError(f"{this}: no record of {size} bytes at byte {offset}")
                found.append(unpack_ids(payload))
            ids = pa.array([x[1].astype(np.int32) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.int64()), ids], [*batch.schema.names, "doc_id", "ids"])

    return places.select("file", "offset", "size").mapInArrow(read, "file string, offset long, size long, doc_id long, ids array<int>")


def placed(manifest: DataFrame, before) -> DataFrame:
    n = max(1, manifest.count())
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).repartition(n, "shard")


def digests(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record of read_shards."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at, flat = np.array(ids.offsets), np.array(ids.values).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return records.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Writes docs as record shards in the shared folder and returns their digests, read back."""
    spark = docs.sparkSession
    path = scratch(spark, "records")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return digests(read_shards(spark, path, write_shards(docs, tokenizer, end_id, path, shards)))
