"""Token ids in length-delimited binary records with a separate offset index.

A frame is: payload length (u64), its masked checksum (u32), payload, the payload's masked checksum (u32), all
little-endian. The checksum is CRC-32, masked by a rotation and a constant so that a checksum of data that holds
checksums stays sound. The payload is: id width in bytes (u8), has-id flag (u8), doc_id (i64), number of ids (u32), ids.

Documents are range-partitioned by id; each partition writes one file under the shared folder to a passing name and then
moves it in place, so a task that is run again gives the same file. The index (file, offset, frame bytes, ids) allows
reads in any order.

Defined results: null and empty texts hold the end id alone; a null doc_id sorts first; rows with equal ids are ordered by
the hash of their text; an empty table gives no file and an empty index; a broken frame raises ``ValueError``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, new_folder, stored, tune, uri
from .tokens import END_ID, default_path, encoder, groups

_HEAD, _PAYLOAD = struct.Struct("<QI"), struct.Struct("<BBqI")
_MASK_DELTA = 0xA282EAD8
INDEX = "part int, doc_id long, offset long, frame_bytes long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = _PAYLOAD.pack(width, doc_id is not None, doc_id or 0, len(ids) // width) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of one frame."""
    if len(data) < _HEAD.size:
        raise ValueError("record is cut off")
    length, crc = _HEAD.unpack_from(data)
    if masked(data[:8]) != crc:
        raise ValueError("record length is damaged")
    payload = data[_HEAD.size : _HEAD.size + length]
    if len(data) != _HEAD.size + length + 4 or masked(payload) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise ValueError("record is damaged")
    width, has_id, doc_id, n = _PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=_PAYLOAD.size)
    if len(ids) != n:
        raise ValueError("record has another number of ids")
    return (doc_id if has_id else None), ids


def _name(part: int) -> str:
    return f"part-{part:06d}.rec"


def write_records(docs: DataFrame, folder: str, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text) to ``folder``, a URI, in ascending order of ids; returns the stored index."""
    path = path or default_path()
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = docs.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        enc, part, at, rows = encoder(path), TaskContext.get().partitionId(), 0, []
        end, width = np.array([END_ID], enc.dtype).tobytes(), enc.dtype.itemsize
        out, passing = None, f"{root}/.{_name(part)}-{uuid.uuid4().hex}"
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), filled(batch.column(1)).to_pylist()
            for lo, hi in groups(texts):
                for doc_id, got in zip(ids[lo:hi], enc.encode(texts[lo:hi])):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(passing, buffer_size=1 << 20)
                    data = frame(doc_id, got + end, width)
                    out.write(data)
                    rows.append((doc_id, at, len(data), len(got) // width + 1))
                    at += len(data)
            if len(rows) >= 10000:
                yield _index(part, rows)
                rows = []
        if out is not None:
            out.close()
            fs.move(passing, f"{root}/{_name(part)}")
        yield _index(part, rows)

    return stored(ordered.mapInArrow(write, INDEX), "record-index")


def _index(part: int, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    arrays = [pa.array([part] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "doc_id", "offset", "frame_bytes", "n_tokens"])


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads the frames that the index names: doc_id, start (ids before the document over all files), n_tokens and
    ids_crc32 (of the ids as little-endian u32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        part, file, start = None, None, 0
        for batch in batches:
            out = []
            for p, offset, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p != part:
                    part, file, start = p, fs.open_input_file(f"{root}/{_name(p)}"), 0
                doc_id, ids = parse(file.read_at(size, offset))
                out.append((p, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int32()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "doc_id", "in_part", "n_tokens", "ids_crc32"])

    # files in order; there are as many rows as files
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("first"))
    spark = index.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    frames = index.select("part", "offset", "frame_bytes").repartition(n, "part").sortWithinPartitions("part", "offset")
    found = frames.mapInArrow(read, "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long")
    return found.join(firsts, "part").select("doc_id", (F.col("first") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


def token_records(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all documents as records under the shared folder and reads them back."""
    folder = new_folder(docs.sparkSession, "token-records")
    return read_records(write_records(docs, uri(folder), path), uri(folder))
