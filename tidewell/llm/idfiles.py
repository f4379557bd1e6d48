"""Fixed-width token-id files: every id in the least bits the vocabulary needs, with block offsets for random access.

A file holds the documents of one range of ``doc_id`` in ascending order::

    magic "TWID1\\n\\0\\0" | header: 6 uint64 (bits, block ids, documents, ids, blocks, 0)
    documents: n x (int64 doc_id, uint64 first id)   -- doc_id of a null is the least int64
    blocks:    m x uint64 byte offset of the block, from the start of the file
    packed blocks, each of ``block ids`` ids (the last may be shorter)

The files lie in the shared folder; a manifest table, written by Spark, names those of the tasks that succeeded, so a task
that is run again or twice leaves at most an unnamed file behind.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.tokens import bits_for, codec, pack_bits, unpack_bits
from tidewell.session import fresh_path, materialize

MAGIC = b"TWID1\n\0\0"
BLOCK = 1 << 16
NULL_ID = -(1 << 63)
MANIFEST = "part int, path string, n_docs long, n_ids long"


def filesystem(uri: str):
    """(file system, path) of a URI or plain path in the shared folder."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Collects packed blocks of one file; memory is the packed size of one part."""

    def __init__(self, bits: int, block: int = BLOCK):
        self.bits, self.block = bits, block
        self.docs: list[tuple[int, int]] = []
        self.blocks: list[bytes] = []
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NULL_ID if doc_id is None else int(doc_id), self.n_ids))
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            flat = np.concatenate(self.rest)
            whole = len(flat) - len(flat) % self.block
            for k in range(0, whole, self.block):
                self.blocks.append(pack_bits(flat[k : k + self.block], self.bits))
            self.rest, self.waiting = [flat[whole:]], len(flat) - whole

    def save(self, folder: str, name: str) -> str:
        if self.waiting:
            self.blocks.append(pack_bits(np.concatenate(self.rest), self.bits))
        head = np.array([self.bits, self.block, len(self.docs), self.n_ids, len(self.blocks), 0], dtype="<u8").tobytes()
        docs = np.array(self.docs, dtype="<i8").reshape(-1, 2).tobytes()
        at = len(MAGIC) + len(head) + len(docs) + 8 * len(self.blocks)
        sizes = np.array([len(b) for b in self.blocks], dtype=np.int64)
        starts = (at + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.array([], dtype=np.int64)).astype("<u8")
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(MAGIC + head + docs + starts.tobytes())
            for b in self.blocks:
                out.write(b)
        return f"{folder}/{name}"


class Reader:
    """Random access to one file: ``ids(first, count)`` reads only the blocks that hold them."""

    def __init__(self, uri: str):
        store, path = filesystem(uri)
        self.source = store.open_input_file(path)
        if self.source.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a token-id file")
        self.bits, self.block, n_docs, self.n_ids, n_blocks, _ = (int(x) for x in np.frombuffer(self.source.read_at(48, 8), dtype="<u8"))
        table = np.frombuffer(self.source.read_at(16 * n_docs, 56), dtype="<i8").reshape(-1, 2)
        self.doc_ids = table[:, 0]
        self.starts = np.append(table[:, 1], self.n_ids)
        self.at = np.frombuffer(self.source.read_at(8 * n_blocks, 56 + 16 * n_docs), dtype="<u8")

    def ids(self, first: int, count: int) -> np.ndarray:
        parts = []
        while count > 0:
            k, skip = divmod(first, self.block)
            take = min(count, self.block - skip)
            low = skip * self.bits // 8
            high = ((skip + take) * self.bits + 7) // 8
            data = self.source.read_at(high - low, int(self.at[k]) + low)
            parts.append(unpack_bits(data, self.bits, take, 0) if (skip * self.bits) % 8 == 0 else _tail(data, self.bits, take, skip * self.bits % 8))
            first, count = first + take, count - take
        return np.concatenate(parts) if parts else np.array([], dtype=np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))

    def close(self) -> None:
        self.source.close()


def _tail(data: bytes, bits: int, count: int, offset: int) -> np.ndarray:
    """Ids of a block piece whose first id begins ``offset`` bits into the first byte."""
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[offset:][: count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), dtype=np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


def write_ids(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int | None = 0, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Encode every whole text and write the ids in ascending ``key`` order; returns the manifest (part, path, n_docs, n_ids, start).

    A null text is an empty one, ``end_id`` follows every document, null keys come first, rows with the same key are all
    written (ordered by text). Other columns are ignored. An empty table gives no files and an empty manifest. The rows are
    range-partitioned by key, so each task holds the packed ids of one range only.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc = codec(vocabulary)
        out = Writer(bits_for(max(enc.vocab_size, (end_id or 0) + 1)))
        tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for doc, data in zip(batch["k"], enc.encode(batch["t"])):
                out.add(None if pd.isna(doc) else doc, np.frombuffer(data + tail, dtype="<u4"))
        if out.docs:
            part = TaskContext.get().partitionId()
            path = out.save(folder, f"part-{part:06d}-{uuid.uuid4().hex}.ids")
            yield pd.DataFrame({"part": [part], "path": [path], "n_docs": [len(out.docs)], "n_ids": [out.n_ids]})

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    done = rows.repartitionByRange(parts, "k").sortWithinPartitions("k", "t").mapInPandas(write, MANIFEST)
    manifest = materialize(done, "id-manifest")
    # One row per file: a window over the manifest is as small as the number of files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, part int"


def read_ids(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: one row per document with its place and a checksum of its ids."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, path, start in zip(batch["part"], batch["path"], batch["start"]):
                file = Reader(path)
                rows = []
                step = max(1, min(4096, len(file.doc_ids)))
                for lo in range(0, len(file.doc_ids), step):
                    hi = min(lo + step, len(file.doc_ids))
                    base = int(file.starts[lo])
                    flat = file.ids(base, int(file.starts[hi]) - base).astype("<u4")
                    cuts = file.starts[lo : hi + 1] - base
                    rows = [(None if file.doc_ids[lo + j] == NULL_ID else int(file.doc_ids[lo + j]), int(start) + base + int(cuts[j]), int(cuts[j + 1] - cuts[j]), zlib.crc32(flat[cuts[j] : cuts[j + 1]].tobytes()), int(part)) for j in range(hi - lo)]
                    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "part"])
                    yield frame.astype({"doc_id": "Int64"})
                file.close()

    spark: SparkSession = manifest.sparkSession
    wide = manifest.select("part", "path", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return wide.mapInPandas(read, READ)
