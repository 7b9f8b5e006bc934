"""Operator 9: token ids in flat binary files with 64-bit document offsets, read through memory maps.

Documents are range-partitioned and sorted by id. Each task writes one `.bin` file, the ids of its documents one after
the other as little-endian unsigned integers of 2 bytes (4 where the vocabulary needs them), and one `.idx` file:
8 bytes magic, item size and document count as 64-bit integers, count + 1 offsets in ids, count document ids. A
manifest table names the files that finished tasks wrote; its prefix sums are the files' places in the whole.

Null text counts as empty and has the end id only. Null ids come first; equal ids lie next to each other; an empty
table gives no files and an empty result; further columns don't matter.
"""

from __future__ import annotations

import mmap
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.arrow import arrow_schema, give_back, map_batches, slices, stash
from tracewell.llm.tokens import encoder
from tracewell.session import RangeReader, ensure_folder, local_path, put_bytes, scratch, ship_package

END_ID = 0
MAGIC = b"TWFLAT01"
NO_ID = np.iinfo(np.int64).min
READ_DOCS = 4096

MANIFEST = "part long, bin string, idx string, docs long, ids long, item long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_shard(root: str, part: int, docs, item: int) -> tuple[str, str, int, int]:
    """Writes one pair of files from an iterator of (doc_id, ids as <u4 bytes); gives their names, documents and ids."""
    name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
    offsets, names = [0], []

    def chunks():
        for doc, ids in docs:
            names.append(NO_ID if doc is None else doc)
            offsets.append(offsets[-1] + len(ids) // 4)
            yield ids if item == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()

    put_bytes(name + ".bin", chunks())
    head = np.array([item, len(names)], "<i8").tobytes()
    put_bytes(name + ".idx", [MAGIC, head, np.array(offsets, "<i8").tobytes(), np.array(names, "<i8").tobytes()])
    return name + ".bin", name + ".idx", len(names), offsets[-1]


class FlatFile:
    """A pair of files, memory-mapped where the file system allows it."""

    def __init__(self, bin_uri: str, idx_uri: str, docs: int):
        self._bin, self._ranges = bin_uri, RangeReader()
        head = self._ranges.read(idx_uri, 0, 24 + 16 * docs + 8)
        if head[:8] != MAGIC:
            raise ValueError(f"{idx_uri} is not an offset file")
        self.item, self.docs = map(int, np.frombuffer(head, "<i8", 2, 8))
        self.offsets = np.frombuffer(head, "<i8", self.docs + 1, 24)
        self.doc_ids = np.frombuffer(head, "<i8", self.docs, 24 + 8 * (self.docs + 1))
        self._map = None
        if (path := local_path(bin_uri)) and self.offsets[-1]:
            with open(path, "rb") as f:
                self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document as <u4."""
        a, b = int(self.offsets[k]) * self.item, int(self.offsets[k + 1]) * self.item
        data = self._map[a:b] if self._map is not None else self._ranges.read(self._bin, a, b - a)
        return np.frombuffer(data, f"<u{self.item}").astype("<u4")

    def close(self) -> None:
        if self._map is not None:
            self._map.close()
        self._ranges.close()


def write_tokens(docs: DataFrame, root: str, vocabulary: str | None = None) -> DataFrame:
    """Writes the files of docs (doc_id, text) under root. The manifest, with base: the ids before each file."""
    ship_package(docs.sparkSession)
    ensure_folder(root)
    out = arrow_schema(MANIFEST)

    def write(batches):
        part, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        item = 2 if enc.size <= 1 << 16 else 4
        end = np.array([END_ID], "<u4").tobytes()

        def each():
            for whole in batches:
                for batch in slices(whole):
                    ids = enc.encode([x or "" for x in batch.column(1).to_pylist()])
                    yield from ((d, x + end) for d, x in zip(batch.column(0).to_pylist(), ids))

        name, index, n, total = write_shard(root, part, each(), item)
        give_back()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, name, index, n, total, item), out)], schema=out)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    ranged = slim.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    manifest = stash(map_batches(ranged, write, MANIFEST), "manifest")
    # a row for each file
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    ship_package(manifest.sparkSession)
    out = arrow_schema(RESULT)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                f = FlatFile(row["bin"], row["idx"], row["docs"])
                for k in range(0, f.docs, READ_DOCS):
                    upto = min(k + READ_DOCS, f.docs)
                    crc = [zlib.crc32(f.ids(j).tobytes()) for j in range(k, upto)]
                    ids = [None if x == NO_ID else x for x in f.doc_ids[k:upto].tolist()]
                    starts, counts = f.offsets[k:upto] + row["base"], np.diff(f.offsets[k : upto + 1])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], schema=out)
                f.close()

    files = manifest.count()
    return manifest.repartition(max(files, 1)).mapInArrow(read, RESULT)


def flat_token_files(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return read_tokens(write_tokens(docs, scratch(spark, "tokens"), vocabulary))
