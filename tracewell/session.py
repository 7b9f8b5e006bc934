"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


SPREAD_BYTES = 64 << 20  # for each core: inputs of more have work for all


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, its rows dealt out where it comes from fewer files than there are cores and is small: a file of one row group
    is one task, however much work its rows make. Large inputs stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * SPREAD_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(2 * cores)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tracewell_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="tracewell-"))
    archive = folder / "tracewell_pkg.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    sc.addPyFile(str(archive))
    sc._tracewell_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine a temporary folder is set where that is unset; on a cluster that is an error."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tracewell-shared-")
        sc.setCheckpointDir(known)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for tables between steps."""
    return f"{shared_dir(spark)}/tracewell/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all tables between steps of this application. Results that weren't written by then can't be read any more."""
    _delete(spark, scratch_root(spark))


def stash(df: DataFrame, name: str, parts: int | None = None, by_workers: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage in a way that outlives executors.
    parts: at most so many files, where parts_for() knows that the tables behind df are small.

    by_workers: in a folder that is mounted as file:, Hadoop starts a process (chmod) for each file that an executor's
    JVM writes, which for a moment counts the whole JVM twice. There Python workers write the files, in the worker that
    made the rows where one did (see `_tracewell_rows`); only files of tasks that ended well are moved into the table.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    folder = local_path(path) if by_workers else None
    if folder:
        _write_by_workers(df, folder, parts)
    else:
        (df if parts is None else df.coalesce(parts)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewell_path = path
    return out


def _write_by_workers(df: DataFrame, folder: str, parts: int | None) -> None:
    made, rows = getattr(df, "_tracewell_rows", (df, None))
    ship_package(df.sparkSession)
    drafts = f"{folder}/_drafts"
    os.makedirs(drafts, exist_ok=True)

    def write(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        name, out, n = f"{drafts}/{uuid.uuid4().hex}.parquet", None, 0
        for batch in rows(batches) if rows else batches:
            if batch.num_rows:
                out = out or pq.ParquetWriter(name, batch.schema, compression="zstd")
                out.write_batch(batch)
                n += batch.num_rows
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n"])

    files = (made if parts is None else made.coalesce(parts)).mapInArrow(write, "file string, n long").collect()
    for k, row in enumerate(files):  # one for each task at most
        os.replace(row["file"], f"{folder}/part-{k:06d}.parquet")
    for left in os.listdir(drafts):  # of attempts that failed
        os.remove(f"{drafts}/{left}")
    os.rmdir(drafts)


def discard(*tables: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_tracewell_path", None):
            _delete(t.sparkSession, path)


PART_BYTES = 1 << 20


def parts_for(*tables: DataFrame) -> int:
    """Files that what is made from written tables needs: two for each core, more from PART_BYTES of theirs on each. With
    few rows behind many shuffle partitions, each task and file costs more than its work; large tables keep all of theirs."""
    size = sum(int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    return max(2 * tables[0].sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def ensure_folder(uri: str) -> None:
    if path := local_path(uri):
        os.makedirs(path, exist_ok=True)
    else:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        store.create_dir(inner, recursive=True)


def put_bytes(uri: str, chunks) -> int:
    """Writes chunks to uri. A local file appears only when whole; returns its size."""
    size = 0
    if path := local_path(uri):
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(part, "wb") as out:
            for c in chunks:
                size += out.write(c)
        os.replace(part, path)
        return size
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(inner) as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    return size


class RangeReader:
    """Reads byte ranges of files by URI; keeps the last few files open."""

    def __init__(self, keep: int = 8):
        self._open: dict = {}
        self._keep = keep

    def read(self, uri: str, offset: int, length: int) -> bytes:
        f = self._open.get(uri)
        if f is None:
            while len(self._open) >= self._keep:
                self._open.pop(next(iter(self._open))).close()
            if path := local_path(uri):
                f = open(path, "rb")
            else:
                from pyarrow import fs

                store, inner = fs.FileSystem.from_uri(uri)
                f = store.open_input_file(inner)
            self._open[uri] = f
        f.seek(offset)
        return f.read(length)

    def close(self) -> None:
        for f in self._open.values():
            f.close()
        self._open.clear()
