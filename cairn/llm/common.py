"""Helpers that the corpus operators share."""
from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SESSION = uuid.uuid4().hex
_OWN: set[str] = set()
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z; every other character stays as it is."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def words_of(text: Column) -> Column:
    """Maximal runs outside the blanks 0x20 and 0x09-0x0D, in order."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in this session's own one, which lies under the cluster's shared checkpoint folder and goes when the driver ends.

    Where ``spark.checkpoint.dir`` is unset, a local session gets a temporary folder; on a cluster
    the user's folder in the default file system takes its place, if all machines can share that.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = f"{tempfile.gettempdir()}/cairn-checkpoints"
    elif not base:
        fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
        if fs.getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{fs.getHomeDirectory().toString()}/cairn-checkpoints"
    own = f"{base.rstrip('/')}/cairn-{_SESSION}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_leave, spark, own)
    return f"{own}/{uuid.uuid4().hex}"


def _leave(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session was stopped, and its files can't be reached
        with contextlib.suppress(Py4JError, OSError):
            drop_path(spark, path)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames that :func:`materialise` returned; whatever reads them must be done."""
    for df in frames:
        for root in {p.rsplit("/", 2)[0] for p in df.inputFiles() if f"/cairn-{_SESSION}/" in p}:
            drop_path(df.sparkSession, root)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession, size: str = "2m") -> None:
    """From now on the session sends Python workers batches of about so many bytes, one row at least.

    By default a batch has up to 10,000 rows; the JVM keeps a batch of texts outside its heap, beside what it holds there.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def passing(docs: DataFrame, test) -> DataFrame:
    """The rows of ``docs`` whose texts pass, with their columns; ``test`` turns an Arrow array of texts into one of booleans.

    Texts go to the workers once, without the other columns, and only the answers come back.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield test(texts)

    return docs.filter(F.arrow_udf(run, "boolean")(docs["text"].cast("string")))


def pieces(batches, rows: int = 500):
    """Arrow batches in pieces of so many rows, so that what is made of them at once stays small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def text_buffer(column) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array, its offsets, and which rows are null, without copying."""
    buffers = column.buffers()
    kind = np.int64 if "large" in str(column.type) else np.int32
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1]
    data = memoryview(buffers[2]) if buffers[2] is not None else memoryview(b"")
    nulls = np.zeros(len(column), bool) if column.null_count == 0 else ~np.asarray(column.is_valid())
    return data, offsets.astype(np.int64), nulls


def each_text(column):
    """Yield the UTF-8 bytes of each row; null rows are empty."""
    data, offsets, nulls = text_buffer(column)
    for start, end, null in zip(offsets[:-1].tolist(), offsets[1:].tolist(), nulls.tolist()):
        yield b"" if null else bytes(data[start:end])
