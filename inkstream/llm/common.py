"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it.

    Where the session leaves the rows of an Arrow batch at Spark's default of 10 000, they are set to 1 000: whole texts
    are long, and both an executor and its workers hold a batch or two a task outside the heap.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="inkstream-")) / "inkstream-package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one of this machine only where all of Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "inkstream-checkpoints")
    return f"{root.rstrip('/')}/inkstream-{uuid.uuid4().hex}"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no upstream work."""
    path = shared_dir(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = weakref.ref(out), path
    return out


_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again; frames that ``materialize`` hasn't returned are passed over."""
    for df in tables:
        held, path = _WRITTEN.pop(id(df), (lambda: None, ""))
        if held() is df:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batches: Iterable[pa.RecordBatch], column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` (string or binary) holds about ``budget`` bytes in each."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return to the system what a task has freed, since its Python worker lives on and waits beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


def doc_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones never clash with those an operator adds."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores ahead until no column of ``taken`` has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name
