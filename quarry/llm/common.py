"""What the operators share: reading tables, durable intermediate tables, Arrow row streams."""

from __future__ import annotations

import atexit
import ctypes
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that Python stages get: with documents of some KB a batch is a few MB.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns only, as the given types; other columns, whatever their names, don't get further."""
    return df.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns that df doesn't have yet."""
    there = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in there:
            n = f"_{n}"
        there.add(n.lower())
        out.append(n)
    return out


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the executors' path. Safe to call again."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted((root / "quarry").rglob("*.py")):
            z.write(f, f.relative_to(root))
    name = f"{shared_dir(spark)}/quarry-package-{uuid.uuid4().hex}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(held.getvalue()))
    stream.close()
    context.addPyFile(name)
    context._quarry_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir, the folder that driver and executors share, is not set")
        found = getattr(spark.sparkContext, "_quarry_dir", None)
        if not found:
            found = spark.sparkContext._quarry_dir = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Intermediate results written to the shared folder and read back, so that no lost executor takes them along.

    drop() removes those that nothing needs any more; the others go when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def size(self, name: str) -> int:
        """Bytes of the files."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def drop(self, *names: str) -> None:
        for n in names:
            remove(self.spark, f"{self.root}/{n}")

    def _end(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session is gone already
            pass


def trim() -> None:
    """Give what a task no longer needs back to the system: Python workers live on beside Spark's executor and the next stage."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, and trim() at the end of each task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def crc32_of(column: str):
    """crc32 of the id as text, as the held-out split uses it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
