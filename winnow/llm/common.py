"""Helpers shared by the operators: written intermediate tables, files in the shared folder, whole-document rows."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.operators.slices import materialize as written
from winnow.operators.slices import scratch_folder

__all__ = ["file_system", "lean", "lower_ascii", "publish", "read_table", "release", "shared_folder", "ship", "text_bytes", "written"]


BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per session: their Python does not know the driver's import path.

    Also lets at most ``BATCH_ROWS`` rows travel to Python at once, as whole texts are among them, and has the shuffle
    files of a step removed when its result has been written down.
    """
    context = spark.sparkContext
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_llm_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "winnow_package.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for file in sorted(root.rglob("*.py")):
            bundle.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    context._llm_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the folder that all executors share. Nothing is created here."""
    return f"{scratch_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def file_system(uri: str):
    """The pyarrow file system of ``uri`` and the path in it. ``file:/x``, ``file:///x`` and ``/x`` are one place."""
    from pyarrow import fs

    uri = re.sub(r"^file:/*", "file:///", uri)
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> None:
    """Create the file ``uri`` by ``write(stream)``; it appears whole or not at all, also when a task is run again."""
    system, path = file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as stream:
        write(stream)
    system.move(part, path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of steps whose results have been written down: its cleaner acts when the
    driver's JVM finds that nothing refers to them any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` whose worker gives freed memory back when its task ends. Workers live on beside those of later steps,
    and an allocator keeps what it has, so each would hold its largest task's memory."""

    def run(batches: Iterator) -> Iterator:
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may have none
        if trim is not None:
            trim(0)

    return run


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(text, F.lit("")).cast("binary")


# The letters that the contracts fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)
