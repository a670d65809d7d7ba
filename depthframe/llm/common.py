"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that go through Python at a time; long texts are bounded by bytes as well.
PIECE_BYTES = 4 << 20
#: Rows in an Arrow batch, where the session has Spark's own setting: ten thousand long texts would fill a worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the quarter of rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches by the bytes of a column, so that a run of long texts can't fill a worker's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        at = got = 0
        for i, n in enumerate(sizes):
            got += n or 0
            if got >= most:
                yield batch.slice(at, i + 1 - at)
                at, got = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


_FOLDERS: list[tuple[SparkSession, str]] = []


def _clear() -> None:
    """Deletes the tables of this application, at its end."""
    for spark, folder in _FOLDERS:
        with contextlib.suppress(Exception):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            # The context may have been stopped by now.
            path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


atexit.register(_clear)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none: one in the warehouse, which all
    share as well; a local session, whose tasks run beside the driver, takes a folder of this machine."""
    conf = spark.sparkContext.getConf()
    if named := conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        return "/tmp/checkpoints"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as a compressed table in the shared folder and reads it.

    A lost executor loses nothing of it, later plans see its size and read only the columns
    that they use. The tables of an application go when it ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/depthframe-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, folder))
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``checkpointed`` made and that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rpartition("/")[0]
            for spark, own in _FOLDERS:
                if folder.endswith(own.rpartition("/")[2]):
                    path = spark._jvm.org.apache.hadoop.fs.Path(own)
                    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for an application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(BATCH_ROWS))
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="depthframe-")) / "depthframe.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))


def _release() -> None:
    """Gives memory back that a worker no longer uses; idle workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """Arrow batches through a function of this package."""
    ship(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _release()

    return df.mapInArrow(tidy, schema)


def grown(df: DataFrame, *columns: tuple[str, str]) -> StructType:
    """The schema of df with more columns; df's own stays as it is."""
    schema = StructType(list(df.schema.fields))
    for name, kind in columns:
        schema = schema.add(name, kind)
    return schema


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast, under internal names: extra or clashing columns of the input can't interfere."""
    return df.select(*(F.col(f"`{src}`").alias(name) for name, src in columns.items()))
