"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
from functools import lru_cache
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import cut, shared_dir

__all__ = ["Scratch", "cut", "frugal", "held_out", "read_table", "shared_dir"]

#: An Arrow batch has at most so many rows and bytes: texts are long, and a Python worker holds a batch several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; also sets the session's Arrow batches."""
    for key, most in BATCH.items():
        spark.conf.set(key, str(most))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def frugal() -> None:
    """Has this Python worker give freed memory back to the system at once: workers live on from stage to stage,
    and an allocator that keeps its pages adds up over a pipeline."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        # glibc: own mappings from 16 MB on, a heap trimmed at 32 MB, few arenas
        libc = ctypes.CDLL(None)
        for option, value in ((-3, 16 << 20), (-1, 32 << 20), (-8, 2)):
            libc.mallopt(option, value)
    except (OSError, AttributeError):  # another C library
        return


class Scratch:
    """Tables in the shared folder that cut lineage like ``cut`` but are columnar and compressed, for larger rows."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, f"{shared_dir(spark)}/scratch-{uuid4().hex}", 0

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Writes a table, in a folder for each value of the column ``by``."""
        self.count += 1
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.folder}/{self.count}")
        self.spark._jvm.System.gc()  # lets go of the shuffle files that led here
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.count}")

    def drop(self, table: DataFrame, part: str = "") -> None:
        """Removes one of the tables, or the folder ``part`` of it, once nothing reads it any more."""
        top = re.match(r".*/scratch-[0-9a-f]+/\d+", table.inputFiles()[0]) if table.inputFiles() else None
        self._delete(f"{top[0]}/{part}".rstrip("/") if top else "")

    def clear(self) -> None:
        """Removes all tables."""
        self._delete(self.folder)

    def _delete(self, folder: str) -> None:
        if folder:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(id_col: str):
    """True for the quarter of ids that no model may learn from: crc32(id as text) mod 4 = 2."""
    return F.coalesce((F.crc32(F.col(id_col).cast("string").cast("binary")) % 4) == 2, F.lit(False))
