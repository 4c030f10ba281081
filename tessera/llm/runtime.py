"""What every operator of this subpackage needs from the session: tables, the shared folder, workers."""

from __future__ import annotations

import contextlib
import ctypes
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, shared_dir, staged  # noqa: F401

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch; texts can be long, so far below Spark's default.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_words(text: str | None) -> list[bytes]:
    """The words in UTF-8, A-Z lower-cased and nothing else; bytes are split at ASCII white space alone."""
    return text.encode().translate(_LOWER).split() if text else []


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and workers that find this package wherever the driver was started."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def released() -> None:
    """Gives what a worker has freed back to the system: workers live on between groups and stages, and would hold the most they ever used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library than GNU's
        ctypes.CDLL(None).malloc_trim(0)


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores if it was read in fewer parts than there are: small files with one row group. Larger tables stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more rows than this share of a task's even load is hot; fewer rows than HOT_ROWS never are.
HOT_SHARE, HOT_ROWS = 4, 500


def hot_join(rows: DataFrame, keyed: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has each key once and in `rows_of` how many rows have it.

    Hot keys meet their rows by broadcast, so these stay where they are. A hot key has more than 1 / (HOT_SHARE *
    tasks) of all rows, so there are at most HOT_SHARE * tasks of them: the broadcast is bounded whatever the data."""
    own = keyed.drop("rows_of")
    total = keyed.agg(F.sum("rows_of")).first()[0] or 0
    hot = keyed.filter(F.col("rows_of") > max(HOT_ROWS, total // (HOT_SHARE * partitions(rows.sparkSession))))
    if hot.isEmpty():
        return rows.join(own, keys, how)
    hot_keys = F.broadcast(hot.select(*keys))
    rest = rows.join(hot_keys, keys, "left_anti").join(own.join(hot_keys, keys, "left_anti"), keys, how)
    return rows.join(F.broadcast(hot.drop("rows_of")), keys).unionByName(rest)
