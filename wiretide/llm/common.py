"""Reading, storing and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from wiretide.session import checkpoint_dir


#: Bytes of the batches that tasks exchange with Python. Whole texts make large rows, and both sides hold a batch twice.
BATCH_LIMIT = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_LIMIT))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _passing_shuffles(spark: SparkSession):
    """Let Spark drop the shuffle files of what runs inside at its end. Files behind a written table may stay until the
    driver's references to them are collected."""
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder and read back, so that no lost executor can undo them."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    with _passing_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables of which nothing is read any more, and let the driver notice that their shuffles are done with."""
    for df in tables:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("llm-"):
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def collected(df: DataFrame) -> pd.DataFrame:
    """The rows of a table of bounded size."""
    with _passing_shuffles(df.sparkSession):
        return df.toPandas()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array and the border of each row in it; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, borders, data = column.buffers()
    offsets = np.frombuffer(borders, np.int64)[column.offset: column.offset + len(column) + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return buffer[:0], np.zeros(1, np.int64)
    return buffer[offsets[0]: offsets[-1]], offsets - offsets[0]


def text_batches(batches, byte_limit: int, text: str = "text"):
    """Record batches cut into slices of about ``byte_limit`` text bytes, but at least one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < len(sizes):
            base = ends[begin] - sizes[begin]
            end = max(begin + 1, int(np.searchsorted(ends, base + byte_limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
