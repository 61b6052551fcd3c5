"""Session, storage and Arrow helpers shared by the training-data operators.

Python stages are generators over Arrow record batches: they hold one slice of
at most ``SLICE_BYTES`` of text at a time, keep no state between batches that
grows with the input, and write nothing outside the shared folder, so a lost
executor costs only the tasks it ran.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Text that a vectorised step works on at once.
SLICE_BYTES = 2 << 20

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's Python stages, by rows and by bytes.

    Spark reads these settings when a plan starts, so they hold for the session. A text
    longer than the bound is a batch of its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def free(taken: list[str], name: str) -> str:
    """``name``, or the first of its numbered forms that no column has."""
    have = {c.lower() for c in taken}
    return next(n for n in (f"{name}{i or ''}" for i in range(len(have) + 1)) if n.lower() not in have)


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors can reach.

    It lies in ``spark.checkpoint.dir``. Where that is unset, a local session gets
    a temporary folder; any other session has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dirs.setdefault(context.applicationId, tempfile.mkdtemp(prefix="conspectus-"))
    return f"{base.rstrip('/')}/conspectus-{uuid.uuid4().hex}"


class Workspace:
    """Tables written to the shared folder to cut lineage between steps."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, shared_dir(spark), 0
        self.saved: dict[int, tuple[DataFrame, str]] = {}

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.saved[id(saved)] = (saved, path)
        return saved

    def drop(self, *tables: DataFrame) -> None:
        """Remove saved tables that no later step reads."""
        for df in tables:
            _, path = self.saved.pop(id(df), (None, None))
            if path is not None:
                remove(self.spark, path)

    def keep(self, *tables: DataFrame) -> None:
        """Remove all saved tables but these, which a result still reads."""
        kept = {id(t) for t in tables}
        self.drop(*[df for key, (df, _) in list(self.saved.items()) if key not in kept])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of ``kind`` that cut ``values`` at ``bounds``."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, type=kind))
