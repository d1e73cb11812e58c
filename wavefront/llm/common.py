"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of helper columns start so, to keep clear of the columns of the input.
HIDDEN = "__wf_"


def shared_checkpoints(spark: SparkSession) -> None:
    """Make sure that checkpoints go to the folder the session names.

    Spark sets the folder itself from ``spark.checkpoint.dir``. Only where the
    setting is missing a temporary folder is taken, and only in a local session:
    executors on other machines would not see it.
    """
    if spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        return
    if not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wavefront-"))


def durable(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared checkpoint folder.

    Later reads survive the loss of any executor and don't compute the rows
    again; the lineage ends here.
    """
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which may else happen
    long after the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_row_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds two non-null columns that name a row by its id and text.

    Rows with the same id and the same text share the key; a null id differs
    from every id. The hash only has to tell apart rows of one id.
    """
    return df.withColumns(
        {
            f"{HIDDEN}id": F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
            f"{HIDDEN}h": F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")),
        }
    )


ROW_KEY = [f"{HIDDEN}id", f"{HIDDEN}h"]


#: A side of a join is broadcast up to so many rows and bytes of their text columns; both have been counted then.
SMALL_ROWS, SMALL_BYTES = 200_000, 16 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, which is cheap to read, to be broadcast if it is small; beyond that Spark plans the join.

    Array columns must not be in it.
    """
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = F.coalesce(F.sum(sum(wide, F.lit(0).cast("long"))), F.lit(0))
    n, total = df.agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= SMALL_ROWS and total <= SMALL_BYTES else df


def offsets_of(column: pa.Array) -> np.ndarray:
    """Where the rows of a string or binary column begin and end in its bytes."""
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def byte_slices(batch: pa.RecordBatch, at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts (column ``at``) have ``most`` bytes together, or one row.

    What Python makes of a text is many times its size; so only a run at a time
    is turned into Python objects.
    """
    ends, start = offsets_of(batch.column(at)), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
