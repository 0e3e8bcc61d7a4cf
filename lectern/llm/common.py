"""What the operators of this subpackage share: inputs, written tables, size-checked joins."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many bytes, by its counted rows.
BROADCAST_BYTES = 8 << 20


def columns(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """The wanted columns only, as new=(old, type); other columns can't clash.

    A name is looked up exactly first, then without regard to case, and the
    first of several equal names counts.
    """
    names = df.columns
    at = {}
    for new, (old, _) in wanted.items():
        exact = [i for i, n in enumerate(names) if n == old] or [i for i, n in enumerate(names) if n.lower() == old.lower()]
        if not exact:
            raise ValueError(f"no column {old!r} among {names}")
        at[new] = exact[0]
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"c{at[new]}").cast(kind).alias(new) for new, (_, kind) in wanted.items()))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all run on this machine."""
    own = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return spark.sparkContext.getCheckpointDir()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; its folder goes with it
        pass


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, which survives lost executors.

    The shuffles behind it are then garbage; asking for its collection lets Spark
    delete their files, which would otherwise lie on the executors' disks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lectern_path = path
    gc.collect()  # plans that only Python still holds
    spark.sparkContext._jvm.System.gc()
    return out


def drop_written(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df.lectern_path)


def finished(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """The result as a table of its own; the tables that it was made from are removed."""
    out = written(df)
    drop_written(*tables)
    return out


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """True if the rows, counted up to the limit and no further, may be broadcast."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def sized_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str, row_bytes: int = 16) -> DataFrame:
    """left joined with right, which is broadcast if it is small, else shuffled."""
    return left.join(F.broadcast(right) if fits(right, row_bytes) else right, on, how)


def dropped(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id isn't among the doc_id of ids; all columns as they are, whatever their names. Null ids stay."""
    names = docs.columns
    exact = [i for i, n in enumerate(names) if n == id_col] or [i for i, n in enumerate(names) if n.lower() == id_col.lower()]
    if not exact:
        raise ValueError(f"no column {id_col!r} among {names}")
    gone = ids.select(F.col("doc_id").alias("gone")).distinct()
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    kept = plain.join(F.broadcast(gone) if fits(gone, 16) else gone, F.col(f"c{exact[0]}").cast("long") == F.col("gone"), "left_anti")
    return kept.toDF(*names)


def binaries(rows: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def packed(values: np.ndarray, bounds: np.ndarray, width: int = 8) -> pa.Array:
    """A binary array of the slices of values, without copies by row."""
    offsets = (bounds * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
