"""Size-checked broadcasts and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 50_000


def fetch_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> pa.Table | None:
    """The rows of ``df`` if there are at most ``max_rows``, else None.

    Never fetches more than ``max_rows + 1`` rows, so an unexpectedly large table
    costs a bounded look and nothing else.
    """
    rows = df.limit(max_rows + 1).toArrow()
    return rows if rows.num_rows <= max_rows else None


def local_table(spark: SparkSession, rows: pa.Table, like: DataFrame) -> DataFrame:
    return spark.createDataFrame(rows, like.schema)


def checked_broadcast(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if counted to be small; unmarked (shuffled join) if not."""
    rows = fetch_small(df, max_rows)
    return df if rows is None else F.broadcast(local_table(df.sparkSession, rows, df))


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``, which every executor can reach."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="panelcast-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names in ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written there as columns and read back: for narrow rows that are dear to make and that several passes read."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, times: int = 1, per_core: int = 1) -> DataFrame:
    """``df`` hashed by ``keys`` over every core, ``times`` tasks each, for work that is heavy per row rather than per byte.

    Partitions sized by bytes leave such work in a handful of tasks.  There are at least ``times * per_core`` tasks for a core.
    """
    sc = df.sparkSession.sparkContext
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(times * max(per_core * sc.defaultParallelism, shuffle), *keys)
