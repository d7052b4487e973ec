"""Tables kept between stages."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.codes import KEYS, TIME
from panelcast.operators.forest import QuantileForestModel

OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


@dataclass
class Stages:
    """Parquet tables and models under one shared folder."""

    spark: SparkSession
    root: str

    def save(self, df: DataFrame, name: str, partition_by: Sequence[str] = (TIME,)) -> DataFrame:
        """Write a stage partitioned for pruning by time, and return it as read back."""
        writer = df.write.mode("overwrite")
        columns = [c for c in partition_by if c in df.columns]
        (writer.partitionBy(*columns) if columns else writer).parquet(f"{self.root}/{name}")
        return self.load(name).select(*df.columns)

    def save_bucketed(self, df: DataFrame, name: str, buckets: int, by: Sequence[str] = KEYS,
                      partition_by: str = TIME) -> DataFrame:
        """A stage partitioned by time whose files are bucketed by entity.

        Windows, aggregates and joins by entity over it need no exchange (joins by entity and time also need
        ``spark.sql.requireAllClusterKeysForCoPartition=false``), and a release replaces its own partition
        (:meth:`replace_partitions`).  ``buckets`` fixes the number of tasks of those, so size it for the last year wanted:
        every bucket of every partition is a file, and a task reads its bucket of all partitions asked for.
        """
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        placed = df.repartition(buckets, *by).select(*[c for c in df.columns if c != partition_by], partition_by)
        (placed.write.mode("overwrite").partitionBy(partition_by).bucketBy(buckets, *by).sortBy(*by)
         .option("path", self._path(name)).saveAsTable(self._table(name)))
        return self.load_bucketed(name)

    def open_bucketed(self, name: str, schema: T.StructType, buckets: int, by: Sequence[str] = KEYS,
                      partition_by: str = TIME) -> DataFrame:
        """A bucketed stage an earlier session wrote, entered into this session's catalog and read."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        names = ", ".join(f"`{c}`" for c in by)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(name)} ({columns}) USING parquet PARTITIONED BY (`{partition_by}`) "
                       f"CLUSTERED BY ({names}) SORTED BY ({names}) INTO {buckets} BUCKETS LOCATION '{self._path(name)}'")
        self.spark.catalog.recoverPartitions(self._table(name))
        return self.load_bucketed(name)

    def load_bucketed(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def replace_partitions(self, df: DataFrame, name: str) -> DataFrame:
        """Write the partitions ``df`` has rows for in place of the old ones; other partitions' files stay as they are."""
        table = self.load_bucketed(name)
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in table.schema.fields])
        mode = self.spark.conf.get(OVERWRITE_MODE)
        self.spark.conf.set(OVERWRITE_MODE, "dynamic")  # a table insert takes it from the session only
        try:
            rows.write.insertInto(self._table(name), overwrite=True)
        finally:
            self.spark.conf.set(OVERWRITE_MODE, mode)
        self.spark.catalog.refreshTable(self._table(name))
        return self.load_bucketed(name)

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _table(self, name: str) -> str:
        """Catalog name of a stage: its own for every folder."""
        return f"stage_{hashlib.md5(self.root.encode()).hexdigest()[:12]}_{re.sub(r'[^a-z0-9]', '_', name.lower())}"

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def save_stats(self, stats: DataFrame, name: str) -> DataFrame:
        """Scaler statistics, to be applied to another panel later."""
        return self.save(stats, f"stats/{name}", partition_by=())

    def load_stats(self, name: str) -> DataFrame:
        return self.load(f"stats/{name}")

    def save_model(self, target: str, model: QuantileForestModel, **tables: DataFrame) -> None:
        """A target's forest with its tables: qhat, scores, metrics."""
        model.save(f"{self.root}/models/{target}")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/models/{target}/{name}")

    def load_model(self, target: str) -> QuantileForestModel:
        return QuantileForestModel.load(self.spark, f"{self.root}/models/{target}")

    def load_model_table(self, target: str, name: str) -> DataFrame:
        return self.load(f"models/{target}/{name}")
