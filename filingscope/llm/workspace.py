"""Tables written between the steps of one operator call.

Lineage is cut by writing Parquet to the folder that the cluster names in
``spark.checkpoint.dir`` and reading it back, so that a lost executor costs the
tasks that it ran and nothing more, and no step is computed twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders of this process's operator calls.
MADE: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete what all operator calls of this process have written between their steps, once their results are saved elsewhere."""
    while MADE:
        delete(spark, MADE.pop())


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master may do without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its input has fewer splits than there are cores; a larger input stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one, row; ``row.*`` gives them back under their names, whatever those are."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)).alias("row")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()  # noqa: SLF001
    path = jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(conf).delete(path, True)


class Workspace:
    """A folder of its own for one operator call, below the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        MADE.append(self.path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        self._count += 1
        path = f"{self.path}/{self._count:03d}-{name}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._workspace_path = path  # noqa: SLF001  for drop()
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        for table in tables:
            delete(self.spark, table._workspace_path)  # noqa: SLF001
