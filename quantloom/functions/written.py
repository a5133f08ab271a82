"""Tables written between the rounds of an iteration: they cut the lineage, and lost executors repeat their own tasks only."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Rounds:
    """Writes one table a round to the folder that all executors share, and drops the one before it."""

    def __init__(self, spark: SparkSession):
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        self.spark, self.n = spark, 0
        self.root = f"{shared or tempfile.mkdtemp()}/rounds-{uuid.uuid4().hex}"
        atexit.register(self._quiet_drop)

    def write(self, df: DataFrame) -> DataFrame:
        """df as a written table. Of the tables written here the two newest stay: the new one may be read from the old."""
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        if self.n > 2:
            self._delete(f"{self.root}/{self.n - 2}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _quiet_drop(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; the shared folder is then cleaned by its owner
            pass
