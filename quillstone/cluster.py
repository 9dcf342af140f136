"""What every operator needs of the session: importable workers and a shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, one of our own on a local master (tests) and an error on any other."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if told is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            told = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        sc.setCheckpointDir(told)
    return (told or sc.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df without its lineage, from the shared folder (reliable: survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


class Scratch:
    """Parquet tables in the shared folder that end with their job: `put` writes and rereads, `close` deletes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/quillstone-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        to = f"{self.path}/{name}-{self.n}"
        df.write.mode("overwrite").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def close(self) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
