"""Reading the tables of a directory, and cutting lineage where a plan is used again and again."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table name of a directory, as a file or a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the shared one that the session names in spark.checkpoint.dir."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = os.path.join(os.getcwd(), "spark-checkpoint")  # one machine: beside the warehouse
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """A reliable checkpoint of df: written once to the shared folder, so lost executors cost nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)
