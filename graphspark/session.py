"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def find_package(spark: SparkSession) -> None:
    """Python workers of a session started in another folder find this package where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in one process."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there:
        return there
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    made = tempfile.mkdtemp(prefix="graphspark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems; one that isn't there is no error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Estimated bytes beyond which an estimate is dropped.
ABSURD = 1 << 62


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there, so that a lost executor costs no long lineage.

    A checkpoint keeps the planner's estimate of its size. Joins multiply estimates, so in a loop their digits double from
    round to round until planning takes longer than the work; estimates beyond ABSURD are therefore not carried on.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    plan = out._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) <= ABSURD:
        return out
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), out._jdf.schema(), False), spark)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
