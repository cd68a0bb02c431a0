"""Session helpers: table loading and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; a private one only where none is named and all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairnset-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (never a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan of fewer splits than there are cores over all of them, for work that costs far more than moving its input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def salted_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """Join on one key whose rows on the left may be very unevenly spread.

    The left rows of a key are dealt over `salts` sub-keys by a hash of the whole row, and each right row is
    repeated once per sub-key, so a hot key costs `salts` tasks instead of one. `right` must be unique by key.
    """
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    salted = left.withColumn("__salt", spread)
    copies = right.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted.join(copies, [on, "__salt"], how).drop("__salt")


def squeeze(c: Column) -> Column:
    """Lower case, outer white space removed, inner runs as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def ship(spark: SparkSession) -> None:
    """Give the workers this package, whatever their working directory: once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_cairnset_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="cairnset-code-"), "cairnset.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("cairnset", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._cairnset_shipped = True
