"""Reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> None:
    """Make sure a checkpoint folder is set: the one the session names, else, in local mode only, a temporary one.

    Executors of a cluster can't read a folder of the driver's machine, so there the setting is required.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can read")
        named = tempfile.mkdtemp(prefix="foliant-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there.

    An executor may be lost at any time: the rows are in the shared folder, so later
    stages read them again instead of recomputing what led to them.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """Like `cut`, as a Parquet table: compressed, and read by column. It is removed when the driver ends."""
    spark = df.sparkSession
    _checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/foliant-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


_SHIPPED: set[str] = set()


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), with this package sent to the executors once an application."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        at = tempfile.mkdtemp(prefix="foliant-package-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        here = Path(__file__).parent
        with zipfile.ZipFile(f"{at}/foliant.zip", "w") as z:
            for f in here.rglob("*.py"):
                z.write(f, Path("foliant") / f.relative_to(here))
        sc.addPyFile(f"{at}/foliant.zip")
    return df.mapInArrow(run, schema)


def local_file(path: str) -> str:
    """`path` if it exists, else an error that says which parameter to set."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path}: pass the path of the file as a parameter")
    return path
