"""Session helpers: shared scratch tables and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "gridloom", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests, benchmarks and the command line."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where none is configured a temporary folder serves a local session; on a cluster, where executors
    could not see it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete work tables that :func:`written` made, once nothing that is still to run reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each Spark context, unless they can be expected to have it.

    Functions that run in Python workers are sent by reference, so workers must be able to import them."""
    context = spark.sparkContext
    if getattr(context, "_gridloom_shipped", False):
        return
    context._gridloom_shipped = True
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "gridloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("gridloom", os.path.relpath(full, here)))
    context.addPyFile(target)
