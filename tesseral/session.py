"""Session helpers: the shared checkpoint folder and cutting of lineage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tesseral")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only on a local master, where that is unset, a temporary one is set."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="tesseral-shared-")
        spark.conf.set("spark.checkpoint.dir", have)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(have)
    return have


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once a context, where they don't have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tesseral_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    folder = tempfile.mkdtemp(prefix="tesseral-code-")  # read by the driver only, which serves it to executors
    path = os.path.join(folder, "tesseral_code.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._tesseral_shipped = True


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the stage tables of this application, once no frame made of them is in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and read it again.

    The written table survives the loss of executors, is stored once, and carries exact statistics into
    the planning of what follows (so size checks before a broadcast are measured, not guessed).
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
