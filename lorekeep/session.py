"""Sessions, and the package's own code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lorekeep", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers of every executor; once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_lorekeep_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lorekeep-code-")
    to = os.path.join(folder, "lorekeep.zip")
    with zipfile.ZipFile(to, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    sc.addPyFile(to)
    sc._lorekeep_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local master, as in tests, may do without the setting and gets a temporary folder; a cluster may not.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lorekeep-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back.

    Later stages read only the columns they need, and a lost executor never costs a recomputation. release() deletes
    the table once nothing reads it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lorekeep-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def release(*frames: DataFrame) -> None:
    """Deletes the tables behind frames that stored() returned; for steps whose results have been stored in turn."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
