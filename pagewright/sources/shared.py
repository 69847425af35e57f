"""Cut points: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder. Where none is set, only a session within one
    process (local[n]) gets a temporary one: executors elsewhere wouldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: this needs a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pagewright-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_folder"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the folders of written tables that nothing reads any more."""
    for df in tables:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.__dict__["_folder"])
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
