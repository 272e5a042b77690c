"""Sessions and scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    base = {
        "spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.appName("factloom").config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a private one, which only suits a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("a cluster must name its shared folder in spark.checkpoint.dir")
        local = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write and read again: cuts the lineage, and outlives the executors that made it. Keys in hexadecimal take half
    the space with zstd."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
