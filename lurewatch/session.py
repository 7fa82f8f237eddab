"""Session set-up for local runs, and the shared scratch folder of a session."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

INPUT_PARTITIONS = "spark.lurewatch.input.partitions"


def local_session(cores="8", app="lurewatch", **conf):
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", os.environ.get("LUREWATCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lurewatch-"))
        .config(INPUT_PARTITIONS, str(cores))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark):
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where nothing is set (local runs and tests) a folder of this machine is made and set, and only
    when all executors are threads of this process: on a cluster such a folder would be lost with its machine.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not conf.get("spark.master", "").startswith("local") or "cluster" in conf.get("spark.master"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="lurewatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark, name):
    """A new, unused path in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df, name="table", made=None):
    """Write ``df`` to a table in the shared folder and read it back. ``made``: a list that gets the path.

    Cuts lineage with files that outlive the executors, so a lost executor never makes a costly or
    unrepeatable step (an expert call, a model score) run again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_partitions(df):
    """``df`` dealt out evenly to as many partitions as the session asks for in ``INPUT_PARTITIONS``.

    Meant for few large files of one row group each, which Spark cannot split. It holds at every size; where
    the setting is absent, as on a cluster with many files, the scan's own partitions stay.
    """
    wanted = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df if wanted is None else df.repartition(int(wanted))
