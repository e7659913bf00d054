"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Sub-folder of the shared folder that holds this package's intermediate tables.
TABLES = "thinjoin"


def local_session(cores: str = "*", name: str = "thinjoin", partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share for intermediate tables.

    ``spark.checkpoint.dir`` of the session, else the folder given to ``SparkContext.setCheckpointDir``. Without either
    a cluster job stops; only a session whose driver runs the tasks itself (tests) gets a folder under
    ``spark.sql.warehouse.dir``.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{TABLES}/{name}-{uuid.uuid4().hex}"


def drop_intermediate(spark: SparkSession, name: str | None = None) -> None:
    """Delete the intermediate tables made under ``name``, or all that this package made in the shared folder.

    For the end of a job: plans that still read such a table fail afterwards.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{TABLES}")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return
    for entry in files.listStatus(root):
        if name is None or entry.getPath().getName().startswith(f"{name}-"):
            files.delete(entry.getPath(), True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a derived table is small but feeds several plans (group parameters, key statistics). The table that
    comes back carries its true size, so Spark broadcasts it only while it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and joins by shuffle beyond that. It also ends the lineage without
    depending on any executor staying alive.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
