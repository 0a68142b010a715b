"""Session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# Merging scalar subqueries of several nesting levels leaves unresolved references behind
# ("Cannot generate code for expression: scalarsubqueryreference") in Spark 4.1.
EXCLUDED_RULES = "spark.sql.optimizer.excludedRules"
MERGE_RULE = "org.apache.spark.sql.catalyst.optimizer.MergeScalarSubqueries"


def keep_subqueries_apart(spark: SparkSession) -> None:
    excluded = spark.conf.get(EXCLUDED_RULES, None) or ""
    if MERGE_RULE not in excluded:
        spark.conf.set(EXCLUDED_RULES, ",".join(filter(None, [excluded, MERGE_RULE])))


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session, and send it this package."""
    ship(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    keep_subqueries_apart(spark)
    return spark


def local_session(app: str = "cairntrace", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and single-machine runs."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers find it
    wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_cairntrace_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), "cairntrace.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._cairntrace_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: `spark.checkpoint.dir`.  Only a local session may do
    without it and gets a fresh folder; executors elsewhere would not see one of the driver's."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jdir.get() if jdir.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts long lineage (and the planning
    time it costs every later step), is computed once, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
