"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Removes the shuffle files of a write when it is done.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "cloneflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; `conf` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where the session names none, a folder below the warehouse, which is shared as well."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    folder = named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_steps"
    if not named and folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} is a folder of one machine: name one that all machines share in {CHECKPOINT_DIR}")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below one folder per application, which can be removed when the application has ended."""
    return f"{shared_dir(spark)}/cloneflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a written table, which outlives any executor and has exact size statistics. What was shuffled for it is removed at once."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` has written and nothing reads any more."""
    spark = df.sparkSession
    own = f"/cloneflow/{spark.sparkContext.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a plain scan that yields fewer tasks than the cluster has cores.

    Large inputs already have more splits than cores and pass through without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)
