"""Session settings the library relies on, and the two ways it cuts lineage."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_GROUP = "feedweave.rowsPerGroup"
DEFAULT_ROWS_PER_GROUP = 1_000_000


def pin_session(spark: SparkSession) -> SparkSession:
    """Feed clocks are instants: every operator expects the session to run in UTC.

    Checks of whole records make long methods. Above 8,000 bytes the JVM never compiles a method, so such a stage is
    better run operator by operator, where expressions are split over short methods.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def local_session(name: str, cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        # Checkpoints nobody refers to any more are deleted.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Call sites of every column expression are not needed, and recording them makes wide checks slow to build.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return pin_session(spark)


def rows_per_group(spark: SparkSession, override: int | None = None) -> int:
    """Most rows one task may have to walk in order for one key before the key is split."""
    return override or int(spark.conf.get(ROWS_PER_GROUP, str(DEFAULT_ROWS_PER_GROUP)))


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names (`spark.checkpoint.dir`).

    Executors may be lost at any time, so the copy lives in shared storage, never on an executor. Only where
    the session names no folder (tests) one next to the warehouse is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as Parquet in shared storage, read back from there; what was in the folder is replaced.

    For whole records of which later steps read some columns each: a checkpoint hands on every row whole and
    uncompressed to all of them. Without a folder a new one in the shared folder is taken.
    """
    folder = folder or f"{shared_folder(df.sparkSession)}/rows-{uuid4().hex}"
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate results, set up for checkpoints if it was not."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return context.getCheckpointDir()
