"""Session helpers: the settings the library expects and the shared working folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, app: str = "tallyguard") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without the setting gets a fresh temporary folder. On a cluster a
    missing setting is an error, because a machine-local folder would not outlive its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tallyguard-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df):
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a range that one task sorts.
RANGE_ROWS = 2_000_000


def partition_target(spark: SparkSession, rows: int, low: int = 8) -> int:
    """How many ranges to cut ``rows`` sorted rows into: the shuffle width, or more if a range
    would hold over RANGE_ROWS rows."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(low, width, -(-rows // RANGE_ROWS))
