"""Session settings, and the one shared scratch folder that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  All of them are runtime settings, so they can
# be applied to a session the cluster has already started.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches for Python are cut by bytes as well as by rows: one page or text may be very long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def build_session(app: str = "catalogspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; broadcast sizes and partition counts stay the cluster's."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_PRIVATE_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only in local mode, where none is named (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _PRIVATE_ROOTS:
        _PRIVATE_ROOTS[application] = tempfile.mkdtemp(prefix="catalogspark-")
    return _PRIVATE_ROOTS[application]


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the shared folder, never used before and never reused."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the rows are on shared storage, so a lost executor costs nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=eager)


ROWS_PER_TASK = 20_000


def tasks_for(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))


def spread(df: DataFrame, *by: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows dealt to at least as many tasks as there are cores, and to more as they grow in number.

    For steps that cost far more per row than its bytes tell, such as pages rendered from a few columns: by its bytes such
    a table is one task.  It is dealt while it is narrow, and counted first, which a Parquet file answers by its footer.
    """
    return df.repartition(tasks_for(df, rows_per_task), *by)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write once to the shared folder and read back: for frames that several branches use.

    What the write has shuffled is of no more use then, and its files go at once, not when the driver collects garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, purpose)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
