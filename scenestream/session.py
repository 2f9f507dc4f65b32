"""Session settings the plans rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Length of one time slice. Detections are clustered by (camera_id, slice), so no task ever holds
# more of one camera or one track than a slice of it.
SLICE_KEY = "spark.scenestream.sliceMs"
DEFAULT_SLICE_MS = 600_000


def tune(spark: SparkSession) -> SparkSession:
    """Apply runtime settings. Static settings (memory, cores) stay with the cluster."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Joins on (camera_id, slice, frame_seq) may use data already clustered by (camera_id, slice).
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def slice_ms(spark: SparkSession) -> int:
    return int(spark.conf.get(SLICE_KEY, str(DEFAULT_SLICE_MS)))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. Only a local session without a setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


# Removes the shuffle files of an execution when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write a result to the shared folder and read it again: it is computed once and survives lost executors.

    Nothing reads the shuffle files behind a written table again, so they go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Configuration rows as a table whose size the planner knows, so that it chooses how to join it."""
    kind = StructType.fromDDL(schema)
    columns = zip(*rows) if rows else [[] for _ in kind]
    arrays = [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, kind)]
    return spark.createDataFrame(pa.table(dict(zip(kind.names, arrays))), kind)


def local_session(cores: str = "*", partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scenestream")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
