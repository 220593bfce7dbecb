"""Tables in the shared folder, and Arrow mapping with this package on the executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from brindle.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``; a temporary one only where that is unset
    and everything runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="brindle-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Spark then drops an execution's shuffle files when it ends, not when the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The bytes of rows that are made ready for Python at once: both sides hold some such batches for each task.
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def stash(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}"
    before = {_CLEAN_UP: spark.conf.get(_CLEAN_UP, "false"), _BATCH: spark.conf.get(_BATCH)}
    spark.conf.set(_CLEAN_UP, "true")
    spark.conf.set(_BATCH, _BATCH_BYTES)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow`` after this package was given to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
