"""File-system operations by Hadoop's API, so that they take the same URIs as readers do; and stored models and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def list_files(spark: SparkSession, path: str) -> list[str]:
    fs, p, _ = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p))


def make_folder(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.mkdirs(p)


def remove(spark: SparkSession, path: str, recursive: bool = False) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.delete(p, recursive)


def copy(spark: SparkSession, source: str, target: str) -> bool:
    a, p, jvm = _fs(spark, source)
    b, q, _ = _fs(spark, target)
    return jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, local: str, target: str) -> None:
    fs, q, jvm = _fs(spark, target)
    fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(local), q)


def get(spark: SparkSession, source: str, local: str) -> None:
    fs, p, jvm = _fs(spark, source)
    fs.copyToLocalFile(False, p, jvm.org.apache.hadoop.fs.Path(local), True)


def save_vectors(vectors: DataFrame, path: str, overwrite: bool = True) -> None:
    """An embedding table (id, vec)."""
    vectors.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metrics(spark: SparkSession, run: str, split: str, name: str, values: list[float]) -> DataFrame:
    """(run, split, step, name, value) of a training run."""
    return spark.createDataFrame([(run, split, i, name, float(v)) for i, v in enumerate(values)], "run string, split string, step int, name string, value double")


def read_scalar(table: DataFrame, name: str) -> DataFrame:
    return table.where(table["name"] == name).orderBy("step").select("step", "value")
