"""Array sources: IDX tensors, random data, swarms."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import ship


def decode_idx(data: bytes) -> np.ndarray:
    """An IDX tensor of unsigned bytes, gzipped or not."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    zero, kind, dims = struct.unpack(">HBB", data[:4])
    if zero or kind != 8:
        raise ValueError("not an IDX tensor of unsigned bytes")
    shape = struct.unpack(f">{dims}I", data[4 : 4 + 4 * dims])
    return np.frombuffer(data, np.uint8, int(np.prod(shape)), 4 + 4 * dims).reshape(shape)


def read_idx(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, values): a row for each first index of the tensors at ``path``."""
    ship(spark)

    def run(frames):
        for f in frames:
            for path, data in zip(f["path"], f["content"]):
                rows = decode_idx(bytes(data))
                flat = rows.reshape(len(rows), -1).astype(float)
                for at in range(0, len(flat), 1024):
                    part = flat[at : at + 1024]
                    yield pd.DataFrame({"path": path, "idx": range(at, at + len(part)), "values": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, idx long, values array<double>")


def linear_data(spark: SparkSession, n: int, a: float = 2.0, b: float = 7.0, noise: float = 0.3, seed: int = 0) -> DataFrame:
    """(x, y, y_true): y = a x + b and normal noise of half of ``noise``, the same for equal seeds on any partitioning."""
    unit = lambda salt: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 30)).cast("double") + 0.5) / (1 << 30)
    normal = F.sqrt(-2 * F.log(unit("u"))) * F.cos(2 * np.pi * unit("v"))
    out = spark.range(n).select(unit("x").alias("x"), (normal * noise / 2).alias("e"))
    return out.select("x", (a * F.col("x") + b + F.col("e")).alias("y"), (a * F.col("x") + b).alias("y_true"))


def random_swarm(spark: SparkSession, particles: int, dim: int, seed: int = 0) -> DataFrame:
    """(p_id, position, velocity, best): uniform in [0, 1)."""
    unit = lambda name: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed), F.lit(name)), F.lit(1 << 30)).cast("double") / (1 << 30))
    return spark.range(particles).select(F.col("id").cast("int").alias("p_id"), *(unit(n).alias(n) for n in ("position", "velocity", "best")))


def zip_rows(left: DataFrame, right: DataFrame, key: str = "idx") -> DataFrame:
    """Rows of two tables with equal indices, side by side."""
    return left.join(right, key)
