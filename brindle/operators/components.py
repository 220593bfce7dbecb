"""Connected components of an edge table, by alternating large and small stars.

Each round rewires every node to smaller neighbours; the edges end as stars round each component's smallest node. A round
is a few joins and aggregations by node, its result is written to the shared folder, and nothing but a count and a checksum
of the edges comes to the driver. Minima are combined before they are shuffled, so a node with very many edges costs its
task one row for each task before it; the join that follows is one that Spark can split.

An edge table that is counted to be small is finished by one task, by union-find; larger ones shrink by rounds, and go on
by rounds if they stay large.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from brindle.storage import map_batches, stash


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def smallest_reachable(edges: Iterator[tuple]) -> dict:
    """node -> smallest node of its component, by union-find."""
    up: dict = {}

    def find(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(up)}


def _by_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType
    schema = StructType([StructField("node", kind), StructField("component", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = smallest_reachable(pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip((found.keys(), found.values()), arrow)], schema=arrow)

    return map_batches(edges.coalesce(1), run, schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100, small: int = 500_000) -> DataFrame:
    """(node, component) for every node that has an edge to another; the component is its smallest node.

    Edges with a null end and loops are left out; edges may repeat, in either direction. Up to ``small`` edges go to one task.
    """
    now = stash(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] <= max(small, 0):
            return stash(_by_one_task(now))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node move to the smallest in its neighbourhood
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("m").alias("u"), "v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of those
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        stars = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), "v"))).alias("e")).select("e.*")
        now = stash(stars.where("u != v").distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
