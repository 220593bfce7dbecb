"""Property graphs as two DataFrames: vertices (id, value) and edges (src, dst, attr)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.columns import jaccard
from brindle.operators.components import connected_components
from brindle.operators.triples import dense_ids, distribution
from brindle.storage import map_batches, stash


def graph_of(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices are the distinct subjects and objects, numbered in their order; edges are the triples."""
    ends = triples.select(F.explode(F.array("subject", "object")).alias("value"))
    vertices = dense_ids(ends, "value")
    named = lambda key, out: vertices.select(F.col("value").alias(key), F.col("id").alias(out))
    edges = triples.join(named("subject", "src"), "subject").join(named("object", "dst"), "object").select("src", "dst", F.col("predicate").alias("attr"))
    return vertices, edges


def subgraph(edges: DataFrame, attr: str) -> DataFrame:
    """Edges with an attribute; vertices stay as they are."""
    return edges.where(F.col("attr") == attr)


def in_degrees(edges: DataFrame) -> DataFrame:
    return distribution(edges, "dst", "in_degree")


def graph_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_vertices, n_edges and max_in_degree."""
    v = vertices.agg(F.count(F.lit(1)).alias("n_vertices"))
    e = in_degrees(edges).agg(F.coalesce(F.sum("in_degree"), F.lit(0)).alias("n_edges"), F.coalesce(F.max("in_degree"), F.lit(0)).alias("max_in_degree"))
    return v.crossJoin(e)


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that undirected paths reach; vertices without edges are their own."""
    found = connected_components(edges, "src", "dst")
    return vertices.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def _rank_step(ranks: DataFrame, links: DataFrame, reset: float) -> DataFrame:
    sent = links.join(ranks, links.src == ranks.id).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
    return ranks.select("id").join(sent, F.col("id") == F.col("dst"), "left").select("id", (F.lit(reset) + F.lit(1 - reset) * F.coalesce("got", F.lit(0.0))).alias("rank"))


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").join(edges.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src")


def pagerank_fixed(vertices: DataFrame, edges: DataFrame, rounds: int, reset: float = 0.15, every: int = 8) -> DataFrame:
    """(id, rank) after so many rounds; ranks start at 1 and sum to the number of vertices where none is a dead end."""
    links = stash(_links(edges))
    ranks = vertices.select("id", F.lit(1.0).alias("rank"))
    for i in range(rounds):
        ranks = _rank_step(ranks, links, reset)
        if (i + 1) % every == 0:
            ranks = stash(ranks)
    return ranks


def pagerank(vertices: DataFrame, edges: DataFrame, tolerance: float = 1e-4, reset: float = 0.15, max_rounds: int = 200, every: int = 4) -> DataFrame:
    """(id, rank) once no rank moves by more than the tolerance, looked at every few rounds; ranks are stored in between."""
    links = stash(_links(edges))
    ranks = stash(vertices.select("id", F.lit(1.0).alias("rank")))
    for _ in range(0, max_rounds, every):
        new = ranks
        for _ in range(every):
            last, new = new, _rank_step(new, links, reset)
        new = stash(new)
        moved = new.join(ranks.withColumnRenamed("rank", "old"), "id").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new
        if moved is None or moved <= tolerance:
            break
    return ranks


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges a < b."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


#: Edges that a task is made to hold when triangles are sought (as far as COLOURS go), and paths that it makes at a time.
HELD, PATHS = 4_500_000, 1 << 20
#: Most colours of vertices; fewer are divisors of it.
COLOURS = 60


def _packed(a: np.ndarray, b: np.ndarray) -> bytes:
    """Distinct pairs in their order, by differences, byte plane by byte plane, compressed."""
    new = np.concatenate([[True], a[1:] != a[:-1]])
    first = np.where(new, a - np.concatenate([[0], a[:-1]]), 0)
    second = np.where(new, b, b - np.concatenate([[0], b[:-1]]))
    planes = np.concatenate([first, second]).astype("<i8").view(np.uint8).reshape(2 * len(a), 8).T
    return zlib.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    first, second = np.split(np.ascontiguousarray(planes.T).view("<i8")[:, 0], 2)
    a, sums = np.cumsum(first), np.cumsum(second)
    # the first of each vertex is a whole number, the others are differences from the one before
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return a, sums - np.repeat(sums[starts] - second[starts], np.diff([*starts, len(a)]))


def _sorted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new], b[new]


def _colour(v: np.ndarray, colours: int) -> np.ndarray:
    x = v.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((x >> np.uint64(40)) * np.uint64(colours) >> np.uint64(24)).astype(np.int64)


def closed_paths(a: np.ndarray, b: np.ndarray, colours: int, wanted: tuple[int, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, c), ascending, of the triangles of distinct edges whose corners have just the wanted colours.

    Edges point from the end of lower degree to the other, so a vertex has few successors however many neighbours it has.
    """
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    degree = np.bincount(ends)
    # vertices are renumbered by degree
    order = np.argsort(degree, kind="stable")
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order))
    x, y = np.split(turn[ends], 2)
    x, y = np.minimum(x, y), np.maximum(x, y)
    names = names[order]
    code = np.sort(x * len(names) + y)
    x, y = code // len(names), code % len(names)
    bits = max(16, len(code).bit_length() + 4)
    cell = lambda c: (c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
    known = np.zeros(1 << bits, bool)
    known[cell(code)] = True
    tint = 1 << np.searchsorted(wanted, _colour(names, colours))
    full = (1 << len(wanted)) - 1
    # each edge meets those after it that leave the same vertex; some edges have very many, so they are cut
    last = np.searchsorted(x, x, side="right")
    left = last - np.arange(len(x)) - 1
    sums = np.cumsum(left)
    for low in range(0, int(sums[-1]) if len(sums) else 0, PATHS):
        path = np.arange(low, min(low + PATHS, int(sums[-1])))
        e, f = int(np.searchsorted(sums, low, side="right")), int(np.searchsorted(sums, path[-1], side="right")) + 1
        begin = sums[e:f] - left[e:f]
        one = np.repeat(np.arange(e, f), np.minimum(sums[e:f], path[-1] + 1) - np.maximum(begin, low))
        two = one + 1 + path - (sums[one] - left[one])
        right = tint[x[one]] | tint[y[one]] | tint[y[two]] if len(wanted) > 1 else np.full(len(one), full)
        asked = y[one] * len(names) + y[two]
        may = np.flatnonzero((right == full) & known[cell(asked)])
        at = np.minimum(np.searchsorted(code, asked[may]), len(code) - 1)
        hit = may[code[at] == asked[may]]
        if len(hit):
            corners = np.sort(np.stack([names[x[one[hit]]], names[y[one[hit]]], names[y[two[hit]]]]), axis=0)
            yield tuple(corners)


def _by_colours(edges: DataFrame, found: Callable, schema: str) -> DataFrame:
    """What ``found`` makes of the triangles (a, b, c) of each task.

    Vertices have colours. An edge goes, packed, to the block of its colours, where repeated ones are dropped, and from there
    with the whole block to each set of three colours that has both of its own; the task of a set has all triangles of corners
    of just these colours (sets of one and two are tasks as well). So no path is moved, and an edge is sent as often as there
    are colours, in few bytes. The ends are whole numbers.
    """
    edges = edges.where("src != dst").select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
    # blocks of colours, from few edges each, are what is counted
    whole = stash(map_batches(edges, _dealt(COLOURS), "block int, n long, data binary"))
    size = whole.agg(F.sum("n")).first()[0] or 0
    # a set of three colours has three blocks of 2 / colours^2 of the edges
    colours = next(c for c in range(1, COLOURS + 1) if COLOURS % c == 0 and (c == COLOURS or 6 * size <= HELD * c * c))
    width = COLOURS // colours

    def merge(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(block, []).append(data)
        while held:
            block, parts = held.popitem()
            own = divmod(block, COLOURS)
            a, b = _sorted_pairs(*(np.concatenate(x) for x in zip(*map(_unpacked, parts))))
            sets = {tuple(sorted({*own, other})) for other in range(colours)}
            for low in range(0, len(a), 1 << 20):
                data = _packed(a[low : low + (1 << 20)], b[low : low + (1 << 20)])
                for to in sets:
                    yield pa.RecordBatch.from_arrays([pa.array([",".join(map(str, to))]), pa.array([data], pa.binary())], ["colours", "data"])

    def close(batches):
        held: dict[str, list[bytes]] = {}
        for batch in batches:
            for to, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(to, []).append(data)
        while held:
            to, parts = held.popitem()
            a, b = (np.concatenate(x) for x in zip(*map(_unpacked, parts)))
            yield from found(closed_paths(a, b, colours, tuple(map(int, to.split(",")))))

    fewer = F.floor(F.floor(F.col("block") / COLOURS) / width) * COLOURS + F.floor(F.col("block") % COLOURS / width)
    blocks = whole.select(fewer.cast("int").alias("block"), "data")
    tasks = colours * (colours + 1) // 2
    sent = map_batches(blocks.repartition(tasks, "block"), merge, "colours string, data binary")
    sets = tasks + colours * (colours - 1) * (colours - 2) // 6
    return map_batches(sent.repartition(sets, "colours"), close, schema)


def _dealt(colours: int) -> Callable:
    """Batches of edges as blocks by the colours of their ends, each packed."""

    def run(batches):
        held, rows = [], 0

        def done():
            a, b = (np.concatenate(x) for x in zip(*held))
            low, high = np.minimum(a, b), np.maximum(a, b)
            p, q = _colour(low, colours), _colour(high, colours)
            block = np.minimum(p, q) * COLOURS + np.maximum(p, q)
            order = np.lexsort((high, low, block))
            low, high, block = low[order], high[order], block[order]
            new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            low, high, block = low[new], high[new], block[new]
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist()
            ends = [*starts[1:], len(block)]
            data = [_packed(low[s:e], high[s:e]) for s, e in zip(starts, ends)]
            columns = [pa.array(block[starts], pa.int32()), pa.array([e - s for s, e in zip(starts, ends)], pa.int64()), pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "n", "data"])

        for batch in batches:
            if batch.num_rows:
                # ends that are null are in no triangle
                whole = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
                held.append((whole.column(0).to_numpy(zero_copy_only=False), whole.column(1).to_numpy(zero_copy_only=False)))
                rows += whole.num_rows
            if rows >= HELD:
                yield done()
                held, rows = [], 0
        if rows:
            yield done()

    return run


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of every triangle, once, ascending."""

    def rows(read):
        for corners in read:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in corners], ["a", "b", "c"])

    return _by_colours(edges, rows, "a long, b long, c long")


def triangle_count(edges: DataFrame) -> DataFrame:
    def count(read):
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(c[0]) for c in read)], pa.int64())], ["n"])

    return _by_colours(edges, count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_triangles"))


def neighbour_similarity(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v1, v2, jaccard) of the neighbour sets of pairs of vertices, by counting shared neighbours in a join."""
    sets = edges.select(F.col("src").alias("v"), F.col("dst").alias("n")).distinct()
    sizes = sets.groupBy("v").agg(F.count(F.lit(1)).alias("size"))
    side = lambda n: sets.select(F.col("v").alias(f"v{n}"), "n")
    shared = pairs.join(side(1), "v1").join(side(2), ["v2", "n"]).groupBy("v1", "v2").agg(F.count(F.lit(1)).alias("shared"))
    size = lambda n: sizes.select(F.col("v").alias(f"v{n}"), F.col("size").alias(f"size{n}"))
    out = pairs.join(size(1), "v1").join(size(2), "v2").join(shared, ["v1", "v2"], "left")
    both = F.coalesce("shared", F.lit(0))
    return out.select("v1", "v2", (both / (F.col("size1") + F.col("size2") - both)).alias("jaccard"))


def group_similarity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(v1, v2, jaccard) of the neighbour sets of all pairs v1 < v2 of vertices (v, group) of a group, where both have some.

    Shared neighbours are counted where vertices of a group meet at a neighbour, so pairs without any cost one narrow row.
    """
    groups = groups.distinct()
    sets = edges.select(F.col("src").alias("v"), F.col("dst").alias("n")).distinct()
    sized = groups.join(sets.groupBy("v").agg(F.count(F.lit(1)).alias("size")), "v")
    member = lambda df, n, *more: df.select("group", F.col("v").alias(f"v{n}"), *more)
    at = sets.join(groups, "v")
    met = member(at, 1, "n").join(member(at, 2, "n"), ["group", "n"]).where("v1 < v2").groupBy("group", "v1", "v2").agg(F.count(F.lit(1)).alias("shared"))
    pairs = member(sized, 1, F.col("size").alias("size1")).join(member(sized, 2, F.col("size").alias("size2")), "group").where("v1 < v2")
    both = F.coalesce("shared", F.lit(0))
    out = pairs.join(met, ["group", "v1", "v2"], "left")
    return out.select("v1", "v2", (both / (F.col("size1") + F.col("size2") - both)).alias("jaccard"))


def name_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the edit distance of their names and the Jaccard similarity of their letters."""
    letters = lambda c: F.array_distinct(F.split(F.lower(F.col(c)), ""))
    return pairs.withColumn("edit_distance", F.levenshtein(a, b)).withColumn("letters", jaccard(letters(a), letters(b)))


def top_components(ranks: DataFrame, labels: DataFrame, n: int = 5) -> DataFrame:
    """The components with the greatest sum of ranks."""
    sums = labels.join(ranks, "id").groupBy("component").agg(F.sum("rank").alias("rank"), F.count(F.lit(1)).alias("n_vertices"))
    return sums.orderBy(F.col("rank").desc(), "component").limit(n)
