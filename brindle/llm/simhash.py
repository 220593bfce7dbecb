"""SimHash near-dedup with anchor points from a covering code.

Fingerprints of 64 bits are linked when they differ in at most ``threshold`` (3 or less) bits. Two such fingerprints differ
in at most one bit in one of their halves, so each half is handled by itself with a threshold of one.

Anchors of a 32-bit half are the words of a covering code: the perfect Hamming code of 31 bits (every word lies within one
bit of exactly one code word), and the last bit as it is. A fingerprint's home is the anchor nearest to it, at most one bit
away. It is also sent to every anchor within the covering radius plus the threshold: the code words within two bits (16 at
most) with the same last bit, and the one within one bit with the other last bit. So whenever two halves differ in one bit
at most, each fingerprint reaches the other one's home, and a comparison within each anchor misses no link. There are 2^27
anchors for each half; a direct code for 64 bits and threshold 3 would need about 10,000 copies of each fingerprint.

Fingerprints are made distinct first, so copies cost nothing. An anchor's members are compared in blocks, a large anchor's
by equal bytes of the other half (of 32 bits that differ in 3 at most, one byte in four is equal), and of the links found
only a spanning forest leaves the task. Components are then found on that forest.

Defined results: null and empty texts have fingerprint zero and are linked like any other; rows with equal ids count as one
document where documents are kept; a null id never is a component's name unless all of its ids are null. Columns besides
the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_batches, map_rows, pick, renamed, stash
from brindle.llm.lines import ANYWHERE, CELL_BITS, candidates, cell_counts, feature_rows, key_filter, needed_keys, parities, verified
from brindle.operators.components import connected_components

SEED = 42
#: Sets of up to so many shingles have 64 and 128 parities, larger ones none.
LIMITS = (64, 160)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 values of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[size - 1 :].tolist())), np.uint64, len(words) - size + 1)


def print_of(hashes: np.ndarray) -> int:
    """Bit i is set when it is set in over half of the values."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit i is set when it is set in over half of the XXH64 values of the text's word shingles."""
    return print_of(shingle_hashes(text, shingle))


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of single bits of the Hamming code, and for each syndrome s the 15 pairs of bits whose syndromes add to s."""
    unit = np.arange(1, 32, dtype=np.uint32)
    pairs = np.zeros((32, 15), np.uint32)
    for s in range(1, 32):
        found = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)]
        pairs[s] = found
    return unit, pairs


_UNIT, _PAIRS = _code_tables()
_LOW = np.uint32(0x7FFFFFFF)
_TOP = np.uint32(0x80000000)


def home_anchor(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest anchor of each 32-bit half, and its syndrome."""
    syndrome = np.zeros(len(half), np.uint32)
    for i, u in enumerate(_UNIT):
        syndrome ^= np.where((half >> np.uint32(i)) & np.uint32(1), u, np.uint32(0))
    flip = np.where(syndrome > 0, np.uint32(1) << np.maximum(syndrome, 1).astype(np.uint32) - np.uint32(1), np.uint32(0))
    return half ^ flip, syndrome


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor keys, index of the fingerprint) for all anchors that a fingerprint is sent to; a key holds the half's number."""
    keys, rows = [], []
    own = np.arange(len(prints))
    for which in range(2):
        half = (prints >> np.uint64(32 * which)).astype(np.uint32)
        home, syndrome = home_anchor(half)
        mark = np.uint64(which) << np.uint64(32)
        for words in (home, home ^ _TOP):
            keys.append(words.astype(np.uint64) | mark)
            rows.append(own)
        off = np.flatnonzero(syndrome)
        two = half[off, None] ^ _PAIRS[syndrome[off]]
        keys.append(two.reshape(-1).astype(np.uint64) | mark)
        rows.append(np.repeat(off, 15))
    return np.concatenate(keys), np.concatenate(rows)


class _Forest:
    """Union-find over fingerprints; ``edges`` are those of stars round the smallest of each set."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def link(self, pairs: Iterator[tuple[int, int]]) -> None:
        for a, b in pairs:
            a, b = self.find(a), self.find(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(r, x) for x in self.up if (r := self.find(x)) != x]


def _near(a: np.ndarray, b: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Pairs of two blocks within the threshold, some pairs at a time."""
    step = max(1, (1 << 21) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= threshold)
        yield from zip(a[at + i].tolist(), b[j].tolist())


def _large_group(prints: np.ndarray, half: int, threshold: int, forest: _Forest) -> None:
    """Links within one anchor's many members: by equal bytes of the half that the anchor is not of."""
    other = np.uint64(32 * (1 - half))
    for byte in range(4):
        value = (prints >> (other + np.uint64(8 * byte))).astype(np.uint8)
        order = np.argsort(value, kind="stable")
        ends = np.flatnonzero(np.diff(value[order])) + 1
        for part in np.split(prints[order], ends):
            if len(part) > 1:
                forest.link(_near(part, part, threshold))


def links(read: Iterator[tuple[np.ndarray, np.ndarray]], threshold: int, large: int = 64) -> Iterator[list[tuple[int, int]]]:
    """Star edges of the links within anchors, from (keys, fingerprints) arrays in the order of their keys."""
    held_k, held_p = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def within(keys: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
        forest = _Forest()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        for s, n in zip(starts[sizes > large].tolist(), sizes[sizes > large].tolist()):
            _large_group(np.unique(prints[s : s + n]), int(keys[s] >> np.uint64(32)), threshold, forest)
        small = np.repeat((sizes > 1) & (sizes <= large), sizes)
        keys, prints = keys[small], prints[small]
        for k in range(1, large):
            same = np.flatnonzero(keys[k:] == keys[:-k])
            if not len(same):
                break
            a, b = prints[same], prints[same + k]
            hit = (np.bitwise_count(a ^ b) <= threshold) & (a != b)
            forest.link(zip(a[hit].tolist(), b[hit].tolist()))
        return forest.edges()

    for keys, prints in read:
        keys, prints = np.concatenate([held_k, keys]), np.concatenate([held_p, prints])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield within(keys[:cut], prints[:cut])
        held_k, held_p = keys[cut:], prints[cut:]
    if len(held_k):
        yield within(held_k, held_p)


def link_fingerprints(prints: DataFrame, threshold: int = 3) -> DataFrame:
    """(a, b): a spanning forest of the links between the distinct fingerprints (signed longs) of a one-column table."""
    if not 0 <= threshold <= 3:
        raise ValueError("the covering code is for thresholds 0 to 3")
    name = prints.columns[0]

    def replicate(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = np.asarray(batch.column(0).slice(at, 4096)).view(np.uint64)
                keys, rows = anchors(own)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own[rows].view(np.int64))], ["k", "p"])

    def compare(batches):
        read = ((np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)).view(np.uint64)) for b in batches)
        for edges in links(read, threshold):
            signed = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], ["a", "b"])

    sent = map_batches(prints.select(name), replicate, "k long, p long")
    # keys are below 2^33, so they sort alike as signed and unsigned numbers
    return map_batches(sent.repartition("k").sortWithinPartitions("k"), compare, "a long, b long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, f): the id and the fingerprint of each row's whole text, as a signed long. One pass, no shuffle."""
    table = pick(docs, id_col, text_col)
    kind = table.schema["c0"].dataType.simpleString()

    def rows(read):
        for key, text in read:
            value = fingerprint(text, shingle)
            yield key, value - (1 << 64) if value >> 63 else value

    return map_rows(table, f"id {kind}, f long", rows)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits) and component_id, the smallest id that links reach."""
    marked = stash(fingerprints(docs, id_col, text_col, shingle))
    classes = marked.groupBy("f").agg(F.min("id").alias("first"))
    found = connected_components(link_fingerprints(marked.select("f").distinct(), threshold))
    named = classes.join(found, classes.f == found.node, "left").select("f", "first", F.coalesce("component", "f").alias("root"))
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    whole = named.join(roots, "root").select(F.col("f").alias("g"), "component_id")
    return marked.join(whole, F.col("f") == F.col("g")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_values(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct XXH64 values of the text's word shingles, in ascending order."""
    return np.unique(shingle_hashes(text, shingle))


def shingle_links(docs: DataFrame, text_col: str, shingle: int, similarity: float, per_text: int = 64) -> DataFrame:
    """(a, b): fingerprints of texts whose sets of word shingles have a Jaccard similarity of ``similarity`` or more.

    Exact: two such sets lack less than a fifth (at 0.8) of each other's values, so of the values in one order for all each
    text sends one more than it can lack, and both send one that they share. Each sends a twentieth of its values on top, so
    alike texts meet in that many more, and texts that merely have a passage in common do not meet often enough to be compared.
    The order is from the rarest cell of values on, so what many texts have in common comes last: texts that share a common
    passage and little else never meet. Counts decide the cost, never the result. Fingerprints are connected, not all pairs sent.
    """
    texts = pick(docs, text_col)

    def unseen(read):
        """(hashes, distinct values) of texts whose values a task has not had lately."""
        seen: set[int] = set()
        for (text,) in read:
            hashes = shingle_hashes(text, shingle)
            if not len(hashes) or (mark := xxhash.xxh64_intdigest((own := np.unique(hashes)).tobytes())) in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add(mark)
            yield hashes, own

    # in 64ths of powers of two
    levels = np.round(64 * np.log2(1 + cell_counts(texts, lambda read: (own for _, own in unseen(read))))).astype(np.uint16)
    level = docs.sparkSession.sparkContext.broadcast(levels)

    def more(n):
        return np.minimum(np.asarray(n) // 20, np.ceil(similarity * np.asarray(n) - 1e-9).astype(np.int64) - 1)

    def sends(read):
        values: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        for hashes, own in unseen(read):
            n = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 + int(more(len(own)))
            first = own[np.argsort(level.value[(own >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")[:n]]
            # the first values have first bits of rare cells, so they are mixed for the lots
            mixed = (first ^ first >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            marks = parities(own, np.zeros(1, np.int64), np.array([len(own)]), LIMITS)
            sent = feature_rows(mixed, ANYWHERE, np.full(n, np.uint64(print_of(hashes))), np.full(n, len(own)), False, np.repeat(marks, n, axis=0), LIMITS)
            values.append(mixed)
            rows.append(sent)
            if len(values) > 512:
                yield np.concatenate(values), np.concatenate(rows)
                values, rows = [], []
        if values:
            yield np.concatenate(values), np.concatenate(rows)

    def alike(x, y):
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both) - 1e-9

    def judge(contents):
        return lambda i, j: np.array([alike(load(contents[x].as_buffer()), load(contents[y].as_buffer())) for x, y in zip(i.tolist(), j.tolist())], bool)

    def differ(n, m):
        return ((1 - similarity) / (1 + similarity) * (np.asarray(n) + m) + 1e-9).astype(np.int64)

    total = texts.agg(F.sum(F.length("c0"))).first()[0] or 0
    # about six characters to a word
    parts = 1 + int(total / 6 * (1 - similarity)) // (1 << 20)
    found = stash(candidates(texts, sends, similarity, per_text, parts, differ, differ, lambda n, m: 1 + more(np.minimum(n, m)), LIMITS))
    needed = stash(needed_keys(found))
    wanted = key_filter(needed)

    def sets(read):
        for (text,) in read:
            hashes = shingle_hashes(text, shingle)
            if len(hashes) and wanted(np.full(1, mark := print_of(hashes), np.uint64))[0]:
                yield mark - (1 << 64) if mark >> 63 else mark, np.unique(hashes).tobytes()

    load = lambda x: np.frombuffer(x, np.uint64)
    return verified(found, needed, map_rows(texts, "key long, content binary", sets), lambda rows: [load(x) for x in rows], judge, similarity, differ, 1024)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 3, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest id (null last), then text hash.

    Components are of texts linked by SimHash (``threshold`` bits) or by Jaccard similarity of their shingles. Rows of one
    id with different texts are different documents; of rows that repeat id and text one stays. An empty table stays empty.
    """
    table = pick(docs, id_col, text_col)
    kind = table.schema["c0"].dataType.simpleString()

    def rows(read):
        for key, text in read:
            value = fingerprint(text, shingle)
            # as F.xxhash64 has it, where a null is the seed
            mark = SEED if text is None else xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), SEED)
            yield key, mark - (1 << 64) if mark >> 63 else mark, value - (1 << 64) if value >> 63 else value

    marked = stash(map_rows(table, f"id {kind}, mark long, f long", rows))
    edges = link_fingerprints(marked.select("f").distinct(), threshold).unionByName(shingle_links(docs, text_col, shingle, similarity))
    found = connected_components(edges)
    first = marked.groupBy("f").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"))
    named = first.join(found, first.f == found.node, "left").groupBy(F.coalesce("component", "f").alias("root")).agg(F.min("first").alias("first"))
    keep = named.select(F.col("first.id").alias("k_id"), F.col("first.mark").alias("k_mark"))
    at = docs.columns.index
    flat = renamed(docs).withColumn("own", F.xxhash64(F.col(f"x{at(text_col)}")))
    key = f"x{at(id_col)}"
    # rows that repeat id and text are known without their texts, so only they are moved again to become one
    repeated = marked.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    same = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("mark") == F.col("k_mark"))
    keep = stash(keep.join(repeated, same, "left").select("k_id", "k_mark", F.col("n").isNotNull().alias("often")))
    stays = lambda often: flat.join(keep.where(often), F.col(key).eqNullSafe(F.col("k_id")) & (F.col("own") == F.col("k_mark")), "left_semi")
    return stays("NOT often").unionByName(stays("often").dropDuplicates([key, "own"])).drop("own").toDF(*docs.columns)
