"""LM scoring: cross-entropy difference of a target and a background bigram model.

Both models have the same order, smoothing and vocabulary (all words of both corpora, lower case, and the end of the text).
The probability of word w after h is (c(h, w) + a) / (c(h) + a V), V being the size of the shared vocabulary; the addend a is
``alpha`` times the corpus's share of all tokens, so that both models are smoothed alike however large they are. A
document's score is its mean loss a token under the target model less that under the background model: the lower, the more
like the target. The difference is a sum of one term for each bigram and one for each history, so each kind of term is
looked up by itself. A document's own occurrences are taken out of the counts of the corpus that holds it, so that no
document is scored by what a model remembers of it alone; of a document that occurs twice, the other copy stays.

Everything is counted over all documents and grows with them; nothing of the models is held by one process but terms whose
number is bounded: those of at least 1 / ``hot`` of all tokens (at most ``hot`` bigrams and ``hot`` histories), which every
task gets. Texts are read twice and never shuffled. A block of documents sends to each shard of the key space its distinct
keys with counts (first pass), and then its distinct other keys with the documents they occur in (second pass); a shard
streams through the requests with its part of the model in memory. The number of shards follows the size of the texts.

Defined results: null and empty texts are one event (the end after the start). A null target flag counts as background. Rows
with equal ids are scored one by one. If one corpus is empty its model is uniform; an empty table gives an empty one. Columns
besides the named are not read. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_rows, pick, renamed, stash

START, END = np.uint64(0x5374617274000001), np.uint64(0x456E640000000003)
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    x = (x ^ (x >> np.uint64(29))) * _C
    return x ^ (x >> np.uint64(32))


def events(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram keys, history keys, document positions) of all events of some texts. Bigram keys are even, history keys odd."""
    words = [(t or "").lower().encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(w) for w in words])
    flat = np.fromiter((h for w in words for h in map(xxhash.xxh3_64_intdigest, w)), np.uint64, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
    full = np.empty(len(flat) + 2 * len(texts), np.uint64)
    inner = np.ones(len(full), bool)
    inner[starts] = inner[starts + sizes + 1] = False
    full[starts], full[starts + sizes + 1], full[inner] = START, END, flat
    first = np.ones(len(full), bool)
    first[starts + sizes + 1] = False
    at = np.flatnonzero(first)
    before, after = full[at], full[at + 1]
    one = np.uint64(1)
    return _mix(before * _A + after) & ~one, _mix(before + _B) | one, np.repeat(np.arange(len(texts)), sizes + 1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as compressed differences, byte plane by byte plane (high planes are almost all zero)."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return _PACK.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNPACK.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8")[:, 0], dtype=np.uint64)


def pack_counts(counts: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as compressed byte planes."""
    width = np.dtype(kind).itemsize
    return _PACK.compress(counts.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes())


def unpack_counts(data: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(_UNPACK.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def _blocks(read: Iterator[tuple], text_at: int, tokens: int) -> Iterator[list[tuple]]:
    """Rows in blocks of about so many tokens (by a rough count), of 60,000 rows at most."""
    held, size = [], 0
    for row in read:
        held.append(row)
        size += len(row[text_at] or "") // 6 + 1
        if size >= tokens or len(held) >= 60_000:
            yield held
            held, size = [], 0
    if held:
        yield held


def _by_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys, so ascending keys are in the order of their shards, and differences within one are small."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _cuts(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of the runs of a sorted array."""
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else [0]
    for s, e in zip(edges[:-1], edges[1:]):
        yield int(shard[s]), int(s), int(e)


def _sum_by_key(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], *(np.add.reduceat(c[order], starts) if len(keys) else c for c in counts)


def _groups(read: Iterator[tuple]) -> Iterator[tuple[object, Iterable[tuple]]]:
    """Runs of rows with an equal first column, each to be used up before the next."""
    yield from groupby(read, key=lambda r: r[0])


def count_model(docs: DataFrame, shards: int, block_tokens: int) -> DataFrame:
    """From (id, text, target flag), a stored row for each shard: its sorted keys, and their counts in both corpora."""

    def count(read):
        for block in _blocks(read, 0, block_tokens):
            pairs, histories, at = events([t for t, _ in block])
            wanted = np.array([bool(f) for _, f in block])[at]
            keys = np.concatenate([pairs, histories])
            wanted = np.concatenate([wanted, wanted]).astype(np.int64)
            keys, target, both = _sum_by_key(keys, wanted, np.ones(len(keys), np.int64))
            for shard, s, e in _cuts(_by_shard(keys, shards)):
                yield shard, pack_keys(keys[s:e]), pack_counts(target[s:e]), pack_counts((both - target)[s:e])

    def merge(read):
        for shard, rows in _groups(read):
            held = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
            waiting, size = [], 0

            def fold():
                return list(_sum_by_key(*(np.concatenate([h, *(w[i] for w in waiting)]) for i, h in enumerate(held))))

            for _, k, t, b in rows:
                waiting.append((unpack_keys(k), unpack_counts(t).astype(np.int64), unpack_counts(b).astype(np.int64)))
                size += len(waiting[-1][0])
                if size > len(held[0]) + 500_000:
                    held, waiting, size = fold(), [], 0
            keys, target, other = fold()
            even = (keys & np.uint64(1)) == 0
            yield shard, pack_keys(keys), pack_counts(target, "<i8"), pack_counts(other, "<i8"), int((~even).sum()), int(target[even].sum()), int(other[even].sum())

    sent = map_rows(docs.select("c1", "c2"), "shard int, keys binary, t binary, b binary", count, chunk=64)
    dealt = sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    return stash(map_rows(dealt, "shard int, keys binary, t binary, b binary, n_words long, n_target long, n_other long", merge, chunk=1))


def _terms(keys: np.ndarray, target: np.ndarray, other: np.ndarray, vocabulary: int, a_target: float, a_other: float) -> np.ndarray:
    """What each key adds to the loss under the target model less that under the background model."""
    scale = np.where((keys & np.uint64(1)) == 0, 1.0, float(vocabulary))
    sign = np.where((keys & np.uint64(1)) == 0, 1.0, -1.0)
    return sign * (np.log(other + a_other * scale) - np.log(target + a_target * scale))


def _losses(at: np.ndarray, doc: np.ndarray, keys: np.ndarray, target: np.ndarray, other: np.ndarray, flags: np.ndarray, scale: tuple) -> np.ndarray:
    """Each document's sum of terms, its own occurrences taken out of its corpus; occurrences are in the order of key and document.

    ``at`` says which key an occurrence is of, ``doc`` in which document it is; ``flags`` says of documents if they are of the target.
    """
    heads = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])) if len(at) else np.zeros(0, np.int64)
    own = np.diff(np.concatenate([heads, [len(at)]]))
    at, doc = at[heads], doc[heads]
    terms = _terms(keys[at], target[at] - own * flags[doc], other[at] - own * ~flags[doc], *scale)
    return np.bincount(doc, weights=own * terms, minlength=len(flags))


def cross_entropy_difference(docs: DataFrame, target_col: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.1, hot: int = 1 << 16, shard_chars: int = 16_000_000, block_tokens: int = 400_000) -> DataFrame:
    """One row per input row: id, n_tokens (words and the end) and score. ``target_col`` flags the target's documents."""
    docs = pick(docs, id_col, text_col, target_col)
    kind = docs.schema["c0"].dataType.simpleString()
    chars = docs.agg(F.sum(F.octet_length("c1"))).first()[0] or 0
    shards = max(4, -(-chars // shard_chars))
    model = count_model(docs, shards, block_tokens)
    vocabulary, n_target, n_other = (x or 0 for x in model.agg(F.sum("n_words"), F.sum("n_target"), F.sum("n_other")).first())
    n = max(1, n_target + n_other)
    a_target, a_other = (alpha * max(x, 1) / n for x in (n_target, n_other))
    scale = vocabulary, a_target, a_other
    floor = max(2, -(-n // hot))

    def values(keys: bytes, t: bytes, b: bytes):
        return unpack_keys(keys), unpack_counts(t, "<i8"), unpack_counts(b, "<i8")

    def frequent(read):
        for row in read:
            k, t, b = values(*row)
            yield tuple(x[t + b >= floor].tobytes() for x in (k, t, b))

    # at most `hot` bigrams and `hot` histories reach the floor, whatever the corpus
    top = map_rows(model.select("keys", "t", "b"), "k binary, t binary, b binary", frequent, chunk=8).collect()
    hot_keys, *hot_counts = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[i], kind) for r in top)]) for i, kind in enumerate(("<u8", "<i8", "<i8")))
    order = np.argsort(hot_keys)
    known = docs.sparkSession.sparkContext.broadcast((hot_keys[order], *(x[order] for x in hot_counts)))

    def ask(read):
        """Requests to shards, and what is known of the block's documents already, which some shard hands on."""
        keys_known, target_known, other_known = known.value
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for block in _blocks(read, 1, block_tokens):
            pairs, histories, at = events([t for _, t, _ in block])
            flags = np.array([bool(f) for *_, f in block])
            keys, at = np.concatenate([pairs, histories]), np.concatenate([at, at])
            sizes = np.bincount(at[: len(pairs)], minlength=len(block))
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            place = np.searchsorted(keys_known, keys)
            hit = np.zeros(len(keys), bool) if not len(keys_known) else keys_known[np.minimum(place, len(keys_known) - 1)] == keys
            sums = _losses(place[hit], at[hit], keys_known, target_known, other_known, flags, scale)
            yield (number + (number >> 32)) % shards, number, [k for k, *_ in block], sizes.astype("<i8").tobytes(), sums.astype("<f8").tobytes(), None, None
            keys, at = keys[~hit], at[~hit]
            for shard, s, e in _cuts(_by_shard(keys, shards)):
                part = keys[s:e]
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                repeats = np.diff(np.concatenate([starts, [e - s]]))
                yield shard, number, None, pack_keys(part[starts]), pack_counts(repeats), pack_counts(at[s:e], "<u2"), np.packbits(flags).tobytes()
            number += 1

    def offer(read):
        for shard, keys, t, b in read:
            yield shard, -1, None, keys, t, b, None

    def answer(read):
        for shard, rows in _groups(read):
            model = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for _, block, ids, first, second, third, fourth in rows:
                if ids is not None:
                    yield block, ids, first, second
                    continue
                if block < 0:
                    model = values(first, second, third)
                    continue
                at = np.repeat(np.searchsorted(model[0], unpack_keys(first)), unpack_counts(second))
                flags = np.unpackbits(np.frombuffer(fourth, np.uint8)).astype(bool)
                yield block, None, None, _losses(at, unpack_counts(third, "<u2").astype(np.int64), *model, flags, scale).astype("<f8").tobytes()

    def add_up(read):
        for _, rows in _groups(read):
            ids, sizes, sums = [], None, np.zeros(0)
            for _, own, n_tokens, part in rows:
                part = np.frombuffer(part, "<f8")
                if own is not None:
                    ids, sizes = own, np.frombuffer(n_tokens, "<i8")
                if len(part) > len(sums):
                    sums = np.concatenate([sums, np.zeros(len(part) - len(sums))])
                sums[: len(part)] += part  # some parts are padded to whole bytes of flags
            for key, size, total in zip(ids, sizes.tolist(), sums.tolist()):
                yield key, size, total / size

    request = f"shard int, block long, ids array<{kind}>, x binary, y binary, z binary, w binary"
    asked = map_rows(docs, request, ask, chunk=64)
    offered = map_rows(model.select("shard", "keys", "t", "b"), request, offer, chunk=1)
    met = asked.unionByName(offered).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block")
    parts = map_rows(met, f"block long, ids array<{kind}>, n binary, part binary", answer, chunk=64)
    together = parts.repartition("block").sortWithinPartitions("block")
    return map_rows(together, f"id {kind}, n_tokens long, score double", add_up).withColumnRenamed("id", id_col)


def flag_target(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", flag_col: str = "_target", broadcast_bytes: int = 32_000_000) -> DataFrame:
    """(all columns of ``docs``, ``flag_col``): whether the id is in the one-column table of target ids. A column of that name is replaced.

    The ids are broadcast where they are counted to hold ``broadcast_bytes`` at most, else joined by a shuffle.
    """
    ids = pick(target_ids, target_ids.columns[0]).where("c0 IS NOT NULL").distinct()
    size = ids.agg(F.sum(F.octet_length(F.col("c0").cast("string")) + F.lit(16))).first()[0] or 0
    right = ids.select(F.col("c0").alias("id"), F.lit(True).alias("flag"))
    joined = renamed(docs).join(F.broadcast(right) if size <= broadcast_bytes else right, F.col(f"x{docs.columns.index(id_col)}") == F.col("id"), "left")
    kept = [i for i, c in enumerate(docs.columns) if c != flag_col]
    return joined.select(*(f"x{i}" for i in kept), F.coalesce("flag", F.lit(False))).toDF(*(docs.columns[i] for i in kept), flag_col)
