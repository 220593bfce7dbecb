"""Best-fit packing by a grouping genetic algorithm, distributed as islands.

Documents become token ids (one closing id after each), only those longer than a sequence are cut, and the pieces are
packed into sequences of ``capacity`` tokens. A full piece is a sequence by itself. The others are dealt at random to
shards of about ``shard_pieces`` pieces, so that each shard has the whole mix of lengths, and every shard is evolved on
several islands:

- an individual is a grouping of pieces to bins; the first of an island is best-fit decreasing, others are the same with
  noise in the order;
- crossover injects well-filled bins of one parent as a whole into the other, removes that one's bins that hold a piece
  twice, and best-fits the displaced pieces; mutation empties the worst bins and best-fits their pieces;
- fewer bins are better, then fuller ones (sum of squared fills);
- after each round an island's elite migrates to the next island of its shard. Rounds are written to the shared folder.

A shard that reaches its lower bound, ceil(sum of lengths / capacity), is done. In the end the bins with room left of all
shards are dealt anew and evolved once more, so that shards do not each leave a half-empty sequence.

Every choice is seeded by shard, island and round. Defined results: a null text counts as empty and gives one piece, the
closing id; a null id is passed through; rows that repeat an id are packed one by one.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brindle.llm.common import map_rows, stash

TOKENIZER = "word_bpe_49k.json"
CLOSE = (1).to_bytes(4, "little")


# --- token ids -----------------------------------------------------------------------------------------------------


def byte_symbols() -> dict[int, str]:
    """The byte-level alphabet of BPE vocabularies: printable bytes as themselves, the others as letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of a text as little-endian uint32 bytes, word by word with a bounded cache.

    For tokenizers that drop white space and never join across it: the ids of a text are then those of its words. Words of
    plain Latin letters (and one full stop or comma) go straight to the model, all others through the whole tokenizer.
    """

    #: Letters A-Z and those of Latin-1, which have one-letter lower cases and no decompositions to join.
    SIMPLE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,]?)")

    def __init__(self, definition: str, limit: int = 600_000):
        self.full = Tokenizer.from_str(definition)
        self.model, self.limit, self.cache = self.full.model, limit, {}
        self.symbols = {b: s for b, s in byte_symbols().items()}

    def _word(self, word: bytes) -> bytes:
        simple = self.SIMPLE.fullmatch(word)
        if not simple:
            return np.array(self.full.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        lower = simple[1].decode().lower().encode()
        ids = np.array([t.id for t in self.model.tokenize("".join(map(self.symbols.__getitem__, lower)))], "<u4").tobytes()
        if simple[2]:
            if (end := self.cache.get(simple[2])) is None:
                end = self.cache[simple[2]] = np.array(self.full.encode(simple[2].decode(), add_special_tokens=False).ids, "<u4").tobytes()
            ids += end
        return ids

    def __call__(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "replace").split()
        if len(self.cache) > self.limit:
            self.cache.clear()
        for w in set(words).difference(self.cache):
            self.cache[w] = self._word(w)
        return b"".join(map(self.cache.__getitem__, words))


_tokenizers: dict[int, WordTokenizer] = {}


def word_tokenizer(definition: str) -> WordTokenizer:
    """One for each Python worker, so that its cache lives as long as the worker."""
    key = zlib.crc32(definition.encode())
    if key not in _tokenizers:
        _tokenizers[key] = WordTokenizer(definition)
    return _tokenizers[key]


def tokenizer_file(path: str | None = None) -> str:
    """The text of a tokenizer's definition, read by the driver and sent to the executors."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Path(path).read_text(encoding="utf-8")


PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long, uid long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, tokenizer_path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, uid) of every piece; ``uid`` is unique in the table as it is written."""
    kind = docs.schema[id_col].dataType.simpleString()
    definition = tokenizer_file(tokenizer_path)

    def rows(read):
        ids_of = word_tokenizer(definition)
        uid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for key, text in read:
            ids = ids_of(text) + CLOSE
            for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield key, n, at // 4, len(part) // 4, zlib.crc32(part), uid
                uid += 1

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, {PIECE_SCHEMA}", rows)


# --- the genetic algorithm -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Evolution:
    population: int = 6
    generations: int = 12
    rounds: int = 3
    islands: int = 3
    shard_pieces: int = 4096


class Packing:
    """A grouping: the pieces of each bin, and the bins' fills."""

    __slots__ = ("bins", "fills")

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    def rank(self) -> tuple[int, int]:
        """Smaller is better."""
        return len(self.bins), -sum(f * f for f in self.fills)

    def assignment(self, n: int) -> np.ndarray:
        out = np.zeros(n, "<u4")
        for b, own in enumerate(self.bins):
            out[own] = b
        return out

    @classmethod
    def from_assignment(cls, where: np.ndarray, lengths: list[int]) -> Packing:
        bins: list[list[int]] = [[] for _ in range(int(where.max()) + 1 if len(where) else 0)]
        for i, b in enumerate(where.tolist()):
            bins[b].append(i)
        return cls(bins, [sum(lengths[i] for i in b) for b in bins])


def best_fit(bins: list[list[int]], fills: list[int], items: list[int], lengths: list[int], capacity: int) -> Packing:
    """Puts each item, in the order given, into the bin with the least room that is enough, else into a new one."""
    room: dict[int, list[int]] = defaultdict(list)
    mask = 0  # bit r is set when a bin has room for exactly r
    for b, f in enumerate(fills):
        if f < capacity:
            room[capacity - f].append(b)
            mask |= 1 << (capacity - f)
    for i in items:
        size = lengths[i]
        if fitting := mask >> size:
            r = size + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
            bins[b].append(i)
            fills[b] += size
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            fills.append(size)
        if left := r - size:
            room[left].append(b)
            mask |= 1 << left
    return Packing(bins, fills)


def _decreasing(items: list[int], lengths: list[int], rng: np.random.Generator, noise: float) -> list[int]:
    if not items:
        return items
    at = np.array(items)
    return at[np.argsort(-np.array(lengths, np.float64)[at] * (1 + noise * rng.random(len(at))), kind="stable")].tolist()


def crossover(mother: Packing, father: Packing, lengths: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """Well-filled bins of the father go whole into the mother; her bins that share a piece go, and what they held is best-fitted."""
    fullest = np.argsort(-np.array(father.fills), kind="stable")
    pool = fullest[: max(1, (len(fullest) * 2) // 3)]
    chosen = rng.choice(pool, size=max(1, int(len(pool) * rng.uniform(0.2, 0.7))), replace=False).tolist()
    taken = bytearray(len(lengths))
    for b in chosen:
        for i in father.bins[b]:
            taken[i] = 1
    bins, fills, displaced = [list(father.bins[b]) for b in chosen], [father.fills[b] for b in chosen], []
    for own, f in zip(mother.bins, mother.fills):
        if any(taken[i] for i in own):
            displaced += [i for i in own if not taken[i]]
        else:
            bins.append(list(own))
            fills.append(f)
    return best_fit(bins, fills, _decreasing(displaced, lengths, rng, 0.1), lengths, capacity)


def mutate(one: Packing, lengths: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """The worst bins, and a few others, are emptied and their pieces best-fitted."""
    order = np.argsort(np.array(one.fills), kind="stable")
    n = max(1, len(order) // 20)
    gone = set(order[:n].tolist()) | set(rng.choice(len(order), size=n).tolist())
    loose = [i for b in gone for i in one.bins[b]]
    kept = [b for b in range(len(one.bins)) if b not in gone]
    return best_fit([list(one.bins[b]) for b in kept], [one.fills[b] for b in kept], _decreasing(loose, lengths, rng, 0.2), lengths, capacity)


def evolve(lengths: list[int], population: list[Packing], capacity: int, plan: Evolution, rng: np.random.Generator) -> list[Packing]:
    """One round on one island: its population after some generations, best first."""
    bound = -(-sum(lengths) // capacity)
    every = list(range(len(lengths)))
    if not population:
        population = [best_fit([], [], _decreasing(every, lengths, rng, 0.0), lengths, capacity)]
    while len(population) < plan.population and min(p.rank() for p in population)[0] > bound:
        population.append(best_fit([], [], _decreasing(every, lengths, rng, 0.3 * rng.random()), lengths, capacity))
    population = sorted(population, key=Packing.rank)[: plan.population]
    for _ in range(plan.generations):
        if population[0].rank()[0] <= bound:
            break
        a, b = sorted(rng.integers(0, len(population), 2).tolist())
        child = crossover(population[a], population[b], lengths, capacity, rng) if a != b else mutate(population[a], lengths, capacity, rng)
        if child.rank() not in {p.rank() for p in population}:
            population = sorted([*population, child], key=Packing.rank)[: plan.population]
    return population


# --- islands -------------------------------------------------------------------------------------------------------

STATE = "shard long, island int, elite boolean, lengths binary, groups binary, n_bins int, fill double"


def _pack_open(open_pieces: DataFrame, capacity: int, plan: Evolution, level: int) -> DataFrame:
    """(uid, sequence_id, offset, fill) of all pieces of a stored table (uid, length)."""
    total = open_pieces.count()
    shards = max(1, -(-total // plan.shard_pieces))
    dealt = open_pieces.select(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard"), F.struct((-F.col("length")).alias("size"), "uid").alias("p"))
    items = stash(dealt.groupBy("shard").agg(F.array_sort(F.collect_list("p")).alias("p")).select("shard", F.transform("p", lambda x: x.uid).alias("uids"), F.transform("p", lambda x: (-x["size"]).cast("int")).alias("lengths")))

    def first(read):
        for shard, lengths in read:
            packed = np.array(lengths, "<u4").tobytes()
            for island in range(plan.islands):
                yield shard, island, False, packed, b"", 0, 0.0

    def advance(turn: int):
        def rows(read):
            held: list[tuple] = []

            def done():
                shard, island = held[0][:2]
                lengths = np.frombuffer(next(h[3] for h in held if not h[2]), "<u4").tolist()
                n = len(lengths)
                old = [Packing.from_assignment(g, lengths) for h in held if h[4] for g in np.frombuffer(h[4], "<u4").reshape(-1, n)]
                new = evolve(lengths, old, capacity, plan, np.random.default_rng([level, shard, island, turn]))
                groups = [p.assignment(n).tobytes() for p in new]
                bins, fill = new[0].rank()
                packed = np.array(lengths, "<u4").tobytes()
                yield shard, island, False, packed, b"".join(groups), bins, float(fill)
                if plan.islands > 1:
                    yield shard, (island + 1) % plan.islands, True, b"", groups[0], bins, float(fill)

            for row in read:
                if held and held[0][:2] != row[:2]:
                    yield from done()
                    held = []
                held.append(row)
            if held:
                yield from done()

        return rows

    state = map_rows(items.select("shard", "lengths"), STATE, first, chunk=16)
    for turn in range(plan.rounds):
        state = stash(map_rows(state.repartition("shard", "island").sortWithinPartitions("shard", "island", "elite"), STATE, advance(turn), chunk=16))
        # shards at their lower bound on an island are done; the rounds end with the last of the others
        island = state.where("NOT elite").groupBy("shard").agg(F.min("n_bins").alias("n_bins"))
        sums = items.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
        if not island.join(sums, "shard").where(F.col("n_bins") > F.ceil(F.col("total") / capacity)).limit(1).count():
            break
    best = state.where("NOT elite").groupBy("shard").agg(F.min_by("groups", F.struct("n_bins", "fill", "island")).alias("groups"))

    def lay_out(read):
        for shard, uids, lengths, groups in read:
            at: dict[int, int] = defaultdict(int)
            where = np.frombuffer(groups, "<u4")[: len(uids)].tolist()
            offsets = []
            for b, n in zip(where, lengths):
                offsets.append(at[b])
                at[b] += n
            for uid, b, offset in zip(uids, where, offsets):
                yield uid, (level << 60) + (shard << 20) + b, offset, at[b]

    return stash(map_rows(items.join(best, "shard").select("shard", "uids", "lengths", "groups"), "uid long, sequence_id long, offset long, fill long", lay_out))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, tokenizer_path: str | None = None, plan: Evolution = Evolution(), open_below: float = 0.995) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id and offset. Sequences have no gaps."""
    all_pieces = stash(pieces(docs, id_col, text_col, capacity, tokenizer_path))
    part = all_pieces.where(F.col("length") < capacity).select("uid", "length")
    once = _pack_open(part, capacity, plan, 1)
    loose = once.where(F.col("fill") < open_below * capacity).select("uid").join(part, "uid")
    again = _pack_open(stash(loose), capacity, plan, 2)
    places = once.where(F.col("fill") >= open_below * capacity).unionByName(again).select("uid", "sequence_id", "offset")
    full = all_pieces.where(F.col("length") >= capacity).withColumn("sequence_id", F.col("uid").bitwiseXOR(F.lit(3 << 60))).withColumn("offset", F.lit(0).cast("long"))
    return all_pieces.where(F.col("length") < capacity).join(places, "uid").unionByName(full).drop("uid")
