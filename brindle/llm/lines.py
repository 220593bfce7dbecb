"""Fuzzy line dedup: an exact prefix filter on rare words and runs of words, edit similarity, one occurrence for each group.

A line (between ``\\n``) is normalised to its words: lower case, digits as 0, without ASCII punctuation. Lines with equal
words are one line. Distinct lines whose words have an edit similarity (1 - Levenshtein distance / longer length) of
``similarity`` or more are linked. SimHash blocks alone lose many of those pairs, so all of them are found by features
that edits must leave alone:

- The features of a line are its rare words, and its runs of three words none of which is rare (the last runs reach over
  the line's end). Whether a word is rare follows from its count in all texts, so equal words are so alike everywhere.
  Counts decide the cost, never the result.
- Features have one order: rare words first, then runs, each from the rarest on. A line sends features in this order
  until so many of them are disjoint that the edits allowed cannot spoil all. The features of two alike lines that
  survive the edits come, on the side that stops first, among what the other sends too; so they meet in one at least.
  Lines of ``LONG`` words or more, which are too long for parities, send enough to meet in two, and need to.
- Lines that meet are compared by length, by the place of the feature, and by parities of their words before anything
  else moves. What passes is verified on the words.

Where the lines that share a feature have more than ``per_line`` candidates each, they are sent there with their words,
similarity is checked at once, and only pairs not yet linked through checked links are compared; so a line with very many
variants costs rows in proportion to their number. Of each connected group the first occurrence (smallest id, then text
hash, then line number) stays.

Defined results: null texts stay null, empty ones empty; lines without words are never removed. Rows that repeat an id with
another text are told apart by their text; rows that repeat id and text are treated alike. Null ids count as the last.
An empty table gives an empty one. Columns besides the id and the text are not read, and are returned untouched whatever
their names are.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from brindle.llm.common import SPACE_BYTES, map_batches, map_rows, pick, renamed, stash
from brindle.operators.components import connected_components

_TABLE = bytes(48 if 48 <= b <= 57 else 32 if b in SPACE_BYTES and b != 10 else b for b in range(256))
_DROP = string.punctuation.encode()
#: Words are counted in 2^CELL_BITS cells; words of RARE occurrences or fewer are rare.
CELL_BITS, RARE = 22, 400
#: Lines are compared in two passes, by whether the shorter one has fewer words than this; what a pass sends goes before the next.
CUT = 88
#: Of groups with more pairs of fitting lengths a member than this, members are sent on without a look at the pairs.
CROWD = 1024
#: Groups of more members, or more bytes of contents, than this are compared two blocks of about so many at a time; each member is sent once a block.
BLOCK, BLOCK_BYTES = 16_384, 24 << 20
#: What a line sends for each feature: 32 bits of its value, the line's number of words (the top bit: it needs two
#: features), the feature's place, the line's key, and parities of its words. The greatest number and place mean "or more".
MOST, TWO, ANYWHERE = (1 << 15) - 1, np.uint16(1 << 15), (1 << 16) - 1
#: Lines of up to so many words have 64, 128, 256 and 512 parities: at an edit similarity of 0.8, unrelated lines then differ
#: in more of them than alike ones can. Beyond the last parities tell nothing and are not sent. A limit is at least a
#: quarter above the one before, so two lines that may be alike differ by one step at most.
LIMITS = (48, 120, 256, 544)


def row_type(limits: tuple[int, ...]) -> np.dtype:
    """Rows with room for as many parities as the greatest limit has."""
    return np.dtype([("value", "<u4"), ("n", "<u2"), ("place", "<u2"), ("key", "<u8"), ("marks", "<u8", (1 << len(limits) - 1,))])


ROW = row_type(LIMITS)
HEAD = ROW.fields["marks"][1]
#: A task holds so many bytes of rows before it packs and sends them.
HELD = 1 << 24
#: Lines of so many words or more meet in two features.
LONG = LIMITS[-1] + 1
_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(np.uint64)
_BASE = 0x2545F4914F6CDD1D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _M2
    x = (x ^ x >> np.uint64(29)) * _M3
    return x ^ x >> np.uint64(32)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as they have been asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, x))]) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_powers = _Powers(_BASE)


def normal(text: str) -> bytes:
    """A text's lines as words with one space between."""
    data = text.lower().encode("utf-8", "surrogatepass").translate(_TABLE, _DROP)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ")


def normal_lines(text: str) -> list[list[bytes]]:
    """The words of each line."""
    return [line.split(b" ") if line else [] for line in normal(text).split(b"\n")]


def keyed_lines(texts: list[str | None]) -> Iterator[tuple[int, int, bytes, int]]:
    """(text, line number, normal line, key) of each line with words; equal keys mean equal words."""
    digest = xxhash.xxh64_intdigest
    for at, text in enumerate(texts):
        if text:
            for number, line in enumerate(normal(text).split(b"\n")):
                if line:
                    yield at, number, line, digest(line)


@dataclass(frozen=True)
class Lines:
    """Some lines. Words are hashes; those of line i are ``words[starts[i] : starts[i] + sizes[i]]``."""

    starts: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray
    words: np.ndarray


def hash_lines(lines: list[bytes], keys: list[int]) -> Lines:
    """The words of normal lines. A word's hash is a polynomial of its bytes' random numbers modulo 2^64, mixed."""
    data = b"\n".join([*lines, b""])
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero((raw == 32) | (raw == 10))
    begin = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    words = np.zeros(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        # so many words at a time that the arrays stay in the cache; one at least, however long
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + (1 << 18), side="right")))
        low, high = int(begin[at]), int(end[upto - 1])
        up, down = _powers.upto(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[raw[low:high]] * up[: high - low], out=sums[1:])
        words[at:upto] = (sums[end[at:upto] - low] - sums[begin[at:upto] - low]) * down[begin[at:upto] - low]
        at = upto
    last = np.flatnonzero(raw[end] == 10)
    starts = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    return Lines(starts, last - starts + 1, np.array(keys, np.uint64), _mix(words))


def batches_of_texts(read: Iterator[tuple], at: int, chars: int = 400_000) -> Iterator[list[tuple]]:
    """Rows some at a time, of about so many characters together."""
    held, size = [], 0
    for row in read:
        held.append(row)
        size += len(row[at] or "") + 16
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def levenshtein(a: list, b: list) -> int:
    """Edit distance, bit-parallel over the first sequence."""
    if not a or not b:
        return max(len(a), len(b))
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    plus, minus = full, 0
    for y in b:
        eq = where.get(y, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(horizontal | plus) & full)
        down = plus & horizontal
        score += bool(up & last) - bool(down & last)
        up = up << 1 | 1
        plus = (down << 1 | ~(vertical | up)) & full
        minus = up & vertical & full
    return score


def _middles(a: list, b: list) -> tuple[list, list]:
    """Both without what they begin and end with alike."""
    n = min(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n - head) if a[-1 - i] != b[-1 - i]), n - head)
    return a[head : len(a) - tail], b[head : len(b) - tail]


def edit_similarity(a: list, b: list) -> float:
    """1 - Levenshtein distance / longer length. What both begin and end with costs nothing."""
    return 1.0 - levenshtein(*_middles(a, b)) / max(len(a), len(b), 1)


def are_alike(a: list, b: list, similarity: float) -> bool:
    """Whether the edit similarity is reached; short differences, and sequences that share too few elements, are seen at once."""
    allowed = (1 - similarity) * max(len(a), len(b), 1) + 1e-9
    if abs(len(a) - len(b)) > allowed:
        return False
    x, y = _middles(a, b)
    if max(len(x), len(y)) <= allowed:
        return True
    if len(set(x).difference(y)) > allowed or len(set(y).difference(x)) > allowed:
        return False
    return levenshtein(x, y) <= allowed


def edits(n, similarity: float):
    """The greatest distance of two alike lines, the longer of n words."""
    return ((1 - similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def longest(n, similarity: float):
    """The most words of a line that is alike to one of n words."""
    return (np.asarray(n) / similarity + 1e-9).astype(np.int64)


def least_words(similarity: float) -> int:
    """Two different lines are alike only if the longer one has at least 1 / (1 - similarity) words."""
    return max(1, math.ceil(1 / (1 - similarity) - 1e-9) - 1) if similarity < 1 else 1


@dataclass(frozen=True)
class Rarity:
    """Counts of words (in quarters of powers of two), and up to which of those a word is rare."""

    levels: np.ndarray
    rare_level: int
    words: float

    def of(self, words: np.ndarray) -> np.ndarray:
        return self.levels[(words >> np.uint64(64 - CELL_BITS)).astype(np.int64)]


def rarity(counts: np.ndarray, scale: float, similarity: float) -> Rarity:
    """From counts by cell, of one in ``scale`` occurrences. At similarities up to 0.75 edits may spoil all runs: every word is rare."""
    level = lambda n: np.round(4 * np.log2(1 + n)).astype(np.uint8)
    rare = 255 if similarity <= 0.75 else int(level(np.float64(RARE / scale))) if scale <= RARE else -1
    return Rarity(level(counts), rare, float(max(1, counts.sum())))


def apart_runs(order: np.ndarray, single: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Which features, given by their places in order, are runs of three that overlap none taken before; those that some rounds
    leave open are not taken, so in any case those taken do not overlap."""
    # two free places between lines
    line = np.repeat(np.arange(len(sizes)), sizes)
    at = order + 2 * line[order] + 2
    none = np.int32(len(order))
    turn = np.full(int(sizes.sum()) + 2 * len(sizes) + 4, none, np.int32)
    turn[at] = np.where(single, none, np.arange(len(order), dtype=np.int32))
    taken = np.zeros(len(turn), bool)
    for _ in range(rounds):
        inner = turn[2:-2]
        first = (inner < turn[1:-3]) & (inner < turn[3:-1]) & (inner < turn[:-4]) & (inner < turn[4:])
        if not first.any():
            break
        taken[2:-2] |= first
        won = np.flatnonzero(first) + 2
        for k in range(-2, 3):
            turn[won + k] = none
    return taken[at]


def features(lines: Lines, rare: Rarity, similarity: float) -> tuple[np.ndarray, ...]:
    """(value, line, place, whether the line needs two) of everything that the lines send."""
    words, sizes = lines.words, lines.sizes
    line = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - np.repeat(lines.starts, sizes)
    left = sizes[line] - place
    level = rare.of(words).astype(np.int16)
    single = level <= rare.rare_level
    value = words * _M1
    rank = level.astype(np.int64)
    if rare.rare_level < 255:
        shifted = lambda a, k, end: np.where(left > k, np.concatenate([a[k:], np.full(k, end, a.dtype)]), end)
        none, mark, often = np.zeros((), bool), np.uint64(7), np.int16(4 * 12)
        run = ~(single | shifted(single, 1, none) | shifted(single, 2, none))
        three = (value ^ value >> np.uint64(29)) * _M2 + shifted(words, 1, mark)
        three = (three ^ three >> np.uint64(29)) * _M2 + shifted(words, 2, mark)
        value = np.where(single, value, three)
        rank = np.where(single, rank, 512 + rank + shifted(level, 1, often) + shifted(level, 2, often))
        used = np.flatnonzero(single | run)
    else:
        used = np.arange(len(words))
    value = _mix(value)
    # line, then rarity, then value
    order = used[np.argsort(line[used].astype(np.uint64) << np.uint64(43) | rank[used].astype(np.uint64) << np.uint64(32) | value[used] >> np.uint64(32), kind="stable")]
    value, line, place, single = value[order], line[order], place[order], single[order]
    new = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    owner = np.cumsum(new) - 1
    most, most_of_longer = edits(sizes, similarity)[line], edits(longest(sizes, similarity), similarity)[line]
    low = np.int64((1 << 32) - 1)
    rest = np.where(single, 3, place % 3)
    # two counters in each number: single words and runs from the first of three places on, runs from the others on
    pair = (single | (rest == 0).astype(np.int64) << 32, (rest == 1) | (rest == 2).astype(np.int64) << 32)

    def so_far(numbers: np.ndarray) -> np.ndarray:
        sums = np.cumsum(numbers)
        return sums - (sums[heads] - numbers[heads])[owner]

    taken = apart_runs(order, single, lines.starts, lines.sizes) if rare.rare_level < 255 else single

    def reached(of: np.ndarray | None, more: int) -> np.ndarray:
        """Whether edits cannot spoil all features up to here, or all but ``more`` of them."""
        one, other = (so_far(x if of is None else x * of) for x in pair)
        singles = one & low
        chosen = so_far((taken if of is None else taken & of).astype(np.int64))
        # runs that do not overlap: those a multiple of three places from each other, or those taken from the rarest on
        runs = np.maximum(np.maximum(np.maximum(one >> 32, other & low), other >> 32), chosen)
        return (singles > most + more) | (singles + runs > most_of_longer + more)

    once = new | np.concatenate([[True], value[1:] != value[:-1]]) if len(line) else new
    enough, both = reached(None, 0), reached(once, 1)
    long = (sizes[line] >= LONG) & np.logical_or.reduceat(both, heads)[owner] if len(line) else both
    enough = np.where(long, both, enough).astype(np.int64)
    kept = so_far(enough) == enough
    # the place counts only where a feature is in its line once
    alone = once & np.concatenate([once[1:], [True]]) if len(line) else once
    place = np.where(alone & (place < ANYWHERE), place, ANYWHERE)
    kept &= once
    return value[kept], line[kept], place[kept], long[kept]


def mark_words(n: np.ndarray, limits: tuple[int, ...]) -> np.ndarray:
    """How many times 64 parities a line of n words has."""
    return np.array([*(1 << i for i in range(len(limits))), 0])[np.searchsorted(limits, n)]


def parities(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limits: tuple[int, ...] = LIMITS) -> np.ndarray:
    """Parities of each line, as many numbers as a row has: whether an odd number of its words has a bit. With half as many bits, a line
    has the exclusive or of both halves."""
    out = np.zeros((len(starts), 1 << len(limits) - 1), np.uint64)
    each = mark_words(sizes, limits)
    line = np.repeat(np.arange(len(starts)), sizes)
    mixed = words * _M3
    bit = np.uint64(1) << (mixed >> np.uint64(58))
    at = (mixed >> np.uint64(50)).astype(np.int64) & each[line] - 1
    for i in range(1 << len(limits) - 1):
        own = np.flatnonzero(each > i)
        if len(own):
            out[:, i] = np.where(each > i, np.bitwise_xor.reduceat(np.where(at == i, bit, np.uint64(0)), starts), np.uint64(0))
    return out


def feature_rows(value: np.ndarray, place, key: np.ndarray, sizes: np.ndarray, two, marks: np.ndarray, limits: tuple[int, ...] = LIMITS) -> np.ndarray:
    """Arrays of ``row_type``; ``marks`` are the lines' parities."""
    rows = np.zeros(len(value), row_type(limits))
    rows["value"], rows["place"], rows["key"], rows["marks"] = value & np.uint64(0xFFFFFFFF), place, key, marks
    rows["n"] = np.minimum(sizes, MOST).astype(np.uint16) | np.where(two, TWO, np.uint16(0))
    return rows


def pack_rows(rows: np.ndarray, limits: tuple[int, ...] = LIMITS) -> bytes:
    """Rows by ascending value, byte plane by byte plane, compressed; of the parities only those that a row has."""
    rows = rows[np.argsort(rows["value"], kind="stable")]
    each = mark_words(rows["n"] & np.uint16(MOST), limits)
    head = rows.view(np.uint8).reshape(-1, rows.itemsize)[:, :HEAD].T.tobytes()
    return _PACK.compress(b"".join([len(rows).to_bytes(8, "little"), head, *(rows["marks"][each > i, i].tobytes() for i in range(rows["marks"].shape[1]))]))


def unpack_rows(data: bytes, limits: tuple[int, ...] = LIMITS) -> np.ndarray:
    data = _UNPACK.decompress(data)
    size = int.from_bytes(data[:8], "little")
    rows, at = np.zeros(size, row_type(limits)), 8 + HEAD * size
    rows.view(np.uint8).reshape(-1, rows.itemsize)[:, :HEAD] = np.frombuffer(data, np.uint8, HEAD * size, 8).reshape(HEAD, -1).T
    each = mark_words(rows["n"] & np.uint16(MOST), limits)
    for i in range(rows["marks"].shape[1]):
        own = np.flatnonzero(each > i)
        rows["marks"][own, i] = np.frombuffer(data, "<u8", len(own), at)
        at += 8 * len(own)
    return rows


def apart(marks: np.ndarray, each: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many parities the rows a and b differ, by as many as the one with fewer has; b has as many, or twice as many."""
    out = np.zeros(len(a), np.int64)
    for size in np.unique(each[a][each[a] > 0]).tolist():
        own = np.flatnonzero((each[a] == size) & (each[b] > 0))
        x, y = a[own], b[own]
        twice = each[y] > size
        for i in range(size):
            other = marks[y, i]
            if size + i < marks.shape[1]:
                other = other ^ np.where(twice, marks[y, size + i], np.uint64(0))
            out[own] += np.bitwise_count(marks[x, i] ^ other)
    return out


def line_rows(lines: Lines, rare: Rarity, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(values of 64 bits, rows) of the features that the lines send."""
    value, line, place, long = features(lines, rare, similarity)
    marks = parities(lines.words, lines.starts, lines.sizes)
    return value, feature_rows(value, place, lines.keys[line], lines.sizes[line], long, marks[line])


def _sparse(found: list[tuple[np.ndarray, np.ndarray]], group: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs but those in dense groups."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
    few = ~dense[group[a]]
    return a[few], b[few]


def meetings(rows: np.ndarray, similarity: float, per_line: int, shift: Callable, differ: Callable, need: Callable | None = None, step: int = 1 << 18, limits: tuple[int, ...] = LIMITS, below: int | None = None) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """((keys a, keys b, how often they met, how often they need to), (group, key)): pairs that may be alike, and the members
    of values with too many such pairs.

    ``shift`` and ``differ`` say from two lengths how far a feature may have moved, and how many parities may differ; ``need``,
    in how many features such a pair meets at least (without it, the rows' top bits say so). Pairs of which both have
    ``below`` words or more are left to another pass.
    """
    n = rows["n"] & np.uint16(MOST)
    rows = rows[np.lexsort((rows["key"], n, rows["value"]))]
    same = np.concatenate([[False], (rows["value"][1:] == rows["value"][:-1]) & (rows["key"][1:] == rows["key"][:-1])]) if len(rows) else np.zeros(0, bool)
    rows = rows[~same]
    value = rows["value"].astype(np.int64)
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(rows) else np.zeros(0, bool)
    sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(rows)]]))
    many = np.repeat(sizes > 1, sizes)
    rows, sizes = rows[many], sizes[sizes > 1]
    none = (np.zeros(0, np.int64),) * 4
    if not len(rows):
        return none, none[:2]
    group = np.repeat(np.arange(len(sizes)), sizes)
    n, two = (rows["n"] & np.uint16(MOST)).astype(np.int64), (rows["n"] & TWO) > 0
    place, key, marks, each = rows["place"].astype(np.int64), rows["key"], rows["marks"], mark_words(n, limits)
    # members are in the order of their lengths: those not too long for one come right after it
    reach = np.where(n == MOST, MOST, np.minimum(longest(n, similarity), MOST))
    fits = np.searchsorted(group << 16 | n, group << 16 | reach, side="right") - np.arange(len(n)) - 1
    if below is not None:
        fits[n >= below] = 0
    starts = np.cumsum(sizes) - sizes
    dense = np.add.reduceat(fits, starts) > CROWD * sizes
    fits[dense[group]] = 0
    found, passed = [], np.zeros(len(sizes), np.int64)
    sums, at = np.cumsum(fits), 0
    while at < len(fits):
        upto = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + step)))
        own = fits[at:upto] * ~dense[group[at:upto]]
        a = np.repeat(np.arange(at, upto), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        at = upto
        open_end = n[b] == MOST
        moved = np.abs(place[a] - place[b])
        # what comes before and what comes after a feature that survived must both be within reach
        fine = open_end | (place[a] == ANYWHERE) | (place[b] == ANYWHERE) | (moved + np.abs(n[a] - place[a] - n[b] + place[b]) <= shift(n[a], n[b]))
        fine &= key[a] != key[b]
        a, b = a[fine], b[fine]
        good = apart(marks, each, a, b) <= differ(n[a], n[b])
        a, b = a[good], b[good]
        if len(a):
            passed += np.bincount(group[a], minlength=len(sizes))
            dense |= passed > per_line * sizes
            found.append((a, b))
            if len(found) > 8:
                found = [_sparse(found, group, dense)]
    a, b = _sparse(found, group, dense)
    small, large = np.minimum(key[a], key[b]), np.maximum(key[a], key[b])
    order = np.lexsort((large, small))
    least = (two[a] & two[b]) + 1 if need is None else need(n[a], n[b])
    small, large, least = small[order], large[order], least[order]
    heads = np.flatnonzero(np.concatenate([[True], (small[1:] != small[:-1]) | (large[1:] != large[:-1])])) if len(small) else np.zeros(0, np.int64)
    met = np.diff(np.concatenate([heads, [len(small)]]))
    # values whose members have the same smallest key are one group
    names = np.minimum.reduceat(key, starts)
    members = dense[group]
    return (small[heads].view(np.int64), large[heads].view(np.int64), met, least[heads]), (names[group[members]].view(np.int64), key[members].view(np.int64))


def _parities(arrays: list[np.ndarray], bits: int) -> np.ndarray:
    """``bits`` bits for each array: whether an odd number of its values has that remainder."""
    out = np.zeros((len(arrays), bits >> 6), np.uint64)
    ends = np.cumsum(np.fromiter(map(len, arrays), np.int64, len(arrays)))
    at = 0
    while at < len(arrays):
        # about a quarter of a million values at a time, so that what is made of them stays small
        upto = max(at + 1, min(at + (1 << 22) // bits, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18)))))
        some = arrays[at:upto]
        place = np.repeat(np.arange(len(some)), [len(x) for x in some]) * bits + (np.concatenate(some) % np.uint64(bits)).astype(np.int64)
        odd = np.bincount(place, minlength=bits * len(some)).astype(np.uint8) & 1
        out[at:upto] = np.packbits(odd.reshape(-1, bits), axis=1).view(np.uint64)
        at = upto
    return out


class Judge:
    """Decides for many pairs of lines at a time what ``are_alike`` decides for one. Lines are words with one space between."""

    def __init__(self, lines: pa.Array, similarity: float):
        lists = pc.split_pattern(lines, " ")
        # equal numbers are equal words
        self.words = lists.flatten().dictionary_encode().indices.to_numpy()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        self.similarity, self.sizes = similarity, np.diff(np.concatenate([[0], ends]))
        self.starts = ends - self.sizes

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, n, b, m = self.starts[i], self.sizes[i], self.starts[j], self.sizes[j]
        allowed = (1 - self.similarity) * np.maximum(np.maximum(n, m), 1) + 1e-9
        out = np.abs(n - m) <= allowed
        own = np.flatnonzero(out)
        a, n, b, m = middles(self.words, a[own], n[own], b[own], m[own])
        swap = n > m
        a, n, b, m = np.where(swap, b, a), np.where(swap, m, n), np.where(swap, a, b), np.where(swap, n, m)
        hard = m > allowed[own]
        own, a, n, b, m = (x[hard] for x in (own, a, n, b, m))
        open_ = np.ones(len(own), bool)
        for k in np.flatnonzero(n > WIDE).tolist():
            said = bounds(self.words[a[k] : a[k] + n[k]], self.words[b[k] : b[k] + m[k]], allowed[own[k]])
            if said is not None:
                out[own[k]], open_[k] = said, False
        own, a, n, b, m = (x[open_] for x in (own, a, n, b, m))
        out[own] = distances(self.words, a, n, b, m) <= allowed[own]
        return out


def bounds(x: np.ndarray, y: np.ndarray, allowed: float) -> bool | None:
    """Whether the edit distance is at most that, where that is seen without finding it: from the words that both share, and from
    the edits between words that are once in both and in the same order."""
    (own, at, often), (other, to, often_there) = (np.unique(z, return_index=True, return_counts=True) for z in (x, y))
    _, i, j = np.intersect1d(own, other, assume_unique=True, return_indices=True)
    if max(len(x), len(y)) - np.minimum(often[i], often_there[j]).sum() > allowed:
        return False
    once = (often[i] == 1) & (often_there[j] == 1)
    here, there = at[i[once]], to[j[once]]
    order = np.argsort(here)
    here, there = here[order], there[order]
    if len(here):
        fixed = (there == np.maximum.accumulate(there)) & (there == np.minimum.accumulate(there[::-1])[::-1])
        here, there = here[fixed], there[fixed]
    n, m = np.diff(here, prepend=-1, append=len(x)) - 1, np.diff(there, prepend=-1, append=len(y)) - 1
    even = np.where(n == m, n, 0)
    which, place = _ragged(even)
    begin, begin_there = np.concatenate([[0], here + 1]), np.concatenate([[0], there + 1])
    changed = np.count_nonzero(x[begin[which] + place] != y[begin_there[which] + place])
    return True if changed + np.where(n == m, 0, np.maximum(n, m)).sum() <= allowed else None


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place) of the elements of arrays of these sizes, one after the other."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def middles(words: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sequences of n words from a on and of m from b on, without what both begin and end with."""

    def common(x, y, step, most):
        which, place = _ragged(most)
        same = most.copy()
        full = most > 0
        if full.any():
            differ = words[x[which] + step * place] != words[y[which] + step * place]
            same[full] = np.minimum.reduceat(np.where(differ, place, most[which]), (np.cumsum(most) - most)[full])
        return same

    least = np.minimum(n, m)
    head = common(a, b, 1, least)
    tail = common(a + n - 1, b + m - 1, -1, least - head)
    return a + head, n - head - tail, b + head, m - head - tail


#: Sequences of up to so many words are compared in numbers of 64 bits, many pairs at a time; FEW pairs, and longer ones, one by one.
SPAN, FEW = 512, 8
#: Longer ones are first tried by bounds.
WIDE = 256


def distances(words: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Edit distances of n words from a on and m (n at least) from b on."""
    out = m.copy()
    blocks = (n + 63) >> 6
    for size in np.unique(blocks[n > 0]).tolist():
        own = np.flatnonzero(blocks == size)
        if size > SPAN >> 6 or len(own) <= FEW * size:
            out[own] = [levenshtein(words[x : x + k].tolist(), words[y : y + l].tolist()) for x, k, y, l in zip(*(z[own].tolist() for z in (a, n, b, m)))]
            continue
        own = own[np.argsort(-m[own], kind="stable")]
        step = max(1, (1 << 18) // (64 * size))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            out[some] = _distances(words, a[some], n[some], b[some], m[some], size)
    return out


def _distances(words: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, size: int) -> np.ndarray:
    """The same where all n need ``size`` numbers of 64 bits, by descending m: bit-parallel over the first sequence and over pairs."""
    one, top = np.uint64(1), np.uint64(63)
    first, second = np.full((len(n), 64 * size), -1, words.dtype), np.full((int(m[0]), len(n)), -2, words.dtype)
    which, place = _ragged(n)
    first[which, place] = words[a[which] + place]
    which, place = _ragged(m)
    second[place, which] = words[b[which] + place]
    plus, minus = np.full((size, len(n)), ~np.uint64(0)), np.zeros((size, len(n)), np.uint64)
    last, score = ((n - 1) & 63).astype(np.uint64), n.copy()
    lives = np.searchsorted(-m, -np.arange(int(m[0])), side="left")
    for j, live in enumerate(lives.tolist()):
        same = np.packbits(first[:live] == second[j, :live, None], axis=1, bitorder="little").view("<u8")
        up, down = one, np.uint64(0)
        for k in range(size):
            eq, p, q = same[:, k], plus[k, :live], minus[k, :live]
            vertical = eq | q
            eq = eq | down
            horizontal = (((eq & p) + p) ^ p) | eq
            more, less = q | ~(horizontal | p), p & horizontal
            if k == size - 1:
                score[:live] += (more >> last[:live] & one).astype(np.int64) - (less >> last[:live] & one).astype(np.int64)
            over, under = more >> top, less >> top
            more, less = more << one | up, less << one | down
            plus[k, :live], minus[k, :live] = less | ~(vertical | more), more & vertical
            up, down = over, under
    return score


def forest(groups: list[tuple[np.ndarray, np.ndarray]], hashes: Callable, judge: Callable, similarity: float, differ: Callable, bits: int = 256) -> Iterator[tuple[int, int]]:
    """Links of alike rows that connect what all pairs of alike rows of a group, (keys, contents), connect.

    ``hashes`` makes arrays of the rows' values, ``judge`` what decides on the rows of two arrays of numbers, and ``differ``
    says from two lengths how many values only one of both can have.
    """
    keys, rows = (np.concatenate(x) for x in zip(*groups))
    arrays = hashes(rows)
    lengths = np.fromiter(map(len, arrays), np.int64, len(arrays))
    ends = np.cumsum([len(k) for k, _ in groups])
    order = np.lexsort((lengths, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))))
    keys, lengths, marks = keys[order], lengths[order], _parities([arrays[i] for i in order.tolist()], bits)
    alike = judge(pa.array([rows[i] for i in order.tolist()], pa.binary()))
    part, far = np.arange(len(order)), longest(lengths, similarity)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settled() -> Iterator[tuple[int, int]]:
        i, j = (np.concatenate(x) for x in zip(*held))
        held.clear()
        while len(i := i[other := part[i] != part[j]]):
            j = j[other]
            # each row once, and each two parts once, for links found now make others needless
            turn = np.unique(j, return_index=True)[1]
            low, high = np.minimum(part[i[turn]], part[j[turn]]), np.maximum(part[i[turn]], part[j[turn]])
            turn = turn[np.unique(low << 32 | high, return_index=True)[1]]
            good = turn[alike(i[turn], j[turn])]
            for x, y in zip(i[good].tolist(), j[good].tolist()):
                if part[x] != part[y]:
                    part[part == part[y]] = part[x]
                    yield int(keys[x]), int(keys[y])
            i, j = np.delete(i, turn), np.delete(j, turn)

    for at, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        while at < end:
            # some rows against all that are not too long, about a million pairs at a time
            upto = min(end, at + max(1, (1 << 20) // (end - at)))
            other = np.arange(at + 1, at + int(np.searchsorted(lengths[at:end], far[upto - 1], side="right")))
            if (part[at:upto] == part[at]).all():
                other = other[part[other] != part[at]]
            apart_in = np.zeros((upto - at, len(other)), np.uint16)
            for k in range(marks.shape[1]):
                apart_in += np.bitwise_count(marks[at:upto, k, None] ^ marks[None, other, k])
            i, j = np.nonzero(apart_in <= differ(lengths[at:upto, None], lengths[None, other]))
            i, j = i + at, other[j]
            fit = (j > i) & (lengths[j] <= far[i])
            held.append((i[fit], j[fit]))
            at = upto
            if at < end or sum(len(i) for i, _ in held) > 1 << 16:
                yield from settled()
    if held:
        yield from settled()


def _runs(read: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Groups of equal first values that have two rows at least, of arrays in the order of those."""
    held: tuple[np.ndarray, ...] | None = None

    def groups(arrays):
        first = arrays[0]
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        ends = np.concatenate([starts[1:], [len(first)]])
        many = ends - starts > 1
        for s, e in zip(starts[many].tolist(), ends[many].tolist()):
            yield tuple(a[s:e] for a in arrays)

    for arrays in read:
        if held is not None:
            arrays = tuple(np.concatenate(p) for p in zip(held, arrays))
        if not len(arrays[0]):
            continue
        cut = int(np.searchsorted(arrays[0], arrays[0][-1]))
        yield from groups(tuple(a[:cut] for a in arrays)) if cut else ()
        held = tuple(a[cut:] for a in arrays)
    if held is not None and len(held[0]):
        yield from groups(held)


def pack_counts(n: np.ndarray) -> bytes:
    return _PACK.compress(n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_UNPACK.decompress(data), np.uint8).reshape(8, -1).T).view("<i8")[:, 0]


def cell_counts(table: DataFrame, values: Callable[[Iterator[tuple]], Iterator[np.ndarray]]) -> np.ndarray:
    """How many of the values of 64 bits that ``values`` yields for rows of a table are in each cell. Every row is read.

    Tasks send their counts in ranges of cells, compressed; the cells are 2^CELL_BITS, whatever the size of the table.
    """
    ranges = 64

    def count(read):
        n = np.zeros(1 << CELL_BITS, np.int64)
        for own in values(read):
            np.add.at(n, (own >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        yield from ((i, pack_counts(own)) for i, own in enumerate(np.split(n, ranges)) if own.any())

    def add(read):
        sums: dict[int, np.ndarray] = {}
        for i, data in read:
            own = unpack_counts(data)
            sums[i] = sums[i] + own if i in sums else own
        yield from ((i, pack_counts(own)) for i, own in sums.items())

    found = map_rows(map_rows(table, "at int, n binary", count, chunk=8).repartition(ranges, "at"), "at int, n binary", add, chunk=8)
    counts = np.zeros((ranges, (1 << CELL_BITS) // ranges), np.int64)
    for r in found.collect():
        counts[r.at] = unpack_counts(bytes(r.n))
    return counts.reshape(-1)


def word_counts(texts: DataFrame, least: int) -> np.ndarray:
    """How often words of each cell occur in the lines of ``least`` words or more of a one-column table; a line that a task
    has had lately is not counted again, as it is not sent again either."""

    def words(read):
        seen: set[int] = set()
        for rows in batches_of_texts(read, 0):
            lines, keys = _unseen([t for (t,) in rows], seen, lambda line: line.count(b" ") >= least - 1)
            if lines:
                yield hash_lines(lines, keys).words

    return cell_counts(texts, words)


def candidates(docs: DataFrame, sends: Callable[[Iterator[tuple]], Iterator[tuple[np.ndarray, np.ndarray]]], similarity: float, per_line: int, parts: int, shift: Callable, differ: Callable, need: Callable | None = None, limits: tuple[int, ...] = LIMITS, below: int | None = None) -> DataFrame:
    """(a, b, met, need, dense): keys of rows that may be alike; or, where ``dense``, a group of very many and one of those.

    ``sends`` yields (values of 64 bits, ``ROW`` arrays) of rows of ``docs``. Values are dealt to lots, lots to tasks.
    """
    lots = 4 * parts

    def send(read):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def done():
            lot, rows = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(lot, kind="stable")
            lot = lot[order]
            starts = np.flatnonzero(np.concatenate([[True], lot[1:] != lot[:-1]])).tolist()
            for s, e in zip(starts, [*starts[1:], len(lot)]):
                yield int(lot[s]), pack_rows(rows[order[s:e]], limits)

        for values, rows in sends(read):
            held.append((((values >> np.uint64(32)) * np.uint64(lots) >> np.uint64(32)).astype(np.int32), rows))
            if sum(r.nbytes for _, r in held) > HELD:
                yield from done()
        if sum(len(r) for _, r in held):
            yield from done()

    def meet(batches):
        # a part is made to hold about a million rows; those of one lot are unpacked at a time
        lots_of: dict[int, list[bytes]] = {}
        for b in batches:
            for lot, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lots_of.setdefault(lot, []).append(x)
        while lots_of:
            _, rows = lots_of.popitem()
            whole = np.concatenate([unpack_rows(x, limits) for x in rows])
            del rows
            pairs, members = meetings(whole, similarity, per_line, shift, differ, need, limits=limits, below=below)
            for columns, dense in ((pairs, False), ((*members, np.ones(len(members[0]), np.int64), np.ones(len(members[0]), np.int64)), True)):
                for at in range(0, len(columns[0]), 10_000):
                    part = [pa.array(np.ascontiguousarray(c[at : at + 10_000]), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*part, pa.array([dense] * len(part[0]))], ["a", "b", "met", "need", "dense"])

    sent = map_rows(docs, "lot long, rows binary", send, chunk=64)
    found = map_batches(sent.repartition(parts, "lot"), meet, "a long, b long, met int, need int, dense boolean")
    # members of a dense group come once for each value with the same members
    return found.groupBy("dense", "a", "b").agg(F.sum("met").alias("met"), F.max("need").alias("need")).where("dense OR met >= need").select("a", "b", "dense")


#: A filter of keys has 2^BITS_MOST bits at most, 8 MB.
BITS_MOST = 26


def key_filter(keys: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Says of (unsigned) keys whether they may be in a one-column table of signed ones. What it lets pass is to be joined;
    its size is bounded, so of very many keys it lets more pass."""
    name = keys.columns[0]
    bits = min(BITS_MOST, max(10, 4 + max(1, keys.count()).bit_length()))
    cell = F.shiftrightunsigned(F.col(name), 64 - bits)
    cells = keys.select(F.shiftright(cell, 6).cast("int").alias("at"), F.expr("shiftleft(1L, 0)").alias("unit"), cell.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = cells.groupBy("at").agg(F.bit_or(F.call_function("shiftleft", F.col("unit"), F.col("bit"))).alias("bits")).toArrow()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[np.asarray(found.column("at"))] = np.asarray(found.column("bits")).view(np.uint64)
    known = keys.sparkSession.sparkContext.broadcast(table)

    def may_be(own: np.ndarray) -> np.ndarray:
        at = own >> np.uint64(64 - bits)
        return (known.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) > 0

    return may_be


def needed_keys(found: DataFrame) -> DataFrame:
    return found.select(F.explode(F.when(F.col("dense"), F.array("b")).otherwise(F.array("a", "b"))).alias("key")).distinct()


def verified(found: DataFrame, needed: DataFrame, contents: DataFrame, hashes: Callable, judge: Callable, similarity: float, differ: Callable, bits: int = 256) -> DataFrame:
    """(a, b): links that hold, from stored candidates and (key, content). Of an array of contents ``judge`` makes what says of
    many pairs whether they are alike, and ``hashes`` the arrays of values that ``forest`` looks at first. The result is stored."""
    contents = stash(contents.join(needed, "key", "left_semi").select("key", "content").distinct().withColumn("bytes", F.octet_length("content")))
    pairs = found.where("NOT dense").select("a", "b")
    members = found.where("dense").select(F.col("a").alias("g"), F.col("b").alias("key"))
    both = pairs.join(contents.select(F.col("key").alias("a"), F.col("content").alias("x")), "a").join(contents.select(F.col("key").alias("b"), F.col("content").alias("y")), "b")

    def verify(batches):
        for batch in batches:
            n = np.arange(batch.num_rows)
            good = judge(pa.concat_arrays([batch.column(2), batch.column(3)]))(n, n + len(n))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good))

    def connect(batches):
        read = (tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches)
        held, size = [], 0
        for group in chain((own for _, *own in _runs(read)), [None]):
            # small groups together
            if group is None or size > 8 << 20:
                links = list(forest(held, hashes, judge, similarity, differ, bits)) if held else []
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])
                held, size = [], 0
            if group is not None:
                held.append(group)
                size += sum(map(len, group[1]))

    # a group of more than a block goes to tasks by pairs of blocks
    blocks = members.join(contents.select("key", "bytes"), "key").groupBy("g").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = members.join(blocks, "g").select("g", "key", "blocks", own.alias("own")).select("g", "key", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.where("blocks = 1 OR own != other").select(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "key")
    crowded = dealt.join(contents, "key").select("g", "key", "content").repartition("g").sortWithinPartitions("g")
    return stash(map_batches(both.select("a", "b", "x", "y"), verify, "a long, b long").unionByName(map_batches(crowded, connect, "a long, b long")))


def _word_hashes(lines: list[bytes]) -> list[np.ndarray]:
    found = hash_lines(list(lines), [0] * len(lines))
    return [found.words[s : s + n] for s, n in zip(found.starts.tolist(), found.sizes.tolist())]


def _unseen(texts: list[str | None], seen: set[int], wanted: Callable[[bytes], bool], most: int = 200_000) -> tuple[list[bytes], list[int]]:
    """(lines, keys) of the wanted lines that a task has not had lately."""
    if len(seen) > most:
        seen.clear()
    lines, keys = [], []
    for _, _, line, key in keyed_lines(texts):
        if key not in seen and wanted(line):
            seen.add(key)
            lines.append(line)
            keys.append(key)
    return lines, keys


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, per_line: int = 4) -> tuple[DataFrame, DataFrame]:
    """(occurrences, groups): stored tables (key, id, text_hash, line) and (key, group) of lines that are linked to others."""
    docs = pick(docs, id_col, text_col)
    kind = docs.schema["c0"].dataType.simpleString()
    spaces = least_words(similarity) - 1

    def places(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts, marks = (batch.column(i).slice(at, 256) for i in range(3))
                found = [(text, number, key) for text, number, _, key in keyed_lines(texts.to_pylist())]
                text, number, key = (np.array(x, t) for x, t in zip(zip(*found) if found else ((),) * 3, (np.int64, np.int64, np.uint64)))
                columns = [pa.array(key.view(np.int64)), ids.take(pa.array(text)), marks.take(pa.array(text)), pa.array(number, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "text_hash", "line"])

    occurrences = stash(map_batches(docs.select("c0", "c1", F.xxhash64("c1").alias("mark")), places, f"key long, id {kind}, text_hash long, line int"))
    size = docs.agg(F.sum(F.octet_length("c1"))).first()[0]
    # a line sends about a quarter of its words, of seven bytes or so
    parts = 1 + int((size or 0) / 28) // (1 << 20)
    rare = docs.sparkSession.sparkContext.broadcast(rarity(word_counts(docs.select("c1"), spaces + 1), 1.0, similarity))

    def sends(least: int, most: float):
        def send(read):
            seen: set[int] = set()
            for rows in batches_of_texts(read, 0):
                lines, keys = _unseen([t for (t,) in rows], seen, lambda line: least <= line.count(b" ") < most)
                if lines:
                    yield line_rows(hash_lines(lines, keys), rare.value, similarity)

        return send

    shift = lambda n, m: edits(np.maximum(n, m), similarity)
    # a changed word moves two parities, an added one one; as many are added as the lengths differ
    differ = lambda n, m: 2 * edits(np.maximum(n, m), similarity) - np.abs(n - m)
    meet = lambda send, below: stash(candidates(docs.select("c1"), send, similarity, per_line, parts, shift, differ, below=below))
    # the first pass has the lines that a shorter one than CUT can be alike to, too
    found = meet(sends(spaces, longest(CUT - 1, similarity)), CUT).unionByName(meet(sends(max(spaces, CUT - 1), math.inf), None))
    needed = stash(needed_keys(found))
    wanted = key_filter(needed)

    def words_of(read):
        seen: set[int] = set()
        for rows in batches_of_texts(read, 0):
            lines, keys = _unseen([t for (t,) in rows], seen, lambda line: line.count(b" ") >= spaces)
            own = np.array(keys, np.uint64)
            for i in np.flatnonzero(wanted(own)).tolist():
                yield int(own[i].view(np.int64)), lines[i]

    contents = map_rows(docs.select("c1"), "key long, content binary", words_of)
    linked = verified(found, needed, contents, _word_hashes, lambda x: Judge(x, similarity), similarity, differ)
    return occurrences, connected_components(linked).select(F.col("node").alias("key"), F.col("component").alias("group"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, text_hash, lines): the numbers of the lines that go, for each document that loses some."""
    occurrences, groups = line_groups(docs, id_col, text_col, **options)
    # where and how often each distinct line occurs, made before lines are shuffled; then the same for each group
    first = F.min(F.struct(F.col("id").isNull(), "id", "text_hash", "line"))
    each = occurrences.groupBy("key").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    grouped = each.join(groups, "key", "left").withColumn("group", F.coalesce("group", "key"))
    keepers = grouped.groupBy("group").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 1")
    keep = stash(grouped.select("key", "group").join(keepers, "group").select("key", F.col("first.id").alias("k_id"), F.col("first.text_hash").alias("k_hash"), F.col("first.line").alias("k_line")))
    stays = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash")) & (F.col("line") == F.col("k_line"))
    gone = occurrences.join(keep, "key").where(~stays)
    return gone.groupBy("id", "text_hash").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the text of the lines that stay, and n_lines and n_removed (0 for null texts) as two further columns.

    Columns of those names in ``docs`` are replaced.
    """
    gone = removed_lines(docs, id_col, text_col, **options).hint("shuffle_hash")
    flat = renamed(docs)
    at = docs.columns.index(text_col)
    key, whole = F.col(f"x{docs.columns.index(id_col)}"), F.col(f"x{at}")
    rows = flat.join(gone, key.eqNullSafe(F.col("id")) & (F.xxhash64(whole) == F.col("text_hash")), "left").select(*flat.columns, "lines")
    kept = [i for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_removed")]
    fields = [StructField(f"x{i}", flat.schema[i].dataType) for i in kept]
    schema = StructType([*fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())])

    def leave_out(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                text, lines = part.column(at), part.column(part.num_columns - 1)
                breaks = pc.fill_null(pc.count_substring(text, "\n"), -1).to_numpy() + 1
                lost = pc.fill_null(pc.list_value_length(lines), 0).to_numpy().astype(np.int64)
                hit = np.flatnonzero(lost)
                if len(hit):
                    new = []
                    for t, out in zip(text.take(pa.array(hit)).to_pylist(), lines.take(pa.array(hit)).to_pylist()):
                        gone_here = set(out)
                        new.append("\n".join([line for i, line in enumerate(t.split("\n")) if i not in gone_here]))
                    text = pc.replace_with_mask(text, pa.array(lost > 0), pa.array(new, text.type))
                columns = [text if i == at else part.column(i) for i in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(breaks.astype(np.int64)), pa.array(lost)], schema.names)

    return map_batches(rows, leave_out, schema).toDF(*(docs.columns[i] for i in kept), "n_lines", "n_removed")
