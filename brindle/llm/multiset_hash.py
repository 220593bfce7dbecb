"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line between ``\\n``) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs'
vectors, each lane modulo a power of two. So the order of the paragraphs does not matter, and a paragraph is inserted or
deleted by adding or subtracting its vector, without the rest of the document.

The vector has two parts. 64 lanes modulo 2^16 are taken from an extendable-output hash of the paragraph: equal sums mean
equal multisets of paragraphs. 128 lanes modulo 2^32 are a signed count sketch of the paragraph's word pairs: sums of those
still tell how alike two documents are (the cosine of the sketches, 0 to 1).

Defined results: a null text counts as empty; an empty text has no paragraphs and the zero fingerprint; two zero sketches
are alike (1), a zero one and another are not (0). Rows with equal ids follow each other by text.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import map_rows

EQUAL_LANES = 64
SKETCH_LANES = 128
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Fingerprint:
    """Two lane vectors: ``equal`` (uint16) and ``sketch`` (uint32). Sums and differences wrap round."""

    __slots__ = ("equal", "sketch")

    def __init__(self, equal: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.equal = np.zeros(EQUAL_LANES, "<u2") if equal is None else equal
        self.sketch = np.zeros(SKETCH_LANES, "<u4") if sketch is None else sketch

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, self.sketch - other.sketch)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.equal == other.equal).all() and (self.sketch == other.sketch).all())

    __hash__ = None

    def hex(self) -> str:
        return self.equal.tobytes().hex() + self.sketch.tobytes().hex()

    @classmethod
    def from_hex(cls, text: str) -> Fingerprint:
        raw = bytes.fromhex(text)
        return cls(np.frombuffer(raw[: 2 * EQUAL_LANES], "<u2").copy(), np.frombuffer(raw[2 * EQUAL_LANES :], "<u4").copy())

    def likeness(self, other: Fingerprint) -> float:
        """Cosine of the sketches, 0 at least; 1 exactly when the fingerprints are equal."""
        if self == other:
            return 1.0
        a, b = (x.sketch.view("<i4").astype(np.float64) for x in (self, other))
        size = float(np.sqrt((a @ a) * (b @ b)))
        if not size:
            return 0.0
        return min(max(float(a @ b) / size, 0.0), 1.0 - 2.0**-40)


def fingerprint(text: str | None) -> Fingerprint:
    """The sum over all paragraphs of the text."""
    if not text:
        return Fingerprint()
    paragraphs = text.encode("utf-8", "surrogatepass").split(b"\n")
    raw = b"".join(hashlib.shake_128(p).digest(2 * EQUAL_LANES) for p in paragraphs)
    equal = np.frombuffer(raw, "<u2").reshape(-1, EQUAL_LANES).sum(axis=0, dtype=np.uint64).astype("<u2")
    words: list[bytes] = []
    starts: list[int] = []
    for p in paragraphs:
        starts.append(len(words))
        words += p.split()
    if not words:
        return Fingerprint(equal)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    before = np.concatenate([np.zeros(1, np.uint64), one[:-1]])
    before[[s for s in starts if s < len(words)]] = 0  # pairs do not cross paragraphs
    pair = (before * _MIX ^ one) * _MIX
    pair ^= pair >> np.uint64(31)
    sign = 1.0 - 2.0 * ((pair >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
    sums = np.bincount((pair & np.uint64(SKETCH_LANES - 1)).astype(np.int64), weights=sign, minlength=SKETCH_LANES)
    return Fingerprint(equal, (sums.astype(np.int64) & 0xFFFFFFFF).astype("<u4"))


def multiset_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars and the fingerprint in hex. One pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(read):
        for key, text in read:
            yield key, len(text or ""), fingerprint(text).hex()

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, n_chars long, fingerprint string", rows)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


NEIGHBOUR_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 4000, max_ranges: int = 20000) -> DataFrame:
    """Each text, its edited text (see ``edited``) and the next text by ascending id, fingerprinted and compared.

    Texts move once: they are dealt to ranges of ids and sorted there, and the first row of each range is also sent to
    the range before it (the very first to the last one), so that every row meets its successor while rows stream by. Only
    the smallest id of each range, at most ``max_ranges`` of them, comes to the driver. Null ids come first.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    table = docs.select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total, nulls = table.agg(F.count(F.lit(1)), F.count_if(F.col("k").isNull())).first()
    ranges = max(1, min(max_ranges, -(-total // rows_per_range)))
    firsts = table.where(F.col("k").isNotNull()).select("k").repartitionByRange(ranges, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    bounds = sorted(r.k for r in firsts.collect())
    last = max(0, len(bounds) - 1)

    def deal(read: Iterator[tuple]) -> Iterator[tuple]:
        extra: dict[int, tuple] = {}  # by the range before: its first successor among this task's rows
        for key, text in read:
            at = 0 if key is None else bisect.bisect_right(bounds, key) - 1
            yield at, False, key, text
            if at == 0:
                to = last if key is None or (not nulls and bounds[0] == key) else None
            else:
                to = at - 1 if bounds[at] == key else None
            if to is not None and (to not in extra or text < extra[to][1]):
                extra[to] = key, text
        for to, (key, text) in extra.items():
            yield to, True, key, text

    def walk(read: Iterator[tuple]) -> Iterator[tuple]:
        held = None  # (range, key, text, fingerprint) that waits for its successor
        for at, extra, key, text in read:
            mark = None
            if held and held[0] == at:
                own, mark = held[3], fingerprint(text)
                new = edited(held[2], text)
                changed = fingerprint(new)
                sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                yield held[1], len(held[2]), sha, own.hex(), changed.hex(), own.likeness(changed), own.likeness(mark)
            held = None if extra else (at, key, text, mark or fingerprint(text))

    dealt = map_rows(table, f"p int, extra boolean, k {kind}, t string", deal, chunk=1024)
    sorted_ = dealt.repartitionById(ranges, F.col("p")).sortWithinPartitions("p", "extra", "k", "t")
    out = map_rows(sorted_, f"k {kind}, {NEIGHBOUR_SCHEMA}", walk)
    return out.withColumnRenamed("k", id_col)
