"""Quality rules: compression bands.

A document's zstandard ratio (compressed bytes / bytes of its UTF-8 form) is small when the text repeats itself and large
when it is noise. The usual ratio depends on the length, so each length band has its own limits. The whole document is
measured, and each fixed chunk of it as well, so that a long document with a repetitive or random stretch is seen.

``fit_bands`` takes the limits from documents that are labelled as good: half an octave of lengths is a band, and its limits
are the outermost ratios of its good documents but for a small share on each side, with a margin. All good ones are measured
and the ranks are exact. Bands with too few of them keep the wide limits of ``Bands``.

Defined results: without any good document the limits are those of ``Bands``. A null text counts as an empty one; an empty text has ratio 0 and no chunks, and fails the base rules.
Rows are judged one by one, so ties, repeated rows and null ids change nothing. Empty tables give empty ones. Columns other than the id and the text are
not looked at; ``filter_quality`` returns them untouched whatever their names are.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import SPACE_BYTES, map_batches, map_rows, pick, renamed, stash
from brindle.llm.lines import key_filter

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Bands:
    """Limits by length. ``edges`` are lengths in bytes; band i holds lengths from edges[i] up to edges[i + 1].

    A ratio below ``low`` is repetitive, one above ``high`` incompressible. A document goes when its own ratio is outside
    its band, or when chunks outside theirs hold more than ``max_bad_share`` of its bytes.
    """

    edges: tuple[int, ...] = (0, 256, 1024, 4096, 16384, 65536)
    low: tuple[float, ...] = (0.32, 0.28, 0.22, 0.18, 0.15, 0.12)
    high: tuple[float, ...] = (9.0, 0.85, 0.76, 0.72, 0.70, 0.70)
    chunk_bytes: int = 4096
    max_bad_share: float = 0.25
    level: int = 3

    def verdict(self, ratio: float, size: int) -> int:
        """-1: repetitive, 1: incompressible, 0: inside the band."""
        at = bisect_right(self.edges, size) - 1
        return -1 if ratio < self.low[at] else 1 if ratio > self.high[at] else 0


@dataclass(frozen=True)
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    ratio: float
    n_chunks: int
    bad_share: float
    verdict: str

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words

    @property
    def kept(self) -> bool:
        return not self.base_failed and self.verdict == "ok"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Number of word positions inside windows of ``window`` words that occur at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for i in range(window):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[i : i + n]
    order = np.sort(rolled)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    # equal hashes are only candidates: the words decide
    at = np.flatnonzero(np.isin(rolled, twice)).tolist()
    windows = [tuple(words[i : i + window]) for i in at]
    seen = Counter(windows)
    cover = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(at, windows):
        if seen[w] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int(np.count_nonzero(np.cumsum(cover)))


def measure(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> Measures:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = Counter(line for line in data.split(b"\n") if line.strip(SPACE_BYTES))
    size = len(data)
    ratio, bad, n_chunks, verdict = 0.0, 0, 0, 0
    if size:
        ratio = len(packer.compress(data)) / size
        verdict = bands.verdict(ratio, size)
        step = bands.chunk_bytes
        if size <= step:
            n_chunks, bad = 1, size * (verdict != 0)
        else:
            for at in range(0, size, step):
                part = data[at : at + step]
                n_chunks += 1
                bad += len(part) * (bands.verdict(len(packer.compress(part)) / len(part), len(part)) != 0)
    share = bad / size if size else 0.0
    said = "repetitive" if verdict < 0 else "incompressible" if verdict > 0 else "chunks" if share > bands.max_bad_share else "ok"
    return Measures(
        n_words=len(words),
        word_chars=len(text) - (size - len(data.translate(None, SPACE_BYTES))),
        n_symbols=size - len(data.translate(None, SYMBOLS)),
        n_dup_lines=sum(lines.values()) - len(lines),
        n_repeat_words=repeated_words(words),
        ratio=ratio,
        n_chunks=n_chunks,
        bad_share=share,
        verdict=said,
    )


#: Bands of half an octave, from 128 bytes to 1 MB.
FINE_EDGES = (0, *(int(2 ** (k / 2)) for k in range(14, 41)))


def good_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """The ids whose label is 1."""
    return pick(labels, id_col, quality_col).where("c1 = 1").select("c0")


#: Ratios are counted in cells of this width before the ones of a rank are looked for.
CELL = 1 / 4096


def outer_ranks(ratios: DataFrame, tail: float, least_rows: int) -> dict[int, list[float]]:
    """band -> its ratios at the shares ``tail`` and 1 - ``tail``, of a stored (band, ratio) table, between two ranks in
    proportion; only of bands of ``least_rows`` rows or more. Counts of cells, and ratios of four ranks a band, come to the driver."""
    cell = F.floor(F.col("ratio") / CELL).cast("long").alias("cell")
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in ratios.groupBy("band", cell).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r.band, []).append((r.cell, r.n))
    asked: dict[int, list[tuple[tuple[int, int], tuple[int, int], float]]] = {}
    for band, cells in counts.items():
        cells.sort()
        ends = np.cumsum([n for _, n in cells])
        if ends[-1] < least_rows:
            continue

        def at(rank: int) -> tuple[int, int]:
            i = int(np.searchsorted(ends, rank, side="right"))
            return cells[i][0], rank - int(ends[i]) + cells[i][1] + 1

        spots = [share * (int(ends[-1]) - 1) for share in (tail, 1 - tail)]
        asked[band] = [(at(int(x)), at(min(int(x) + 1, int(ends[-1]) - 1)), x - int(x)) for x in spots]
    if not asked:
        return {}
    wanted = sorted({(band, *spot) for band, two in asked.items() for below, above, _ in two for spot in (below, above)})
    ranks = ratios.sparkSession.createDataFrame(wanted, "band int, cell long, rank int")
    near = ratios.select("band", cell, "ratio").join(F.broadcast(ranks.select("band", "cell").distinct()), ["band", "cell"])
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("band", "cell").orderBy("ratio")))
    found = {(r.band, r.cell, r.rank): r.ratio for r in ranked.join(F.broadcast(ranks), ["band", "cell", "rank"], "left_semi").collect()}
    return {band: [(1 - part) * found[band, *below] + part * found[band, *above] for below, above, part in two] for band, two in asked.items()}


def fit_bands(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: float = 0.005, margin: float = 0.01, least_rows: int = 50, wide: Bands = Bands()) -> Bands:
    """Bands whose limits leave out ``tail`` of the good documents on each side, less a margin. ``good`` is a one-column
    table of ids, whose documents are all measured; a filter of bounded size leaves most others out before that, and a join
    on the ids the rest, so texts are not moved."""
    table = pick(docs, id_col, text_col)
    kind = table.schema["c0"].dataType
    ids = stash(good.select(F.col(good.columns[0]).try_cast(kind).alias("id")).where("id IS NOT NULL").distinct())
    wanted = key_filter(ids.select(F.xxhash64("id").alias("key")))

    def ratios(read):
        packer = zstandard.ZstdCompressor(level=wide.level)
        for key, text, mark in read:
            if wanted(np.array([mark], np.int64).view(np.uint64))[0] and not (m := measure(text, wide, packer)).base_failed:
                size = len((text or "").encode("utf-8", "surrogatepass"))
                yield key, bisect_right(FINE_EDGES, size) - 1, m.ratio

    measured = map_rows(table.where("c0 IS NOT NULL").select("c0", "c1", F.xxhash64("c0").alias("mark")), f"id {kind.simpleString()}, band int, ratio double", ratios)
    found = outer_ranks(stash(measured.join(ids, "id", "left_semi").select("band", "ratio")), tail, least_rows)
    low, high = [], []
    for band, edge in enumerate(FINE_EDGES):
        at = bisect_right(wide.edges, edge) - 1
        least, most = found.get(band, (wide.low[at] + margin, wide.high[at] - margin))
        low.append(least - margin)
        high.append(most + margin)
    return Bands(FINE_EDGES, tuple(low), tuple(high), wide.chunk_bytes, wide.max_bad_share, wide.level)


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "zstd_ratio double, n_chunks long, bad_chunk_share double, verdict string"
)


def quality_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per input row: the id and the measures of the whole text. One pass, no shuffle."""
    table = pick(docs, id_col, text_col)
    kind = table.schema["c0"].dataType.simpleString()

    def rows(read):
        packer = zstandard.ZstdCompressor(level=bands.level)
        for key, text in read:
            m = measure(text, bands, packer)
            yield (key, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, m.kept, m.ratio, m.n_chunks, m.bad_share, m.verdict)

    return map_rows(table, f"id {kind}, {SCHEMA}", rows).withColumnRenamed("id", id_col)


def filter_quality(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the bands, with all their columns. One pass, no shuffle."""
    at = docs.columns.index(text_col)
    flat = renamed(docs)

    def run(batches):
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield part.filter(pa.array([measure(t, bands, packer).kept for t in part.column(at).to_pylist()], pa.bool_()))

    return map_batches(flat, run, flat.schema).toDF(*docs.columns)
