"""Mixing sources to target weights: Efraimidis-Spirakis sampling in DataFrame operations alone.

Every source gets a target number of tokens. The target is first met by complete epochs (every document as often), and the
rest by a weighted sample without replacement: a document's key is an exponential variate divided by its quality weight,
documents are taken in ascending order of their keys, and their sizes are summed up to the rest of the budget. The document
on the border is taken when more than half of it lies inside.

The variate comes from the MD5 of the id (and a seed), so reruns agree on any cluster. Prefix sums need no task that holds a
source: keys are cut into ``per_octave`` ranges for each doubling, the ranges' sums are accumulated for each source, and
each range is sorted by itself. No range holds more than about ln(2) / (e * per_octave) of a source's documents of equal weight.

Defined results: a null text has size 0, and a document of size 0 is taken as often as complete epochs say. Rows with equal
ids have equal keys, and follow each other by size. A null id is hashed as an empty one. A null source is a source of its
own, the last. A table without words gives targets of 0. Columns besides id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import stash

WORD_REGEX = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
SYMBOLS = "#*$%&|<>"


def word_count(text: str) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    """The square of the share of a text's characters that are not markup or symbols, 0.05 at least; 1 for empty texts."""
    plain = F.length(F.translate(F.col(text), SYMBOLS, "")) / F.nullif(F.length(text), F.lit(0))
    return F.greatest(F.lit(0.05), F.coalesce(plain * plain, F.lit(1.0)))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> also weight and target.

    Sources by code point, null last, weigh ``cycle`` over and over. Targets share ``share`` of all sizes by weight; none is
    above ``max_epochs`` times its source, and what is cut off goes to the others by weight. That fixed point is found
    directly: in ascending order of cap / weight, the sources up to some rank are capped, and all others get one common
    multiple of their weight. The windows run over one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), "rank")
    everything = Window.partitionBy(F.lit(0))
    so_far = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        capped.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(so_far), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0)))
        # the level at which this source and all after it would be, were none of them capped
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
        .withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("cap").cast("double") / F.col("weight"), "rank", "level"))).over(everything))
    )
    target = F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("final.level") * F.col("weight")))
    return level.select("source", "source_size", "weight", target.alias("target"))


def sampling_key(key: Column, weight: Column, seed: int = 0) -> Column:
    """An exponential variate over the weight: -ln(u) / weight, u in (0, 1) from 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / weight


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    quality: Column | None = None,
    cycle: tuple[int, ...] = CYCLE,
    share: float = 1.0,
    max_epochs: int = 3,
    seed: int = 0,
    per_octave: int = 128,
    keep_row: bool = False,
) -> DataFrame:
    """One row per input row: id, size, source, source_size, target, taken (words, repeats counted) and copies (times taken).

    ``quality`` is a column of weights above 0, by default ``quality_weight``. With ``keep_row`` the input's columns are also
    returned, as a struct ``row``.
    """
    extra = [F.struct(*docs.columns).alias("row")] if keep_row else []
    weight = quality_weight(text_col) if quality is None else quality
    table = docs.select(F.col(id_col).alias("k"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), sampling_key(F.col(id_col), weight, seed).alias("key"), *extra)
    table = table.withColumn("bucket", F.floor(F.log2("key") * per_octave).cast("int"))

    sums = table.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), cycle, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = sources.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(order), F.lit(0)))
    if keep_row:
        return _mix_in_place(table, starts, plan, id_col)
    spans = starts.join(plan, starts.source.eqNullSafe(plan.source)).select(starts.source.alias("s"), F.col("bucket").alias("b"), "source_size", "target", "epochs", "rest", "before")

    placed = table.join(spans, table.source.eqNullSafe(spans.s) & (table.bucket == spans.b))
    inside = Window.partitionBy("s", "b").orderBy("key", "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    columns = [F.col("k").alias(id_col), "size", "source", "source_size", "target"]
    chosen = placed.drop("bucket").withColumn("copies", F.col("epochs") + ((middle <= F.col("rest")) & (F.col("size") > 0)).cast("long"))
    return chosen.select(*columns, (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _mix_in_place(table: DataFrame, starts: DataFrame, plan: DataFrame, id_col: str) -> DataFrame:
    """The same choice for rows that are not to be moved: whole ranges are taken or not, so only those of the one range of each
    source in which its budget ends are sorted."""
    end = F.col("before") + F.col("bucket_size")
    inside, across = end <= F.col("rest"), (F.col("before") < F.col("rest")) & (end > F.col("rest"))
    ends = starts.join(plan, starts.source.eqNullSafe(plan.source)).groupBy(starts.source.alias("s"), "source_size", "target", "epochs", "rest")
    found = ends.agg(F.max(F.when(inside, F.col("bucket"))).alias("upto"), F.min(F.when(across, F.col("bucket"))).alias("border"), F.min(F.when(across, F.col("before"))).alias("before"))
    # stored, so that its size is known: one row for each source
    found = stash(found)
    placed = table.join(found, table.source.eqNullSafe(found.s))
    whole = placed.where("border IS NULL OR bucket != border").withColumn("more", F.coalesce(F.col("bucket") <= F.col("upto"), F.lit(False)))
    order = Window.partitionBy("s").orderBy("key", "k", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    cut = placed.where("bucket = border").withColumn("more", middle <= F.col("rest"))
    chosen = whole.unionByName(cut).withColumn("copies", F.col("epochs") + (F.col("more") & (F.col("size") > 0)).cast("long"))
    return chosen.select(F.col("k").alias(id_col), "size", "source", "source_size", "target", "row", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The rows of a mix made with ``keep_row``, each as often as it was taken."""
    return mixed.where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
