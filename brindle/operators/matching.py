"""Entity matching across two knowledge graphs.

Triples carry ``kg`` (1 or 2) instead of id ranges. Everything is one lazy plan: block sizes, purging, splitting, candidates,
attributes, filters, similarity and evaluation. Blocks of arrays are made for reports and splitting; candidates come from an
equi-join of the token table, which Spark can split where a token is frequent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.storage import map_batches

#: The English stop words of Spark's own remover.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
did doing a an the and but if or because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where why how all any both each few more
most other some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll
they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's
let's ought that's there's what's when's where's who's why's would
""".split()


def stop_words() -> list[str]:
    return STOP_WORDS


def true_alignment(cells: DataFrame) -> DataFrame:
    """(entity1, entity2) of cells (subject) that have an alignment relation ``"="``, quotes included."""
    named = lambda n: F.max(F.when(F.col("predicate").endswith(n), F.col("object")))
    equal = F.bool_or(F.col("predicate").endswith("alignmentrelation") & (F.col("object") == '"="'))
    grouped = cells.groupBy("subject").agg(named("alignmententity1").alias("entity1"), named("alignmententity2").alias("entity2"), equal.alias("equal"))
    return grouped.where("equal").select("entity1", "entity2").distinct()


def literal_tokens(triples: DataFrame, id_col: str = "id", object_col: str = "object", keep_numeric: bool = True, lemmatizer=None) -> DataFrame:
    """(id, token), one row for each token of each literal; ``lemmatizer`` maps an array column of tokens to one of lemmas."""
    found = C.tokens(F.col(object_col), stop_words(), keep_numeric)
    if lemmatizer:
        found = lemmatizer(found)
    keep = [c for c in triples.columns if c in (id_col, "kg")]
    return triples.select(*keep, F.explode(found).alias("token"))


def block_sizes(tokens: DataFrame, max_possible: int | Column, fraction: float = 0.02) -> DataFrame:
    """(token, n1, n2) of blocks with ids of both graphs and less than ``fraction`` of ``max_possible`` on the smaller side."""
    pairs = tokens.select("token", "kg", "id").distinct()
    of = lambda kg: F.count_if(F.col("kg") == kg)
    sizes = pairs.groupBy("token").agg(of(1).alias("n1"), of(2).alias("n2"))
    limit = F.lit(fraction) * (F.lit(max_possible) if not isinstance(max_possible, Column) else max_possible)
    return sizes.where((F.col("n1") > 0) & (F.col("n2") > 0) & (F.least("n1", "n2") < limit))


def token_blocks(tokens: DataFrame, max_possible: int | Column, fraction: float = 0.02) -> DataFrame:
    """(token, ids1, ids2, n_cmp) of the blocks that stay, ids in ascending order."""
    kept = tokens.join(block_sizes(tokens, max_possible, fraction).select("token"), "token", "left_semi")
    ids = lambda kg: F.array_sort(F.collect_set(F.when(F.col("kg") == kg, F.col("id"))))
    blocks = kept.groupBy("token").agg(ids(1).alias("ids1"), ids(2).alias("ids2"))
    return blocks.withColumn("n_cmp", F.size("ids1").cast("long") * F.size("ids2"))


def split_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with more comparisons than the mean are cut along their larger side (that of graph 2 when both are equal)."""
    mean = blocks.agg(F.avg("n_cmp").alias("mean"))
    sized = blocks.crossJoin(F.broadcast(mean))
    n1, n2 = F.size("ids1").cast("long"), F.size("ids2").cast("long")
    parts = C.smallest_divisor(n1, n2, F.col("mean"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.greatest(n1, n2) / parts))
    second = n1 <= n2
    small = sized.where(F.col("n_cmp") <= F.col("mean")).select("token", "ids1", "ids2")
    large = sized.where(F.col("n_cmp") > F.col("mean"))
    cut2 = large.where(second).select("token", "ids1", F.explode(C.chunks(F.col("ids2"), step)).alias("ids2"))
    cut1 = large.where(~second).select("token", F.explode(C.chunks(F.col("ids1"), step)).alias("ids1"), "ids2")
    every = small.unionByName(cut2).unionByName(cut1)
    return every.withColumn("n_cmp", F.size("ids1").cast("long") * F.size("ids2"))


def pairs_of_blocks(blocks: DataFrame) -> DataFrame:
    """Distinct (id1, id2) of blocks made of arrays."""
    return blocks.select(F.explode("ids1").alias("id1"), "ids2").select("id1", F.explode("ids2").alias("id2")).distinct()


def candidate_pairs(tokens: DataFrame, max_possible: int | Column, fraction: float = 0.02) -> DataFrame:
    """Distinct (id1, id2) that share a block, by an equi-join on the token."""
    kept = tokens.join(block_sizes(tokens, max_possible, fraction).select("token"), "token", "left_semi")
    side = lambda kg: kept.where(F.col("kg") == kg).select("token", F.col("id").alias(f"id{kg}")).distinct()
    return side(1).join(side(2), "token").select("id1", "id2").distinct()


def entity_attributes(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, subject, rel_name, subj_name, category, subcategory) of the triples whose id is among ``ids``."""
    found = triples.join(ids.select("id").distinct(), "id", "left_semi")
    return found.select("id", "subject", C.local_name(F.col("predicate")).alias("rel_name"), *C.entity_parts("subject"))


def filter_candidates(pairs: DataFrame, attributes: DataFrame, predicates: bool = True, categories: bool = True) -> DataFrame:
    """Pairs with the same relation name, and the same category and subcategory; names are kept as subject1, subject2, name1, name2.

    The bigrams of names (grams1, grams2) are made once for each entity, before the join.
    """
    grams = C.numbered(C.bigrams(F.col("subj_name")))
    side = lambda n: attributes.select(*(F.col(c).alias(f"{c}{n}") for c in ("id", "subject", "rel_name", "subj_name", "category", "subcategory")), grams.alias(f"grams{n}"))
    joined = pairs.join(side(1), "id1").join(side(2), "id2")
    if predicates:
        joined = joined.where("rel_name1 = rel_name2")
    if categories:
        joined = joined.where("category1 = category2 AND subcategory1 = subcategory2")
    return joined.select("id1", "id2", "subject1", "subject2", F.col("subj_name1").alias("name1"), F.col("subj_name2").alias("name2"), "grams1", "grams2")


TRAITS = ["subject", "rel_name", "subj_name", "category", "subcategory"]


def _alike(members: DataFrame, attributes: DataFrame, chunk: int) -> DataFrame:
    """(block, kg, TRAITS, part, ids): members of a block that differ in their ids alone as one, about ``chunk`` of them at most."""
    keys = ["block", "kg", *TRAITS]
    rows = members.distinct().join(attributes.select("id", *TRAITS), "id").withColumn("mark", F.xxhash64(*keys))
    large = rows.groupBy("mark").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    return rows.join(large, "mark", "left").groupBy(*keys, part.alias("part")).agg(F.collect_list("id").alias("ids"))


def block_pairs(members: DataFrame, attributes: DataFrame, predicates: bool = True, categories: bool = True, chunk: int = 1024, deal: int = 16) -> DataFrame:
    """Pairs of members (block, id, kg) of a block, one of each graph, filtered like ``filter_candidates``: in the columns ids1,
    ids2, subject1, subject2, name1, name2, grams1, grams2. Each id of ids1 with each of ids2 is a pair (once for each block
    that both are in); pairs are made behind the last exchange and not stored.

    Members that differ in their ids alone are paired as one, about ``chunk`` of them at most. Those of graph 1 are dealt to
    ``deal`` tasks a block, and those of graph 2 are sent to each of these, so that few blocks keep many tasks busy.
    """
    alike = _alike(members, attributes, chunk)
    n_parts = max(64, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def side(n: int, task) -> DataFrame:
        dealt = alike.where(F.col("kg") == n).select("block", task.alias("task"), F.col("ids").alias(f"ids{n}"), *(F.col(c).alias(f"{c}{n}") for c in TRAITS))
        # bigrams are made behind the exchange, so they are not moved
        return dealt.repartition(n_parts, "block", "task").withColumn(f"grams{n}", C.numbered(C.bigrams(F.col(f"subj_name{n}"))))

    own, each = F.pmod(F.xxhash64("block", "kg", *TRAITS, "part"), F.lit(deal)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long")))
    joined = side(1, own).join(side(2, each).hint("shuffle_hash"), ["block", "task"])
    if predicates:
        joined = joined.where("rel_name1 = rel_name2")
    if categories:
        joined = joined.where("category1 = category2 AND subcategory1 = subcategory2")
    return joined.select("ids1", "ids2", "subject1", "subject2", F.col("subj_name1").alias("name1"), F.col("subj_name2").alias("name2"), "grams1", "grams2")


def each_id(pairs: DataFrame) -> DataFrame:
    """Pairs of ids1 and ids2 as one row for each pair of ids, id1 and id2."""
    others = [c for c in pairs.columns if c not in ("ids1", "ids2")]
    return pairs.select(F.explode("ids1").alias("id1"), "ids2", *others).select("id1", F.explode("ids2").alias("id2"), *others)


def similarities(pairs: DataFrame) -> DataFrame:
    """Pairs with ``sim``, the similarity of their names; null where neither has a character."""
    return pairs.withColumn("sim", C.set_similarity(F.col("grams1"), F.col("grams2")))


#: Names are compared so many of graph 1 with so many of graph 2 at a time, by so many of their bigrams at a time.
FIRST, SECOND, GRAMS = 1024, 2048, 2048
#: Rows of a batch of pairs.
OUT = 1 << 18


class Names:
    """Some names by the numbers of their numbered bigrams in ``known``; with ``learn``, new ones get a number, else they only count in ``sizes``."""

    def __init__(self, names: list[str | None], known: dict[tuple[str | None, int], int], learn: bool):
        rows, grams, self.sizes = [], [], np.zeros(len(names), np.int64)
        for row, name in enumerate(names):
            # a null name has a null for its one bigram, as ``bigrams`` has it
            own = [None] if name is None else [name[i : i + 2] for i in range(max(len(name) - 1, min(len(name), 1)))]
            self.sizes[row] = len(own)
            seen: dict[str | None, int] = {}
            for gram in own:
                seen[gram] = often = seen.get(gram, 0) + 1
                at = known.setdefault((gram, often), len(known)) if learn else known.get((gram, often))
                if at is not None:
                    rows.append(row)
                    grams.append(at)
        self.rows, self.grams = np.array(rows, np.int64), np.array(grams, np.int64)

    def matrix(self, low: int, high: int, first: int, end: int) -> np.ndarray:
        """Which of the bigrams from first to end the names from low to high have, as ones."""
        out = np.zeros((high - low, end - first), np.float32)
        s, e = np.searchsorted(self.rows, [low, high])
        fit = (self.grams[s:e] >= first) & (self.grams[s:e] < end)
        out[self.rows[s:e][fit] - low, self.grams[s:e][fit] - first] = 1
        return out


def _quotient(shared: int, total: int, digits: int | None) -> float:
    """The similarity, rounded like Spark's ``round``; not a number where both names are empty."""
    if not total:
        return math.nan
    value = shared / total
    return value if digits is None else float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


@lru_cache(64)
def _quotients(shared: int, total: int, digits: int | None) -> np.ndarray:
    """Similarities of up to so many shared bigrams of up to so many, at shared * (most of all + 1) + all."""
    return np.array([_quotient(x, y, digits) for x in range(shared + 1) for y in range(total + 1)])


def name_similarities(one: Names, at: int, upto: int, two: Names, begin: int, end: int, known: int, digits: int | None) -> np.ndarray:
    """Similarities of names at to upto with names begin to end; not a number where neither has a character. Bigrams in
    common are the product of two matrices of zeros and ones, so all are counted exactly."""
    shared = np.zeros((upto - at, end - begin), np.float32)
    for low in range(0, known, GRAMS):
        high = min(known, low + GRAMS)
        shared += one.matrix(at, upto, low, high) @ two.matrix(begin, end, low, high).T
    a, b = one.sizes[at:upto], two.sizes[begin:end]
    most, total = int(min(a.max(), b.max())), int(a.max() + b.max())
    key = shared.astype(np.int64 if most * total > 1 << 30 else np.int32) * (total + 1)
    key += a.astype(key.dtype)[:, None]
    key += b.astype(key.dtype)[None, :]
    if (most + 1) * (total + 1) <= 1 << 16:
        out = _quotients(most, total, digits)[key]
    else:
        found, where = np.unique(key, return_inverse=True)
        out = np.array([_quotient(*divmod(k, total + 1), digits) for k in found.tolist()])[where].reshape(key.shape)
    return out


def scored_pairs(members: DataFrame, attributes: DataFrame, predicates: bool = True, categories: bool = True, above: float | None = None, digits: int | None = None, chunk: int = 1024, deal: int = 16, held: int = 65_536) -> DataFrame:
    """The pairs of ``block_pairs`` with their similarities: (id1, id2, sim), rounded to ``digits``; with ``above``, instead (entity1,
    entity2) of those with a greater similarity, repeated where they meet more than once.

    Members of graph 1 are dealt to ``deal`` tasks a block, those of graph 2 are sent to each of these, at most about ``held`` at once.
    """
    n_parts = max(64, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # pairs have these alike, and no nulls there
    same = ["block", *["rel_name"] * predicates, *["category", "subcategory"] * categories]
    alike = _alike(members, attributes, chunk).dropna(subset=same).withColumn("group", F.to_json(F.struct(*same)))
    many = alike.where("kg = 2").groupBy("group").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("shares"))
    rows = alike.join(many, "group").withColumn("own", F.xxhash64("ids", "subject"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["group", "task", "share", "kg", "ids", "subject", "subj_name"]
    one = rows.where("kg = 1").withColumn("task", F.pmod("own", F.lit(deal)).cast("int")).withColumn("share", each(F.col("shares")))
    two = rows.where("kg = 2").withColumn("share", F.pmod("own", "shares").cast("int")).withColumn("task", each(F.lit(deal)))
    dealt = one.select(columns).unionByName(two.select(columns)).repartition(n_parts, "group", "task", "share").sortWithinPartitions("group", "task", "share", F.desc("kg"))
    kind = members.schema["id"].dataType.simpleString()

    def results(one: pa.RecordBatch, two: pa.RecordBatch, known: dict, names: Names) -> Iterator[pa.RecordBatch]:
        """Of some rows of graph 1 with the held ones of graph 2."""
        own = Names(one.column("subj_name").to_pylist(), known, False)
        for at in range(0, one.num_rows, FIRST):
            upto = min(one.num_rows, at + FIRST)
            for begin in range(0, two.num_rows, SECOND):
                end = min(two.num_rows, begin + SECOND)
                sim = name_similarities(own, at, upto, names, begin, end, len(known), digits)
                if above is not None:
                    i, j = np.nonzero(sim > above)
                    if len(i):
                        yield pa.RecordBatch.from_arrays([one.column("subject").take(pa.array(i + at)), two.column("subject").take(pa.array(j + begin))], ["entity1", "entity2"])
                    continue
                (ids1, r1), (ids2, r2) = _each_id(one.column("ids").slice(at, upto - at)), _each_id(two.column("ids").slice(begin, end - begin))
                nulls = bool(np.isnan(sim).any())
                wide = sim if len(r2) == end - begin else sim[:, r2]
                step = max(1, OUT // len(r2))
                for k in range(0, len(r1), step):
                    some = r1[k : k + step]
                    value = wide[some].reshape(-1)
                    first = ids1.take(pa.array(np.repeat(np.arange(k, k + len(some)), len(r2))))
                    second = ids2.take(pa.array(np.tile(np.arange(len(r2)), len(some))))
                    yield pa.RecordBatch.from_arrays([first, second, pa.array(value, mask=np.isnan(value) if nulls else None)], ["id1", "id2", "sim"])

    def compare(batches):
        cell, parts, ready = None, [], None
        for batch in batches:
            marks = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            starts = [i for i, x in enumerate(marks) if not i or x != marks[i - 1]]
            for s, e in zip(starts, [*starts[1:], len(marks)]):
                if marks[s][:3] != cell:
                    cell, parts, ready = marks[s][:3], [], None
                if marks[s][3] == 2:
                    parts.append(batch.slice(s, e - s))
                elif parts:
                    if ready is None:
                        two = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                        ready = (two, known := {}, Names(two.column("subj_name").to_pylist(), known, True))
                    yield from results(batch.slice(s, e - s), *ready)

    return map_batches(dealt, compare, "entity1 string, entity2 string" if above is not None else f"id1 {kind}, id2 {kind}, sim double")


def _each_id(ids: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The ids of some rows one after the other, and the row of each."""
    sizes = ids.value_lengths().to_numpy()
    return ids.flatten(), np.repeat(np.arange(len(sizes)), sizes)


def match(pairs: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Distinct (entity1, entity2) above the threshold."""
    return similarities(pairs).where(F.col("sim") > threshold).select(F.col("subject1").alias("entity1"), F.col("subject2").alias("entity2")).distinct()


def evaluate(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_true, n_pred, tp, fp, fn, precision, recall and f_measure (null where undefined)."""
    marks = predicted.distinct().withColumn("p", F.lit(1)).join(truth.distinct().withColumn("t", F.lit(1)), ["entity1", "entity2"], "full")
    counts = marks.agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count_if(F.expr("p = 1 AND t = 1")).alias("tp"))
    d = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    out = counts.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_true") - F.col("tp"))
    out = out.withColumn("precision", d(F.col("tp"), F.col("n_pred"))).withColumn("recall", d(F.col("tp"), F.col("n_true")))
    return out.withColumn("f_measure", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def false_positives(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return predicted.subtract(truth)


def false_negatives(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return truth.subtract(predicted)


def reduce_dataset(kg1: DataFrame, kg2: DataFrame, fraction: float = 0.01, true_triples: DataFrame | None = None, only_true: bool = False, seed: int = 0) -> DataFrame:
    """The triples that matching works on: those of true entities, or with a seeded sample of both graphs besides."""
    from brindle.operators.triples import literal_triples

    if only_true and true_triples is not None:
        return literal_triples(true_triples)
    parts = kg1.sample(False, fraction, seed).unionByName(kg2.sample(False, fraction, seed + 1))
    if true_triples is not None:
        parts = parts.unionByName(true_triples).distinct()
    return literal_triples(parts)


def ranked(df: DataFrame, partition: list[str], by: Column, name: str = "rank") -> DataFrame:
    """0-based position within a partition in the order given; ties share the first position."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*partition).orderBy(by)) - 1)
