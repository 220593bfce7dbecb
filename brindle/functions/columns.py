"""Column expressions: RDF terms, literals and tokens, URIs, bigrams, vectors, losses. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_INTEGER = "http://www.w3.org/2001/XMLSchema#integer"

#: subject, predicate and object of an N-Triples line, terms separated by any white space.
TRIPLE = r"^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$"
LITERAL = r"^\"((?:[^\"\\]|\\.)*)\"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$"


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_comment(line: str) -> Column:
    """A comment or an empty line."""
    return F.col(line).rlike(r"^\s*(#|$)")


def unescape(c: Column) -> Column:
    """The N-Triples escapes for tab, line end, quote and backslash; numeric escapes are decoded one code unit at a time."""
    marked = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    parts = F.split(marked, r"\\u(?=[0-9A-Fa-f]{4})")
    head = F.get(parts, F.lit(0))
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.decode(F.unhex(F.substring(p, 1, 4)), "UTF-16BE"), F.substring(p, 5, 2147483647)))
    plain = F.concat(head, F.array_join(tail, ""))
    for mark, value in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\x00", "\\")):
        plain = F.replace(plain, F.lit(mark), F.lit(value))
    return plain


def parse_triple(line: str) -> list[Column]:
    """subject, predicate, object (raw term without brackets), object_kind, object_value, lang and datatype of a line."""
    c = F.col(line)
    term = lambda i: F.regexp_extract(c, TRIPLE, i)
    iri = lambda t: F.regexp_replace(t, "^<|>$", "")
    obj = term(3)
    literal = obj.startswith('"')
    kind = F.when(literal, "literal").when(obj.startswith("_:"), "blank").otherwise("iri")
    value = F.when(literal, unescape(F.regexp_extract(obj, LITERAL, 1))).otherwise(iri(obj))
    return [
        iri(term(1)).alias("subject"),
        iri(term(2)).alias("predicate"),
        F.when(literal, obj).otherwise(iri(obj)).alias("object"),
        kind.alias("object_kind"),
        value.alias("object_value"),
        _blank_to_null(F.when(literal, F.regexp_extract(obj, LITERAL, 2))).alias("lang"),
        _blank_to_null(F.when(literal, F.regexp_extract(obj, LITERAL, 3))).alias("datatype"),
    ]


def is_lang_tag(c: Column) -> Column:
    return c.startswith("@")


def is_iri(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s\"]*$")


def local_name(c: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(c, "/", -1)


def strip_id_prefix(c: Column, n: int = 3) -> Column:
    """An id without its first ``n`` characters (``/m/040db`` -> ``040db``)."""
    return F.substring(c, n + 1, 2147483647)


def entity_parts(subject: str) -> list[Column]:
    """subj_name, category and subcategory of ``http://host/seg/category/[sub:]name[/more]``; null where there are too few parts."""
    parts = F.split(F.col(subject), "/", -1)
    fifth, sixth = F.get(parts, F.lit(5)), F.get(parts, F.lit(6))
    name = F.when(F.size(parts) > 6, F.concat(fifth, sixth)).otherwise(fifth)
    sub = F.when(F.contains(fifth, F.lit(":")), F.substring_index(fifth, ":", 1)).when(fifth.isNotNull(), "")
    return [name.alias("subj_name"), F.get(parts, F.lit(4)).alias("category"), sub.alias("subcategory")]


def tokens(c: Column, stop_words: list[str], keep_numeric: bool = True) -> Column:
    """Distinct tokens of a literal: lower case, hyphens dropped, split at ASCII non-letters, longer than 1, no stop words."""
    parts = F.split(F.replace(F.lower(c), F.lit("-"), F.lit("")), r"[^a-z0-9]+")
    kept = F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*stop_words))
    if not keep_numeric:
        kept = F.filter(kept, lambda t: ~t.rlike("^[0-9]+$"))
    return F.array_distinct(kept)


def bigrams(c: Column) -> Column:
    """Character pairs in order; one character gives itself, the empty string nothing."""
    n = F.length(c)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Number of elements that two arrays share, repeats counted."""
    count = lambda arr, g: F.size(F.filter(arr, lambda x: x == g))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, g: n + F.least(count(a, g), count(b, g)))


def uri_similarity(a: Column, b: Column) -> Column:
    """Shared character pairs over all character pairs of both, 0 to 0.5; null when neither has any."""
    x, y = bigrams(a), bigrams(b)
    return F.try_divide(multiset_overlap(x, y).cast("double"), (F.size(x) + F.size(y)).cast("double"))


def numbered(arr: Column) -> Column:
    """Each element with the number of its occurrence, so that multisets become sets; for elements of one length."""
    return F.transform(arr, lambda g, i: F.concat(g, F.size(F.filter(F.slice(arr, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def set_similarity(a: Column, b: Column) -> Column:
    """``uri_similarity`` of names whose numbered bigrams are at hand: one hashed intersection."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), (F.size(a) + F.size(b)).cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; null when both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def smallest_divisor(n1: Column, n2: Column, limit: Column) -> Column:
    """The smallest v >= 2 with n1 * n2 / v <= limit, corrected for the rounding of the quotient."""
    product = (n1 * n2).cast("double")
    c = F.greatest(F.lit(2).cast("long"), F.ceil(product / limit))
    return F.when((c > 2) & (product / (c - 1) <= limit), c - 1).when(product / c > limit, c + 1).otherwise(c)


def chunks(arr: Column, size: Column) -> Column:
    """An array cut into arrays of ``size`` (the last may be shorter)."""
    n = F.ceil(F.size(arr) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(arr, i * size.cast("int") + 1, size.cast("int")))


def sum_over(first: Column | int, last: Column | int, f: Callable[[Column], Column]) -> Column:
    """f(first) + ... + f(last)."""
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.aggregate(F.sequence(lit(first), lit(last)), F.lit(0).cast("long"), lambda acc, i: acc + f(i).cast("long"))


def fold(arr: Column, f: Callable[[Column], Column]) -> Column:
    """Sum of f(x) over an array of doubles, from left to right."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + f(x))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def sphere(x: Column) -> Column:
    return fold(x, lambda v: v * v)


def rosenbrock(x: Column) -> Column:
    i = F.sequence(F.lit(1), F.size(x) - 1)
    return F.aggregate(i, F.lit(0.0), lambda acc, k: acc + 100 * F.pow(F.element_at(x, k + 1) - F.pow(F.element_at(x, k), F.lit(2.0)), F.lit(2.0)) + F.pow(F.element_at(x, k) - 1, F.lit(2.0)))


def inverse_distance(x: Column, base: float = 1.0) -> Column:
    """base + 1 / (x0^2 + x1^2)."""
    return F.lit(base) + F.try_divide(F.lit(1.0), F.get(x, F.lit(0)) * F.get(x, F.lit(0)) + F.get(x, F.lit(1)) * F.get(x, F.lit(1)))


def transe_score(h: Column, r: Column, t: Column) -> Column:
    """L1 norm of h + r - t."""
    moved = F.zip_with(h, r, lambda a, b: a + b)
    return fold(F.zip_with(moved, t, lambda a, b: a - b), F.abs)


def distmult_score(h: Column, r: Column, t: Column) -> Column:
    """Sum of h * r * t."""
    both = F.zip_with(h, r, lambda a, b: a * b)
    return fold(F.zip_with(both, t, lambda a, b: a * b), lambda x: x)


def margin_loss(better: Column, worse: Column, margin: float = 1.0) -> Column:
    """max(0, margin - (better - worse))."""
    return F.greatest(F.lit(0.0), F.lit(margin) - (better - worse))
